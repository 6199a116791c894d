"""Benchmark passages in documents: a prefix-filtered set join, in SQL expressions only.

A window is ten words of an item in a row, or a shorter item as a whole. As it must lie
in a document entirely, any one of its words is a necessary prefix token. Words are
ordered by how rare they are in the documents and each window is joined through its
rarest one. Position and length bounds come next, then the words themselves are
compared. All of that happens in the row that holds the document: nothing is shuffled
before a window is confirmed.

The benchmark's words and windows are broadcast in blocks of a measured size, so
their number may grow; every block is one more pass over the documents.

Cases: a null or empty text has no words. An item without words has no window. Items are
told apart by ``item_id``; null ids are one item, written as an empty string. Equal
texts are answered from the same row, and every row is answered.
Only ``doc_id`` and ``text``, ``item_id`` and ``text`` are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import LOWER, UPPER, text_key, written

WINDOW = 10
BLOCK_BYTES = 64 << 20
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(column: str = "text") -> Column:
    """Words in their own case; lower-casing never moves their borders."""
    return F.array_remove(F.split(F.coalesce(F.col(column), F.lit("")), _GAP), "")


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``item, wid, words``: every window of every item."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _words().alias("w"))
    rows = rows.where(F.size("w") > 0).withColumn(
        "at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))))
    )
    text = _ascii_lower(F.array_join(F.slice("w", F.col("at") + 1, size), " "))
    return rows.select("item", text.alias("window")).distinct()


def _blocks(df: DataFrame, key: str, block_bytes: int) -> list[DataFrame]:
    """``df`` in parts that may each be broadcast, by their measured size."""
    row = F.octet_length(F.to_json(F.struct(*df.columns))) + 64
    n = -(-(df.agg(F.sum(row)).first()[0] or 0) // block_bytes)
    part = F.pmod(F.xxhash64(key), F.lit(max(n, 1)))
    return [F.broadcast(df.where(part == i) if n > 1 else df) for i in range(n)]


def _survey(docs: DataFrame, vocabulary: list[DataFrame]) -> DataFrame:
    """In one pass: how often each benchmark word stands in the documents (rows with
    ``v``), and the number of words of each text (rows with ``k1``)."""
    texts = docs.select(*text_key(), _words().alias("w"))
    first = (F.col("pos") == 0) | F.col("pos").isNull()

    def one(words: DataFrame | None, with_texts: bool) -> DataFrame:
        rows = texts.select("k1", "k2", F.size("w").cast("long").alias("n"), F.posexplode_outer("w"))
        rows = rows.withColumn("lower", F.lower("col"))
        rows = rows.join(words, F.col("lower") == F.col("v"), "left") if words is not None else rows.withColumn("v", F.lit(None).cast("string"))
        mark = first if with_texts else F.lit(False)
        rows = rows.where(F.col("v").isNotNull() | mark)
        keys = [F.when(mark, F.col(c)).alias(c) for c in ("k1", "k2", "n")]
        return rows.select("v", *keys).groupBy("v", "k1", "k2", "n").agg(F.count("*").alias("times"))

    parts = [one(v, i == 0) for i, v in enumerate(vocabulary)] or [one(None, True)]
    return reduce(DataFrame.unionAll, parts)


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Where windows stand, ``k1, k2, at, len, window``; and ``k1, k2, n_words`` of every text."""
    found = written(windows(items, size).select("window").distinct(), "windows")
    tokens = found.select("window", F.posexplode(F.split("window", " ")).alias("off", "word"))
    tokens = tokens.withColumn("word", F.lower("word"))
    vocabulary = tokens.select(F.col("word").alias("v")).distinct()
    survey = written(_survey(docs, _blocks(vocabulary, "v", block_bytes)), "survey")
    rarity = survey.where("v is not null").groupBy(F.col("v").alias("word")).agg(F.sum("times").alias("times"))
    # a word that no document holds rules its windows out at once
    tokens = tokens.join(rarity, "word", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    prefix = tokens.groupBy("window").agg(
        F.min(F.struct("times", "word", "off")).alias("p"), F.count("*").cast("int").alias("len")
    )
    prefix = written(
        prefix.where("p.times > 0").select(F.col("p.word").alias("word"), F.col("p.off").alias("off"), "len", "window"),
        "prefixes",
    )
    texts = docs.select(*text_key(), _words().alias("w"))
    rows = texts.select("k1", "k2", "w", F.size("w").alias("n"), F.posexplode("w"))
    at = F.col("pos") - F.col("off")
    same = _ascii_lower(F.array_join(F.slice("w", F.greatest(at + 1, F.lit(1)), F.col("len")), " ")) == F.col("window")
    bounds = (at >= 0) & (at + F.col("len") <= F.col("n"))
    parts = [
        rows.join(p, (F.lower("col") == F.col("word")) & bounds & same).select("k1", "k2", at.alias("at"), "len", "window")
        for p in _blocks(prefix, "window", block_bytes)
    ]
    hits = reduce(DataFrame.unionAll, parts).distinct() if parts else None
    lengths = survey.where("k1 is not null").select("k1", "k2", F.col("n").alias("n_words")).distinct()
    if hits is None:
        hits = lengths.select("k1", "k2", F.lit(0).alias("at"), F.lit(0).alias("len"), F.lit("").alias("window")).where("false")
    return hits, lengths


def _covered(spans: str) -> Column:
    """Words inside the union of sorted spans ``(at, end)``."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["end"] - F.greatest(s["at"], acc["to"]), F.lit(0))).cast("long").alias("n"),
        F.greatest(acc["to"], s["end"]).alias("to"),
    )
    return F.aggregate(F.sort_array(spans), start, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: its words, those inside a window, the items it holds windows of."""
    hits, lengths = occurrences(docs, items, size, block_bytes)
    hits = written(hits, "hits")
    spans = hits.groupBy("k1", "k2").agg(
        F.collect_set(F.struct("at", (F.col("at") + F.col("len")).alias("end"))).alias("spans")
    )
    spans = spans.select("k1", "k2", _covered("spans").alias("n_hit"))
    held = hits.select("k1", "k2", "window").distinct().join(windows(items, size), "window")
    held = held.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    known = lengths.join(spans, ["k1", "k2"], "left").join(held, ["k1", "k2"], "left")
    rows = docs.select("doc_id", *text_key()).join(known, ["k1", "k2"], "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any window, unchanged. Contaminated texts are few or
    many; the join on their keys is left to the adaptive plan."""
    hits, _ = occurrences(docs, items, size, block_bytes)
    gone = written(hits.select("k1", "k2").distinct(), "contaminated")
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"), *text_key())
    return rows.join(gone, ["k1", "k2"], "left_anti").select("row.*")
