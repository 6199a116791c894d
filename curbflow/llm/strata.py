"""Ranked search in an index stratified by document length.

A score depends on a document only through its term counts and its length normaliser ``m``.
So documents of equal ``m`` form a stratum, and inside a stratum the postings of a term are
sorted by term count ``tf``: the impact of a count is worked out once per stratum, not once
per posting, and the largest count of each term bounds what any document of the stratum can
score. For every query the strata of a part are visited by falling bound, until the bound
lies below the worst of the best scores so far.

The index holds the query terms only. Documents are scanned once per block of queries: a
block's vocabulary and its queries are bounded in bytes, as they go to every task; any
number of queries makes more blocks. A stratum with many postings is dealt over several parts by
document, small ones share a part, so a part's size does not depend on how lengths or
sources are spread. Every part returns its best ``keep`` documents of each query, which then
are ranked against each other.

Terms are maximal runs of letters, digits and non-ASCII characters, A-Z in lower case.

Cases: a null text has no term and never counts as a document with terms; neither does a
text without any. Queries without a known term return no row. Rows that repeat are
documents (or queries) of their own; equal scores go by doc_id, a null id last, and beyond
that any order, which shows nothing. Empty tables give an empty result. Other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.common import ASCII_LOWER, map_rows, ship, written

PART_POSTINGS = 2_000_000
BLOCK_BYTES = 16 << 20  # texts of the queries in a block
SCALE, TF_SCALE, LENGTH_SCALE = 1_000_000_000, 1000, 20
LAST = (1 << 63) - 1  # sorts a null id last

_TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text: str) -> list[str]:
    return _TERMS.findall(text.translate(ASCII_LOWER))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def query_terms(items: DataFrame, item_id: str) -> DataFrame:
    """``q`` (a number of the row), ``item_id``, ``size`` and the distinct ``terms`` of each item."""
    rows = items.select(F.monotonically_increasing_id().alias("q"), F.col(item_id).cast("bigint").alias("item_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            terms = [sorted(set(terms_of(t or ""))) for t in b.column(2).to_pylist()]
            size = [sum(len(t) + 60 for t in own) for own in terms]
            yield {"q": b.column(0), "item_id": b.column(1), "size": size, "terms": terms}

    return map_rows(rows, run, "q bigint, item_id bigint, size bigint, terms array<string>", batch=100)


def scanned(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """``d`` (a number of the row), ``doc_id``, ``n`` terms, and the codes and counts of those
    in the vocabulary, four bytes each."""
    rows = docs.select(F.monotonically_increasing_id().alias("d"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = shared.value
        for b in batches:
            n, codes, tfs = [], [], []
            for text in b.column(2).to_pylist():
                counts = Counter(terms_of(text or ""))
                n.append(counts.total())
                own = [(known[t], c) for t, c in counts.items() if t in known]
                pairs = np.array(own, "<i4").reshape(-1, 2)
                codes.append(pairs[:, 0].tobytes())
                tfs.append(pairs[:, 1].tobytes())
            yield {"d": b.column(0), "doc_id": b.column(1), "n": n, "codes": codes, "tfs": tfs}

    out = written(map_rows(rows, run, "d bigint, doc_id bigint, n bigint, codes binary, tfs binary", batch=500), "scanned")
    shared.destroy()
    return out


def document_frequencies(scan: DataFrame, size: int) -> np.ndarray:
    """In how many documents each code stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4"), minlength=size)
        codes = np.flatnonzero(df)
        yield {"code": codes, "df": df[codes]}

    counted = map_rows(scan.select("codes"), run, "code bigint, df bigint").groupBy("code").agg(F.sum("df").alias("df"))
    rows = counted.toArrow()  # no more rows than the block's vocabulary
    df = np.zeros(size, np.int64)
    df[rows["code"].to_numpy()] = rows["df"].to_numpy()
    return df


class Queries:
    """The queries of a block: codes and weights of their terms, one query after the other."""

    def __init__(self, q: list[int], terms: list[list[int]], weights: np.ndarray):
        self.q = np.array(q, np.int64)
        self.sizes = np.array([len(t) for t in terms], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.codes = np.array([c for own in terms for c in own], np.int64)
        self.weights = weights[self.codes]

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.ends[i] - self.sizes[i], self.ends[i])
        return self.codes[part], self.weights[part]


class Stratum:
    """Documents of equal ``m``: postings by term, and by falling count within a term."""

    def __init__(self, m: int, d: np.ndarray, ids: np.ndarray, codes: list[bytes], tfs: list[bytes]):
        self.d, self.ids = d, ids
        code = np.frombuffer(b"".join(codes), "<i4").astype(np.int64)
        tf = np.frombuffer(b"".join(tfs), "<i4").astype(np.int64)
        doc = np.repeat(np.arange(len(d)), [len(c) // 4 for c in codes])
        order = np.lexsort((-tf, code))
        self.doc = doc[order]
        # the impact of each count, once for all its postings
        counts, which = np.unique(tf[order], return_inverse=True)
        impact = np.array([SCALE * t // (TF_SCALE * t + LENGTH_SCALE * m) for t in counts.tolist()], np.int64)
        self.impact = impact[which]
        self.codes, starts = np.unique(code[order], return_index=True)
        self.edges = np.r_[starts, len(code)]
        self.most = self.impact[starts]  # what the largest count of a term is worth

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the codes stand here, and their places among this stratum's."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        here = self.codes[at] == codes
        return here, at

    def bounds(self, queries: Queries) -> np.ndarray:
        """The most that a document of this stratum can score, per query."""
        here, at = self.places(queries.codes)
        run = np.r_[0, np.cumsum(np.where(here, queries.weights * self.most[at], 0))]
        return run[queries.ends] - run[queries.ends - queries.sizes]

    def scores(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of all documents of the stratum for one query."""
        here, at = self.places(codes)
        start, size = self.edges[at[here]], np.diff(self.edges)[at[here]]
        total = int(size.sum())
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)
        parts = np.repeat(weights[here], size) * self.impact[at]
        if parts.sum(dtype=np.float64) < 2**52:  # sums of doubles are exact
            return np.bincount(self.doc[at], weights=parts, minlength=len(self.d)).astype(np.int64)
        out = np.zeros(len(self.d), np.int64)
        np.add.at(out, self.doc[at], parts)
        return out


def best_of_part(strata: list[Stratum], queries: Queries, keep: int) -> tuple[list, list, list, list]:
    """Query, document id, document and score of the best ``keep`` per query."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    bounds = np.array([s.bounds(queries) for s in strata])
    for i in range(len(queries.q)):
        codes, weights = queries.of(i)
        score = ids = d = np.empty(0, np.int64)
        for s in np.argsort(-bounds[:, i], kind="stable").tolist():
            # a tie with the worst kept may still win by its id, so only less is passed over
            if bounds[s, i] <= 0 or (len(score) == keep and bounds[s, i] < score[-1]):
                break
            found = strata[s].scores(codes, weights)
            hit = np.flatnonzero(found >= (score[-1] if len(score) == keep else 1))
            score, ids, d = np.r_[score, found[hit]], np.r_[ids, strata[s].ids[hit]], np.r_[d, strata[s].d[hit]]
            order = np.lexsort((d, ids, -score))[:keep]
            score, ids, d = score[order], ids[order], d[order]
        for column, values in zip(out, (np.full(len(score), queries.q[i]), ids, d, score)):
            column.append(values)
    return out


def parts_of(scan: DataFrame, n_docs: int, n_terms: int, postings: int) -> DataFrame:
    """Documents with ``m`` and the part of the index that holds them."""
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {n_terms}L")
    held = scan.where("length(codes) > 0").withColumn("m", m).withColumn("postings", (F.length("codes") / 4).cast("bigint"))
    sizes = written(held.groupBy("m").agg(F.sum("postings").alias("stratum")), "strata")
    small = sizes.where(F.col("stratum") <= postings).agg(F.sum("stratum")).first()[0] or 0
    shared = max(1, -(-small // postings))
    dealt = sizes.withColumn("shards", F.ceil(F.col("stratum") / F.lit(postings)).cast("int"))
    part = F.when(
        F.col("shards") > 1, F.struct(F.col("m").alias("p"), F.pmod(F.xxhash64("d"), F.col("shards")).alias("shard"))
    ).otherwise(F.struct(F.pmod(F.xxhash64("m"), F.lit(shared)).alias("p"), F.lit(-1).cast("bigint").alias("shard")))
    # strata are as many as there are lengths: Spark broadcasts them or joins by shuffle
    return held.join(dealt, "m").select("d", "doc_id", "m", "codes", "tfs", part.alias("part"))


def search(docs: DataFrame, items: DataFrame, item_id: str = "item_id", keep: int = 50) -> DataFrame:
    """The ``keep`` documents of ``doc_id, text`` with the highest scores above zero for
    each item: ``item_id, rank, doc_id, score``."""
    queries = written(query_terms(items, item_id), "query-terms")
    total = queries.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    out = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        found = _search_block(docs, own, keep)
        out = found if out is None else out.unionAll(found)
    return out


def _search_block(docs: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    rows = queries.where("size(terms) > 0").toArrow()  # bounded by the block
    terms = rows["terms"].to_pylist()
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for own in terms for t in own))}
    scan = scanned(docs, vocabulary)
    n_docs, n_terms = scan.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    df = document_frequencies(scan, len(vocabulary))
    weights = np.array([weight(n_docs, c) for c in df.tolist()], np.int64)
    block = Queries(rows["q"].to_pylist(), [[vocabulary[t] for t in own] for own in terms], weights)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kind = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("d", pa.int64()), ("score", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("m").combine_chunks()
        m = t["m"].to_numpy()
        strata = []
        for s, e in zip([0, *(edges := (np.flatnonzero(np.diff(m)) + 1).tolist())], [*edges, len(m)]):
            part = t.slice(s, e - s)
            ids = part["doc_id"].fill_null(LAST).to_numpy()
            strata.append(Stratum(int(m[s]), part["d"].to_numpy(), ids, part["codes"].to_pylist(), part["tfs"].to_pylist()))
        columns = best_of_part(strata, shared.value, keep)
        return pa.table([np.concatenate(c) if c else np.empty(0, np.int64) for c in columns], schema=kind)

    parts = parts_of(scan, n_docs, n_terms, PART_POSTINGS)
    found = parts.groupBy("part").applyInArrow(run, "q bigint, id bigint, d bigint, score bigint")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id", "d")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return ranked.join(queries.select("q", "item_id"), "q").select(
        "item_id", "rank", F.nullif("id", F.lit(LAST)).alias("doc_id"), "score"
    )
