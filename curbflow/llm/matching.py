"""Scoring texts by prediction by partial matching, next to a unigram base.

The model is a trie of byte contexts, kept as a table of symbol counts by context. A
symbol that its context has not seen costs an escape (a context of q distinct symbols
after n in all escapes with q / (n + q)), and the next shorter context leaves out the
symbols already ruled out. Counts come from the training documents alone and stay
fixed, so the cost of a symbol depends on nothing but the bytes before it: each gram
of ``ORDER + 1`` symbols has one cost, worked out once by joining the tables of the orders.

Documents are stored in blocks of some megabytes. A block asks for the words and grams
that occur in it, each once; the answers return by one shuffle on the block. So no table
of the corpus is broadcast or held whole anywhere, and what is held grows with the
block only. A word that no other block holds needs no answer: its count is the block's own.

Cases: a null or empty text is the end token alone. A null ``doc_id`` counts as an empty
one when the folds are dealt. Repeated rows are each answered, and each counted when they
are of a training fold. Without training documents every symbol is equally likely.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.common import map_rows, ship, written

ORDER = 4
FOLDS, HELD_FOLD = 7, 2
BLOCK_BYTES = 12 << 20
START, END = 256, 257  # before the first byte (never predicted), after the last
_BITS = 9
_SYMBOLS = 257  # bytes and the end


def words_of_bytes(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, ASCII space


def grams_of(text: str, order: int = ORDER) -> np.ndarray:
    """One number per symbol, the end included: the symbol and the ``order`` before it."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    symbols = np.empty(raw.size + order + 1, dtype=np.int64)
    symbols[:order], symbols[order:-1], symbols[-1] = START, raw, END
    code = symbols[: raw.size + 1].copy()
    for i in range(1, order + 1):
        code <<= _BITS
        code |= symbols[i : raw.size + 1 + i]
    return code


def stored_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """``doc_id, text, held, block`` in the shared folder; blocks follow the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        block, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            texts, blocks = b.column(1).to_pylist(), []
            for t in texts:
                if size > block_bytes:
                    block, size = block + 1, 0
                size += len(t) + 100
                blocks.append(block)
            yield {"doc_id": b.column(0), "text": b.column(1), "held": b.column(2), "block": blocks}

    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (fold == HELD_FOLD).alias("held"))
    return written(map_rows(rows, run, "doc_id bigint, text string, held boolean, block bigint", batch=500), "blocks")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], list[bool]]]:
    for b in batches:
        blocks = b.column(2).to_numpy()
        edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for x, y in zip(edges, edges[1:]):
            if y > x:
                part = b.slice(x, y - x)
                yield int(blocks[x]), part.column(0).to_pylist(), part.column(1).to_pylist()


def block_words(blocks: DataFrame) -> DataFrame:
    """``block, word, n``: the words of each block, with their number in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, counts = None, Counter()
        for block, texts, held in _by_block(batches):
            if block != now and counts:
                yield {"block": [now] * len(counts), "word": list(counts), "n": list(counts.values())}
                counts = Counter()
            now = block
            for t, h in zip(texts, held):
                words = words_of_bytes(t)
                if h:
                    for w in words:
                        counts.setdefault(w, 0)
                else:
                    counts.update(words)
        if counts:
            yield {"block": [now] * len(counts), "word": list(counts), "n": list(counts.values())}

    return map_rows(blocks.select("text", "held", "block"), run, "block bigint, word binary, n bigint", batch=500)


def block_grams(blocks: DataFrame, order: int) -> DataFrame:
    """``block, gram, n`` likewise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, parts = None, []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            grams = np.concatenate([g for g, _ in parts])
            kinds, at = np.unique(grams, return_inverse=True)
            # float sums are exact far beyond any block
            return kinds, np.bincount(at, np.concatenate([n for _, n in parts]), len(kinds)).astype(np.int64)

        for block, texts, held in _by_block(batches):
            if block != now and parts:
                grams, n = merged()
                yield {"block": np.full(len(grams), now), "gram": grams, "n": n}
                parts = []
            now = block
            for h in (False, True):
                own = [grams_of(t, order) for t, x in zip(texts, held) if x == h]
                if own:
                    grams, n = np.unique(np.concatenate(own), return_counts=True)
                    parts.append((grams, np.zeros_like(n) if h else n))
            if len(parts) > 16:
                parts = [merged()]
        if parts:
            grams, n = merged()
            yield {"block": np.full(len(grams), now), "gram": grams, "n": n}

    return map_rows(blocks.select("text", "held", "block"), run, "block bigint, gram bigint, n bigint", batch=500)


def _suffix(gram: Column, symbols: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (_BITS * symbols)) - 1).cast("long"))


def _context(gram: Column) -> Column:
    return F.shiftright(gram, _BITS)


def gram_costs(totals: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, cost``: log10 of the probability of each gram's last symbol.

    ``totals`` has ``gram, n`` over all texts; n is zero where training never saw it.
    """
    seen = totals.where("n > 0")
    levels = [
        seen.groupBy(_suffix(F.col("gram"), j + 1).alias("g")).agg(F.sum("n").cast("double").alias("c")) for j in range(order + 1)
    ]
    contexts = [
        level.groupBy(_context(F.col("g")).alias("x")).agg(F.sum("c").alias("n"), F.count("*").cast("double").alias("q"))
        for level in levels
    ]
    bounded = 1  # up to this order a table has at most 258 * 257 rows and is broadcast
    rows = totals.select("gram", F.lit(0.0).alias("cost"), F.lit(False).alias("done"))
    rows = rows.withColumns({"rest_n": F.lit(None).cast("double"), "rest_q": F.lit(None).cast("double")})
    for j in range(order, -1, -1):
        gram = _suffix(F.col("gram"), j + 1)
        small = F.broadcast if j <= bounded else lambda df: df
        rows = rows.withColumns({"g": gram, "x": _context(gram)})
        rows = rows.join(small(levels[j]), "g", "left").join(small(contexts[j]), "x", "left")
        # without what the longer context has ruled out, where there is such a context
        n, q = F.coalesce("rest_n", "n"), F.coalesce("rest_q", "q")
        whole = n + q
        step = F.when(F.col("c").isNotNull(), F.log10(F.col("c") / whole)).when(q > 0, F.log10(q / whole)).otherwise(0.0)
        rows = rows.select(
            "gram",
            F.when(F.col("done"), F.col("cost")).otherwise(F.col("cost") + step).alias("cost"),
            (F.col("done") | F.col("c").isNotNull()).alias("done"),
            F.col("x").alias("longer"),
        )
        if j:
            # per context of order j: what its shorter context holds beyond its symbols
            shorter = levels[j].select(_context(F.col("g")).alias("longer"), _suffix(F.col("g"), j).alias("g"))
            held = shorter.join(small(levels[j - 1]), "g").groupBy("longer").agg(
                F.sum("c").alias("out_n"), F.count("*").alias("out_q")
            )
            held = held.withColumn("x", _suffix(F.col("longer"), j - 1) if j > 1 else F.lit(0).cast("long"))
            held = held.join(small(contexts[j - 1]), "x").select(
                "longer", (F.col("n") - F.col("out_n")).alias("rest_n"), (F.col("q") - F.col("out_q")).alias("rest_q")
            )
            rows = rows.join(small(held), "longer", "left").drop("longer")
    known = levels[0].agg(F.count("*")).scalar()
    last = -F.log10(F.greatest(F.lit(float(_SYMBOLS)) - known, F.lit(1.0)))
    return rows.select("gram", F.when(F.col("done"), F.col("cost")).otherwise(F.col("cost") + last).alias("cost"))


def _word_answers(blocks: DataFrame) -> tuple[DataFrame, int, int, int]:
    """``block, word, value`` for words of more than one block; training tokens, distinct
    training words and training documents."""
    one = Window.partitionBy("word")
    rows = block_words(blocks).withColumns(
        {
            "c": F.sum("n").over(one),
            "blocks": F.count("*").over(one),  # a word has at most one row per block
            "first": F.col("block") == F.min("block").over(one),  # one sort by word serves all
        }
    )
    wide = F.col("blocks") > 1
    rows = written(
        rows.select(
            *(F.when(wide, F.col(x)).alias(x) for x in ("block", "word")),
            F.when(wide, F.col("c")).cast("double").alias("value"),
            F.when(F.col("first"), F.col("c")).otherwise(0).alias("tokens"),
        ),
        "word-counts",
    )
    tokens, words = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.when(F.col("tokens") > 0, 1))).first()
    documents = blocks.where("not held").count()
    return rows.where("word is not null").select("block", "word", "value"), tokens, words, documents


class Places:
    """Where numbers stand in a sorted array that holds them all.

    A table by hash answers most; a number whose slot holds another is searched for.
    """

    def __init__(self, kinds: np.ndarray):
        self.kinds = kinds
        self.shift = np.uint64(64 - max(1, (8 * len(kinds)).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slots[self._slot(kinds)] = np.arange(len(kinds), dtype=np.int32)

    def _slot(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(numbers)]
        other = np.flatnonzero(self.kinds[at] != numbers)
        at[other] = np.searchsorted(self.kinds, numbers[other])
        return at


def _scored(docs: pa.Table, answers: pa.Table, tokens: int, words: int, documents: int, order: int) -> Iterable[dict]:
    """Base and model score of a block's documents."""
    is_word = answers["word"].is_valid()
    by_gram = answers.filter(pa.compute.invert(is_word))
    grams, costs = by_gram["gram"].to_numpy(), by_gram["value"].to_numpy()
    place = np.argsort(grams)
    grams, costs = np.ascontiguousarray(grams[place]), costs[place]
    places = Places(grams)
    texts, held = docs["text"].to_pylist(), docs["held"].to_pylist()
    # each text is split once; from then on a word is its number in the block
    numbers: dict[bytes, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in words_of_bytes(t)], np.int32) for t in texts]
    training = [c for c, h in zip(coded, held) if not h]
    counts = np.bincount(np.concatenate(training) if training else np.empty(0, np.int32), minlength=len(numbers) + 1).astype(np.float64)
    by_word = answers.filter(is_word)
    at = np.array([numbers.get(w, -1) for w in by_word["word"].to_pylist()], np.int64)
    counts[at[at >= 0]] = by_word["value"].to_numpy()[at >= 0]
    logs = np.log10(counts + 1)
    every = math.log10(tokens + documents + words + (documents > 0) + 1)
    end = math.log10(documents + 1)
    out = []
    for t, own in zip(texts, coded):
        base = float(logs[own].sum()) + end - (len(own) + 1) * every
        score = float(costs[places.of(grams_of(t, order))].sum())
        out.append((len(own) + 1, int((counts[own] > 0).sum()) + (documents > 0), base, score))
    return out


def score_documents(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: fold, tokens, known tokens, base score and model score."""
    ship(docs.sparkSession)
    blocks = stored_blocks(docs, block_bytes)
    words, tokens, distinct, documents = _word_answers(blocks)
    grams = block_grams(blocks, order)
    totals = written(grams.groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")
    costs = written(gram_costs(totals, order), "gram-costs")
    answers = words.withColumn("gram", F.lit(None).cast("long")).select("block", "word", "gram", "value")
    by_gram = grams.select("block", "gram").join(costs, "gram")
    answers = answers.unionAll(by_gram.select("block", F.lit(None).cast("binary"), "gram", F.col("cost")))
    schema = (
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double"
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _scored(left, right, tokens, distinct, documents, order)
        n, known, base, score = map(list, zip(*rows)) if rows else ([], [], [], [])
        return pa.table(
            {
                "doc_id": left["doc_id"],
                "held_out": left["held"],
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array([tokens + documents] * len(n), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
