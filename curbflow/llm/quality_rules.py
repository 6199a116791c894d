"""Quality rules: base counts, then divergence from the language's own habits.

Every language with enough text gets two reference histograms, counted over all
documents: of character classes and of its common words. A document is compared
with both by the Jensen-Shannon distance (base 2, square root, 0 to 1). A document
too short for a histogram to mean anything is not judged by it.

Cases: a null or empty text has no words, so its base fails and it is not kept. A
document whose language is null, or holds too little text for a reference, is judged by
the base alone. Repeated rows are each answered and each count in the references.
Other columns may have any name: only ``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import map_rows, words_of

CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "wide")
_SYMBOLS = "#*$%&|<>"
_FLUSH = 300_000


@dataclass(frozen=True)
class Limits:
    common_share: float = 0.002  # a common word makes up at least this share of its language
    language_share: float = 0.001  # a language with a reference holds at least this share of all words
    min_chars: int = 200  # shorter texts are not judged by character classes
    min_words: int = 60  # nor by common words
    max_class_distance: float = 0.25
    max_word_distance: float = 0.32
    # a histogram of few draws lies further from its source: allowance times sqrt(cells / draws)
    allowance: float = 0.25


def _class_table() -> np.ndarray:
    kinds = np.full(256, CLASSES.index("mark"), dtype=np.uint8)
    for chars, name in (
        (b"abcdefghijklmnopqrstuvwxyz", "lower"),
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"),
        (b"0123456789", "digit"),
        (b" \t\n\v\f\r", "space"),
        (b".,", "stop"),
        (_SYMBOLS.encode() + b"=+~^_\\/@{}[]", "symbol"),
    ):
        kinds[list(chars)] = CLASSES.index(name)
    kinds[0xC0:] = CLASSES.index("wide")  # one count per character: its first byte
    kinds[0x80:0xC0] = len(CLASSES)  # following bytes are not counted
    return kinds


_KINDS = _class_table()


def class_counts(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return np.bincount(_KINDS[raw], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


def repeated_words(ids: np.ndarray, size: int = 8) -> int:
    """Words inside windows of ``size`` words (a power of two) that occur more than
    once. Windows are told apart exactly: pairs of ranks are ranked again."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    step = 1
    while step < size:
        pairs = ids[:-step].astype(np.int64) * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    counts = np.bincount(ids)
    if counts.max() < 2:
        return 0
    again = (counts[ids] > 1).astype(np.int64)
    edges = np.zeros(n + size, dtype=np.int64)
    edges[:n] += again
    edges[size:] -= again
    return int((np.cumsum(edges) > 0).sum())


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif words_of(line):
            seen.add(line)
    return again


def _rank(words: list[str]) -> tuple[dict[str, int], np.ndarray]:
    ranks: dict[str, int] = {}
    return ranks, np.array([ranks.setdefault(w, len(ranks)) for w in words], dtype=np.int64)


def habits(docs: DataFrame) -> DataFrame:
    """``lang, kind, item, n``: character classes and words of all texts by language.
    Counted inside each task first, so a large language or a frequent word sends few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def flush() -> dict:
            rows = [(lang, "word", w, n) for lang, c in words.items() for w, n in c.items()]
            rows += [(lang, "class", k, int(n)) for lang, c in classes.items() for k, n in zip(CLASSES, c)]
            words.clear()
            classes.clear()
            columns = list(zip(*rows)) or [[], [], [], []]
            return dict(zip(("lang", "kind", "item", "n"), map(list, columns)))

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(words_of(text))
                classes[lang] = classes.get(lang, 0) + class_counts(text)
            if sum(map(len, words.values())) > _FLUSH:
                yield flush()
        yield flush()

    texts = docs.where("text is not null and lang is not null").select("text", "lang")
    rows = map_rows(texts, run, "lang string, kind string, item string, n bigint", batch=500)
    return rows.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Reference:
    classes: np.ndarray
    words: dict[str, int]  # common word to its cell
    cells: np.ndarray  # counts of the common words, then of all others


def references(docs: DataFrame, limits: Limits = Limits()) -> dict[str, Reference]:
    """Histograms per language. What reaches the driver is bounded by the two shares:
    at most 1/language_share languages of 1/common_share words each."""
    from curbflow.llm.common import written

    counts = written(habits(docs), "habits")
    totals = counts.where("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("total"))
    everything = totals.agg(F.sum("total")).first()[0] or 0
    totals = totals.where(F.col("total") >= everything * limits.language_share)
    totals = F.broadcast(totals)  # at most 1/language_share rows
    common = counts.join(totals, "lang").where(
        (F.col("kind") == "class") | (F.col("n") >= F.col("total") * limits.common_share)
    )
    found: dict[str, Reference] = {}
    rows = common.collect()
    for lang in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == lang]
        by_class = {r["item"]: r["n"] for r in own if r["kind"] == "class"}
        by_word = sorted((r["item"], r["n"]) for r in own if r["kind"] == "word")
        rest = own[0]["total"] - sum(n for _, n in by_word)
        found[lang] = Reference(
            np.array([by_class.get(c, 0) for c in CLASSES], dtype=float),
            {w: i for i, (w, _) in enumerate(by_word)},
            np.array([n for _, n in by_word] + [rest], dtype=float),
        )
    return found


FEATURES = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, class_distance double, word_distance double, kept boolean"
)


def judge(text: str, ref: Reference | None, limits: Limits) -> tuple:
    words = words_of(text)
    ranks, ids = _rank(words)
    n = len(words)
    repeat = repeated_words(ids)
    failed = n < 20 or 100 * repeat > 30 * n
    by_class = by_word = None
    kept = not failed
    if ref is not None:
        if len(text) >= limits.min_chars:
            counts = class_counts(text)
            by_class = distance(counts, ref.classes)
            kept &= by_class <= limits.max_class_distance + limits.allowance * (len(CLASSES) / counts.sum()) ** 0.5
        if n >= limits.min_words and ref.words:
            cells = np.zeros(len(ref.cells))
            counts = np.bincount(ids)
            for w in ranks.keys() & ref.words.keys():
                cells[ref.words[w]] = counts[ranks[w]]
            cells[-1] = n - cells.sum()
            by_word = distance(cells, ref.cells)
            kept &= by_word <= limits.max_word_distance + limits.allowance * (len(cells) / n) ** 0.5
    return (
        n, sum(map(len, words)), sum(map(text.count, _SYMBOLS)), repeated_lines(text), repeat,
        failed, by_class, by_word, bool(kept),
    )


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Base counts, both distances (null where a text is too short) and the verdict."""
    refs = docs.sparkSession.sparkContext.broadcast(references(docs, limits))
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = [
                judge(text or "", refs.value.get(lang), limits)
                for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist())
            ]
            columns = [list(c) for c in zip(*rows)] or [[] for _ in names[1:]]
            yield dict(zip(names, [b.column(0), *columns]))

    return map_rows(docs.select("doc_id", "text", "lang"), run, FEATURES)
