"""Passages that stand in more than one place, byte for byte.

Every string of ``length`` bytes that starts in two places is found, by a suffix array
that keeps only suffixes at anchors. An anchor is the place of the smallest hash of
``GRAM`` bytes among those inside a window of ``length`` bytes; equal windows have it at
the same distance, so two copies of a string share an anchor with all bytes around it.

- Anchors are counted by gram hash; what occurs once is dropped.
- The bytes that windows of an anchor can reach are its context. Equal contexts are
  combined, however many: all bytes of a context that occurs twice are repeated.
- Among different contexts of one gram, an enhanced suffix array over the bytes from the
  anchor on is scanned with a stack for its common-prefix intervals. The members of an
  interval are scanned likewise over the bytes before the anchor. A group that is
  diverse on both sides is a maximal repeat, with all its occurrences.
- Grams with more than ``group_limit`` different contexts are divided instead: the hash of
  every window in those contexts is counted. That is exact too, and splits at will.

Texts are known by a 128-bit key, so exact copies are one row; their texts meet by a
partial aggregation. Texts travel only where a span of them is asked for.

Cases: a null or empty text has nothing to remove, nor has one shorter than ``length``.
Matches never cross texts, but may overlap within one. Repeated rows are copies of each
other like any equal texts. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import in_sieve, map_rows, sieve, text_key, written

LENGTH = 200
GRAM = 64
GROUP_LIMIT = 20_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` bytes in a row."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * _ODD
    done, level = 1, 1
    while done < size:  # of strings twice as long, at last of two that overlap
        step = min(done, size - done)
        factor = np.uint64(xxhash.xxh64_intdigest(str(level)) | 1)
        h = h[: h.size - step] * factor + h[step:]
        done, level = done + step, level + 1
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows' smallest gram hashes (the leftmost of equals), and these."""
    width = length - gram + 1
    if raw.size < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(raw, gram)
    least, done = h, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: least.size - step], least[step:])
        done += step
    # of equal hashes in a window the leftmost counts: the next place at or after its start
    order = np.lexsort((np.arange(h.size), h)) if _has_ties(h, least, width) else None
    if order is None:
        chosen = np.flatnonzero(_is_least(h, least, width))
    else:
        ranks = np.empty(h.size, np.int64)
        ranks[order] = np.arange(h.size)
        low, done = ranks, 1
        while done < width:
            step = min(done, width - done)
            low = np.minimum(low[: low.size - step], low[step:])
            done += step
        chosen = np.unique(order[low])
    return chosen, h[chosen]


def _is_least(h: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the smallest of some window that holds them."""
    # that is, if the largest of the minima of its windows is its own hash
    edge = np.zeros(width - 1, np.uint64)
    padded, done = np.concatenate([edge, least, edge]), 1
    while done < width:
        step = min(done, width - done)
        padded = np.maximum(padded[: padded.size - step], padded[step:])
        done += step
    return padded == h


def _has_ties(h: np.ndarray, least: np.ndarray, width: int) -> bool:
    low = h[_is_least(h, least, width)]
    return np.unique(low).size < low.size


def contexts(raw: bytes, at: np.ndarray, length: int, gram: int) -> list[tuple[int, int, int, int, int]]:
    """``place, left, right`` and a 128-bit name of the bytes around each anchor."""
    reach = length - gram
    out = []
    for p in at.tolist():
        left, right = min(p, reach), min(length, len(raw) - p)
        name = xxhash.xxh3_128_intdigest(raw[p - left : p + right], left)
        out.append((p, left, right, _signed(name >> 64), _signed(name & (1 << 64) - 1)))
    return out


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class Texts:
    """The distinct texts of ``docs``, as often as they are scanned."""

    def __init__(self, docs: DataFrame):
        keyed = docs.select(*text_key(), F.coalesce("text", F.lit("")).alias("text"))
        self.copies = written(keyed.groupBy("k1", "k2").count().where("count > 1"), "copies")
        self.bitmap = sieve(self.copies, "k1")
        self.keyed = keyed
        several = self._where(keyed, self.bitmap, True)
        self.several = written(several.groupBy("k1", "k2").agg(F.first("text").alias("text")), "copied-texts")

    @staticmethod
    def _where(rows: DataFrame, bitmap, inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                keep = in_sieve(bitmap.value, b.column(0).to_numpy()) == inside
                part = b.filter(pa.array(keep))
                yield {"k1": part.column(0), "k2": part.column(1), "text": part.column(2)}

        return map_rows(rows, run, "k1 bigint, k2 bigint, text string", batch=1000)

    def rows(self) -> DataFrame:
        return self._where(self.keyed, self.bitmap, False).unionAll(self.several)

    def of(self, wanted: DataFrame) -> DataFrame:
        """Texts of the keys in ``wanted``, beside its columns. Only texts that may be
        wanted are shuffled."""
        return self._where(self.rows(), sieve(wanted.select("k1").distinct(), "k1"), True).join(wanted, ["k1", "k2"])


def _anchored(texts: DataFrame, length: int, gram: int, bitmap=None) -> DataFrame:
    """One row per text and context: gram hash, context, its places in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("h", "c1", "c2", "k1", "k2", "lefts", "rights", "places")
        for b in batches:
            out: list[tuple] = []
            for k1, k2, text in zip(*(c.to_pylist() for c in b.columns)):
                raw = _raw(text)
                at, h = anchors(np.frombuffer(raw, np.uint8), length, gram)
                if bitmap is not None:
                    keep = in_sieve(bitmap.value, h.view(np.int64))
                    at, h = at[keep], h[keep]
                own: dict[tuple, list] = {}
                for (p, left, right, c1, c2), x in zip(contexts(raw, at, length, gram), h.view(np.int64).tolist()):
                    own.setdefault((x, c1, c2), [k1, k2, left, right, []])[4].append(p)
                out += [(*key, *rest) for key, rest in own.items()]
            yield dict(zip(names, map(list, zip(*out)))) if out else {n: [] for n in names}

    schema = "h bigint, c1 bigint, c2 bigint, k1 bigint, k2 bigint, lefts int, rights int, places array<int>"
    return map_rows(texts.select("k1", "k2", "text"), run, schema, batch=500)


def _counted(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Gram hashes of anchors, with their number in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            raws = [np.frombuffer(_raw(t), np.uint8) for t in b.column(0).to_pylist()]
            found = [anchors(r, length, gram)[1] for r in raws]
            h, n = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]), return_counts=True)
            yield {"h": h.view(np.int64), "n": n}

    return map_rows(texts.select("text"), run, "h bigint, n bigint", batch=500)


# ---- groups of different contexts that share a gram ----


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def prefix_intervals(keys: list[bytes], members: list[int], least: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """Intervals of the sorted members that share ``least`` bytes or more, as (shared,
    members, number of the child each member is in), found by one scan with a stack."""
    order = sorted(members, key=keys.__getitem__)
    shared = [_common(keys[a], keys[b]) for a, b in zip(order, order[1:])]
    stack: list[list[int]] = []  # [shared, first position, borders between children ...]
    for i, s in enumerate([*shared, -1]):
        first = i
        while stack and stack[-1][0] > s:
            value, first, *borders = stack.pop()
            if value >= least:
                part = order[first : i + 1]
                child = [0] * len(part)
                for at in borders:
                    child[at + 1 - first] = 1
                for j in range(1, len(child)):
                    child[j] += child[j - 1]
                yield value, part, child
        if s < 0:
            break
        if stack and stack[-1][0] == s:
            stack[-1].append(i)
        else:
            stack.append([s, first, i])


def maximal_repeats(left: list[bytes], right: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from it on, members) of every maximal repeat of at
    least ``length`` bytes. ``left`` holds the bytes before the anchor in reverse."""
    reach = max(map(len, left))
    for ahead, part, child in prefix_intervals(right, list(range(len(right))), length - reach):
        side = dict(zip(part, child))
        for behind, group, _ in prefix_intervals(left, part, length - ahead):
            # diverse on the left by being an interval; on the right if it spans children
            if len({side[m] for m in group}) > 1:
                yield behind, ahead, group


_CONTEXT = "h bigint, c1 bigint, c2 bigint, before binary, after binary"
_COVER = "c1 bigint, c2 bigint, spans array<struct<a:int,b:int>>"


def _covers(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[dict]:
    """Spans around the anchor that a context shares with others; rows come sorted by ``h``."""

    def solve(rows: list[tuple]) -> list[tuple]:
        behinds, aheads = [0] * len(rows), [0] * len(rows)
        # all spans of a context hold its anchor, so their union is one span
        for behind, ahead, group in maximal_repeats([r[3] for r in rows], [r[4] for r in rows], length):
            for m in group:
                behinds[m] = max(behinds[m], behind)
                aheads[m] = max(aheads[m], ahead)
        spans = zip(rows, behinds, aheads)
        return [(r[1], r[2], [{"a": -x, "b": y}]) for r, x, y in spans if y]

    def columns(out: list[tuple]) -> dict:
        return dict(zip(("c1", "c2", "spans"), map(list, zip(*out)))) if out else {"c1": [], "c2": [], "spans": []}

    group: list[tuple] = []
    for b in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if group and row[0] != group[0][0]:
                out += solve(group) if len(group) > 1 else []
                group = []
            group.append(row)
        yield columns(out)
    if len(group) > 1:
        yield columns(solve(group))


def _window_covers(rows: DataFrame, length: int) -> DataFrame:
    """The same spans for grams with very many contexts, by counting their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("c1", "c2", "w1", "w2", "a")
        for b in batches:
            out = []
            for _, c1, c2, before, after in zip(*(c.to_pylist() for c in b.columns)):
                raw = before[::-1] + after
                for at in range(len(raw) - length + 1):
                    w = xxhash.xxh3_128_intdigest(raw[at : at + length])
                    out.append((c1, c2, _signed(w >> 64), _signed(w & (1 << 64) - 1), at - len(before)))
            yield dict(zip(names, map(list, zip(*out)))) if out else {n: [] for n in names}

    windows = map_rows(rows, run, "c1 bigint, c2 bigint, w1 bigint, w2 bigint, a int", batch=500)
    again = windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    hit = windows.join(again, ["w1", "w2"])
    span = F.struct("a", (F.col("a") + length).alias("b"))
    return hit.groupBy("c1", "c2").agg(F.collect_set(span).alias("spans"))  # at most one per start in a context


def repeated_spans(texts: Texts, length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``k1, k2, spans``: bytes of each distinct text that another place repeats (another
    text, or the same), as packed spans that may overlap, see ``joined_spans``."""
    counts = _counted(texts.rows(), length, gram).groupBy("h").agg(F.sum("n").alias("n"))
    again = written(counts.where("n > 1").select("h"), "anchors")
    bitmap = sieve(again, "h")
    placed = written(_anchored(texts.rows(), length, gram, bitmap).join(again, "h", "left_semi"), "places")
    # equal contexts are combined before the shuffle
    known = written(
        placed.groupBy("h", "c1", "c2").agg(
            F.sum(F.size("places")).alias("n"),
            F.min(F.struct("k1", "k2", F.col("places")[0].alias("place"), "lefts", "rights")).alias("at"),
        ),
        "contexts",
    )
    sizes = known.groupBy("h").count().where("count > 1")
    asked = known.join(sizes, "h").select("h", "c1", "c2", "at.*")
    asked = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c1", "c2", "place", "lefts", "rights")).alias("asked"))
    asked = written(asked, "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("h", "c1", "c2", "before", "after")
        for b in batches:
            out = []
            for text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = _raw(text)
                for w in wanted:
                    p = w["place"]
                    out.append((w["h"], w["c1"], w["c2"], raw[p - w["lefts"] : p][::-1], raw[p : p + w["rights"]]))
            yield dict(zip(names, map(list, zip(*out)))) if out else {n: [] for n in names}

    bytes_of = map_rows(texts.of(asked).select("text", "asked"), cut, _CONTEXT, batch=500)
    large = written(sizes.where(F.col("count") > group_limit).select("h"), "large-groups")
    some_large = not large.isEmpty()
    grouped = bytes_of.join(large, "h", "left_anti") if some_large else bytes_of
    grouped = grouped.repartition("h").sortWithinPartitions("h")
    covers = map_rows(grouped, lambda batches: _covers(batches, length), _COVER, batch=5000)
    if some_large:
        covers = covers.unionAll(_window_covers(bytes_of.join(large, "h", "left_semi"), length).select("c1", "c2", "spans"))
    whole = F.struct((-F.col("at.lefts")).alias("a"), F.col("at.rights").alias("b"))
    twice = known.where((F.col("n") > 1) & (F.col("at.lefts") + F.col("at.rights") >= length))
    covers = covers.unionAll(twice.select("c1", "c2", F.array(whole)))
    covers = covers.groupBy("c1", "c2").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # two rows at most
    hit = placed.select("c1", "c2", "k1", "k2", "places").join(covers, ["c1", "c2"])
    # a span is one number, start and end
    per_place = F.flatten(
        F.transform("places", lambda p: F.transform("spans", lambda s: (p + s["a"]).cast("long") * (1 << 32) + p + s["b"]))
    )
    # a text's spans meet in one row, no more of them than its bytes
    return hit.groupBy("k1", "k2").agg(F.flatten(F.collect_list(per_place)).alias("spans"))


def joined_spans(packed: np.ndarray) -> np.ndarray:
    """Packed spans as sorted rows (start, end) that lie apart."""
    packed = np.unique(packed)
    start, end = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return np.stack([start[new], end[np.append(new[1:], True)]], axis=1)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Per document: bytes, bytes removed, runs removed, digest of the rest."""
    texts = Texts(docs)
    spans = written(repeated_spans(texts, length, gram, group_limit), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            removed, runs, digests = [], [], []
            for text, packed in zip(b.column(2).to_pylist(), b.column(3)):
                raw, at, kept = _raw(text), 0, hashlib.sha256()
                own = joined_spans(packed.values.to_numpy())
                for x, y in own.tolist():
                    kept.update(raw[at:x])
                    at = y
                kept.update(raw[at:])
                removed.append(int((own[:, 1] - own[:, 0]).sum()))
                runs.append(len(own))
                digests.append(kept.hexdigest())
            yield {"k1": b.column(0), "k2": b.column(1), "gone": removed, "runs": runs, "rest": digests}

    cuts = map_rows(
        texts.of(spans).select("k1", "k2", "text", "spans"), cut, "k1 bigint, k2 bigint, gone bigint, runs bigint, rest string", batch=500
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", *text_key(), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("own")
    )
    rows = rows.join(texts.copies, ["k1", "k2"], "left").join(cuts, ["k1", "k2"], "left")
    copied = (F.col("count") > 1) & (F.col("n_bytes") >= length)  # all of it stands elsewhere too
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("gone", zero)).alias("n_removed"),
        F.when(copied, one).otherwise(F.coalesce("runs", zero)).alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("rest", "own")).alias("kept_sha256"),
    )
