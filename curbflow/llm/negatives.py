"""Hard negatives of anchor vectors, found through stored angles.

Every row keeps the angles between its vector and a few reference directions. The angle
between two vectors lies between the difference and the sum of their angles to any
direction, so a pair's cosine lies in an interval; times both norms, and widened by more
than the rounding, it bounds the pair's score. Rows with similar angles make a tile, and an
anchor is scored against a tile only where that interval meets a window that is still
wanted. Bounds for single pairs would cost many times their scores, which come as products
of matrices: of float32 where every sum stays below 2**24, else of doubles or longs. Scores
are inner products of whole numbers, so the results are exact.

Anchors and rows meet in the cells of a grid: a row goes to one cell of every anchor group,
an anchor to one cell of every row group. Groups are dealt by row number, so no label and
no group of equal vectors makes a cell large, and a cell returns no more than the few best
rows of each anchor. A cell holds its anchors and reads its rows in parts, so the size of the
anchors alone bounds its memory; the number of cells follows from that and from the pairs.

Cases: a row with a null label, a null vector or a null or non-finite component takes no
part. A null id sorts after all others and is no anchor in the query. Missing components at
the end of a shorter vector count as zero; so an empty vector scores zero. Every row
counts for itself, also one that repeats another: a copy of an anchor is another row, and
each copy is an anchor. Ties beyond the id are between equal rows only. An empty table gives
an empty result. Components beyond 2**31 after scaling, or scores that may not fit a long,
raise an error. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.common import map_rows, written

REFERENCES = 16
SCALE = 256
TILE = 1024  # rows bounded and scored at a time
BLOCK = 256  # anchors scored at a time
GROUP = 2048  # anchors whose best rows are kept together
CELL_PAIRS = 200_000_000_000  # pairs of one task
CELL_BYTES = 1 << 27  # a cell's anchors with their best rows
PART_BYTES = 1 << 24  # components of the rows that a cell holds at a time, as float32
SLACK = 2e-6  # of an angle: far beyond what float32 angles and arccos lose
LAST = (1 << 63) - 1  # sorts a null id last

_PAIR = "a bigint, slot int, id bigint, x bigint, score bigint"


def whole_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, embedding, label, anchor`` to numbered rows with whole components ``q``,
    four bytes each, that lie within ``most``; rows that take no part go."""
    numbered = rows.where("label is not null and embedding is not null").select(
        F.monotonically_increasing_id().alias("x"), "vec_id", "label", "anchor", "embedding"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            lists = b.column(4)
            length = np.diff(lists.offsets.to_numpy())
            part = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
            finite = np.isfinite(part)
            owner = np.repeat(np.arange(b.num_rows), length)
            good = np.bincount(owner[~finite], minlength=b.num_rows) == 0
            part = part[good[owner]]
            most = int(np.abs(part).max(initial=0))
            if most >= 2**31:
                raise ValueError("a component is too large for scores that fit a long")
            kept = b.filter(pa.array(good))
            yield {
                "x": kept.column(0), "vec_id": kept.column(1), "label": kept.column(2), "anchor": kept.column(3),
                "q": _binary(part.astype("<i4"), length[good]), "most": np.full(kept.num_rows, most),
            }

    return map_rows(numbered, run, "x bigint, vec_id bigint, label bigint, anchor boolean, q binary, most bigint")


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Values that stand end to end as binaries of so many values each."""
    ends = np.concatenate([[0], values.itemsize * np.cumsum(sizes)]).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array | pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of ``_binary``."""
    if not len(column):
        return np.empty(0, kind), np.empty(0, np.int64)
    whole = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    _, ends, data = whole.buffers()
    ends = np.frombuffer(ends, "<i8" if pa.types.is_large_binary(whole.type) else "<i4")[whole.offset :][: len(whole) + 1]
    flat = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].view(kind)
    return flat, np.diff(ends).astype(np.int64) // flat.itemsize


def matrix(flat: np.ndarray, sizes: np.ndarray, width: int = 0, kind: type = np.float64) -> np.ndarray:
    """Vectors that stand end to end as rows, short ones filled up with zeros."""
    width = max(width, int(sizes.max(initial=0)))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(kind)
    out = np.zeros((len(sizes), width), kind)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(flat.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def with_angles(vectors: DataFrame, references: int = REFERENCES, kind: str = "<i4") -> DataFrame:
    """Adds ``angles`` to the reference directions, as float32, and makes the components of
    ``kind``. The directions are the vectors of the rows with the smallest hashes: a fixed
    number, whatever the table."""
    picked = vectors.where("length(q) > 0").orderBy(F.xxhash64("q"), "x").limit(references).select("q").toArrow()
    directions = [raw for raw in picked["q"].to_pylist() if any(raw)]
    known = np.frombuffer(b"".join(directions), "<i4"), np.array([len(r) // 4 for r in directions], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            flat, sizes = _values(b.column(4), "<i4")
            longest = int(max(sizes.max(initial=0), known[1].max(initial=0)))
            v, d = matrix(flat, sizes, longest), matrix(*known, longest)
            scale = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(d, axis=1)[None, :]
            cosine = np.divide(v @ d.T, scale, out=np.zeros(scale.shape), where=scale > 0)
            angles = np.arccos(np.clip(cosine, -1, 1)).astype("<f4")
            stored = _binary(angles, np.full(len(angles), angles.shape[1]))
            q = _binary(flat.astype(kind), sizes)
            yield {**{n: b.column(n) for n in ("x", "vec_id", "label", "anchor")}, "q": q, "angles": stored}

    return map_rows(vectors, run, "x bigint, vec_id bigint, label bigint, anchor boolean, q binary, angles binary")


class Rows:
    """Rows of a cell as arrays. Components are float32 where inner products of such rows,
    and all their partial sums, are below 2**24 and so exact."""

    def __init__(self, t: pa.Table, kind: str = "<i4"):
        self.x = t["x"].to_numpy()
        self.id = t["vec_id"].fill_null(LAST).to_numpy()
        self.label = t["label"].to_numpy()
        flat, sizes = _values(t["q"], kind)
        self.norm, starts = np.zeros(len(sizes)), np.cumsum(sizes) - sizes
        for at in range(0, len(sizes), TILE):
            own = slice(at, at + TILE)
            v = matrix(flat[starts[at] :][: sizes[own].sum()], sizes[own])
            self.norm[own] = np.linalg.norm(v, axis=1)
        self.q = matrix(flat, sizes, kind=np.float32 if self.norm.max(initial=0) < 4095 else np.float64)
        flat, sizes = _values(t["angles"], "<f4")
        self.angles = flat.reshape(len(sizes), -1 if flat.size else 0)

    def tiles(self) -> Iterator[np.ndarray]:
        """Rows of one label with similar angles, some hundred at a time; labels of few rows
        share a tile."""
        if self.angles.shape[1]:
            nearest = self.angles.argmin(axis=1)
            order = np.lexsort((self.id, self.angles.min(axis=1), nearest, self.label))
        else:
            order = np.lexsort((self.id, self.label))
        at = 0
        for edge in [*(np.flatnonzero(np.diff(self.label[order])) + 1).tolist(), len(order)]:
            if edge - at >= TILE // 8 or at < edge == len(order):
                yield from np.array_split(order[at:edge], -(-(edge - at) // TILE))
                at = edge


def score_bounds(angles, norm, low, high, norm_low, norm_high) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers that no score of a pair can lie beyond.

    ``angles`` (anchors × directions) and ``norm`` (anchors) meet targets whose angles lie
    in ``low .. high`` (targets × directions) and norms in ``norm_low .. norm_high``.
    """
    shape = (len(norm), len(norm_low))
    nearest, farthest = np.zeros(shape), np.full(shape, math.pi)
    for k in range(angles.shape[1]):
        own = angles[:, k, None]
        np.maximum(nearest, np.maximum(low[None, :, k] - own, own - high[None, :, k]), out=nearest)
        both_low, both_high = own + low[None, :, k], own + high[None, :, k]
        # the sum, or the way round the other side; largest where they meet
        most = np.where(both_low > math.pi, 2 * math.pi - both_low, np.minimum(both_high, math.pi))
        np.minimum(farthest, most, out=farthest)
    up = np.cos(np.clip(nearest - SLACK, 0, math.pi))
    down = np.cos(np.clip(farthest + SLACK, 0, math.pi))
    largest, smallest = norm[:, None] * norm_high[None, :], norm[:, None] * norm_low[None, :]
    hi = np.where(up > 0, largest, smallest) * up
    lo = np.where(down > 0, smallest, largest) * down
    give = 1 + largest * 1e-9
    return np.floor(lo - give), np.ceil(hi + give)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole inner products of rows; a shorter vector counts as filled with zeros."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if a.dtype == b.dtype == np.float32:  # see Rows
        return a @ b.T
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    if most < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if most >= 2**63:
        raise ValueError("scores may not fit a long")
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The best few rows of each anchor and slot, highest score first, then smallest id."""

    def __init__(self, floor: np.ndarray, cap: np.ndarray, keep: int):
        self.keep, self.slots = keep, floor.shape[1]
        self.least, self.cap = floor.copy(), cap  # anchors × slots: what a score must reach, and not exceed, to matter
        self.last = np.full(floor.shape, LAST)  # and the id that one which just reaches it must not exceed
        self.pool = [np.empty(0, np.int64)] * 4  # anchor × slot, id, x, score
        self.new: list[list[np.ndarray]] = []

    def add(self, anchor: np.ndarray, ids: np.ndarray, x: np.ndarray, score: np.ndarray) -> None:
        for s in range(self.slots):
            least = self.least[anchor, s]
            fits = (score >= least) & (score <= self.cap[anchor, s]) & ((score > least) | (ids <= self.last[anchor, s]))
            self.new.append([anchor[fits] * self.slots + s, ids[fits], x[fits], score[fits]])
        if sum(len(n[0]) for n in self.new) > max(1000, len(self.pool[0])):
            self.merge()

    def merge(self) -> None:
        pool = [np.concatenate(p) for p in zip(self.pool, *self.new)]
        self.new = []
        key, ids, x, score = pool
        most = score.max(initial=0)
        span = int(most) - int(score.min(initial=0)) + 1
        if span * int(key.max(initial=0) + 1) < 2**62:  # one number to sort by, few ties
            place = key * span + (most - score)
            order = np.argsort(place)
            tie = np.diff(place[order]) == 0
            at = np.flatnonzero(np.r_[tie, False] | np.r_[False, tie])
            order[at] = order[at][np.lexsort((x[order[at]], ids[order[at]], place[order[at]]))]
        else:
            order = np.lexsort((x, ids, -score, key))
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
        self.pool = [p[order[rank < self.keep]] for p in pool]
        last = order[rank == self.keep - 1]
        self.raise_to(pool[0][last], score[last], ids[last])

    def raise_to(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray | int = LAST) -> None:
        """So many rows as are kept have at least this score, and up to this id where they have just this."""
        least, last = self.least.reshape(-1), self.last.reshape(-1)
        last[key] = np.where(score > least[key], ids, np.where(score == least[key], np.minimum(ids, last[key]), last[key]))
        least[key] = np.maximum(least[key], score)


class Tiles:
    """The tiles of some rows, with their bounds."""

    def __init__(self, rows: Rows):
        self.rows, self.each = rows, list(rows.tiles())
        self.q = [rows.q[t] for t in self.each]
        angles = [rows.angles[t] for t in self.each]
        self.low, self.high = (np.array([getattr(a, f)(axis=0) for a in angles], dtype=np.float64) for f in ("min", "max"))
        self.norm_low, self.norm_high = (np.array([getattr(rows.norm[t], f)() for t in self.each]) for f in ("min", "max"))
        self.label_low, self.label_high = (np.array([rows.label[t[i]] for t in self.each]) for i in (0, -1))
        self.first_id = [rows.id[t].min() for t in self.each]


class Group:
    """Some anchors of a cell, and their best rows so far."""

    def __init__(self, anchors: Rows, some: np.ndarray, floor: np.ndarray, cap: np.ndarray, keep: int, same: bool):
        self.same = same
        self.x, self.label, self.norm = anchors.x[some], anchors.label[some], anchors.norm[some]
        self.q, self.angles = anchors.q[some], anchors.angles[some]
        self.best = Best(floor[some], cap[some], keep)
        self.hits: list[tuple] = []
        self.n_hits = 0

    def wanted(self, tiles: Tiles) -> tuple[np.ndarray, np.ndarray]:
        """Tiles of a fitting label, and which anchors (anchors × tiles) may want rows of them."""
        of = slice(None)
        if self.same:
            of = np.flatnonzero((tiles.label_high >= self.label.min()) & (tiles.label_low <= self.label.max()))
        low, high = tiles.label_low[of], tiles.label_high[of]
        own = self.label[:, None]
        fit = (low <= own) & (own <= high) if self.same else (low != own) | (own != high)
        lo, hi = score_bounds(
            self.angles.astype(np.float64), self.norm, tiles.low[of], tiles.high[of], tiles.norm_low[of], tiles.norm_high[of]
        )
        meets = np.zeros(fit.shape, dtype=bool)
        for s in range(self.best.slots):
            meets |= (hi >= self.best.least[:, s, None]) & (lo <= self.best.cap[:, s, None])
        return np.arange(len(tiles.each))[of], fit & meets

    def search(self, tiles: Tiles) -> None:
        of, wanted = self.wanted(tiles)
        for k, t in enumerate(of):
            mine = np.flatnonzero(wanted[:, k])
            if not len(mine):
                continue
            # an equal score matters with a smaller id only
            reach = self.best.least + (self.best.last < tiles.first_id[t])
            for at in range(0, len(mine), BLOCK):
                block = mine[at : at + BLOCK]
                whole = block[-1] - block[0] == len(block) - 1
                score = inner_products(self.q[block[0] : block[-1] + 1] if whole else self.q[block], tiles.q[t])
                self.take(block, reach[block], score, tiles.rows, tiles.each[t])
        self.settle(tiles.rows)

    def take(self, block: np.ndarray, reach: np.ndarray, score: np.ndarray, rows: Rows, tile: np.ndarray) -> None:
        """Note the rows of a tile whose scores matter to a block of anchors."""
        reach = reach.astype(score.dtype)
        near = np.flatnonzero(score.max(axis=1) >= reach.min(axis=1))
        if not len(near):
            return
        block, score, reach = block[near], score[near], reach[near]
        width = score.shape[1]
        hit = np.empty((len(near), -(-width // 8) * 8), dtype=bool)  # looked through by eights
        hit[:, width:] = False
        np.greater_equal(score, reach.min(axis=1, keepdims=True), out=hit[:, :width])
        eights = np.flatnonzero(hit.view(np.uint64))
        if len(eights) > hit.size // 150:
            # many lie between or beyond the windows of the slots
            hit[:, :width] = False
            cap = self.best.cap[block].astype(score.dtype)
            for s in range(self.best.slots):
                hit[:, :width] |= (score >= reach[:, s, None]) & (score <= cap[:, s, None])
            many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 8 * self.best.keep)
            if len(many):
                hit[many, :width] &= self.sift(block[many], score[many], rows, tile)
            eights = np.flatnonzero(hit.view(np.uint64))
        k, bit = np.nonzero(hit.reshape(-1, 8)[eights])
        i, j = np.divmod(8 * eights[k] + bit, hit.shape[1])
        self.hits.append((block[i], tile[j], score[i, j].astype(np.int64)))
        self.n_hits += len(i)
        if self.n_hits > 2 * max(5000, len(self.x) * self.best.slots * self.best.keep):
            self.settle(rows)

    def sift(self, block: np.ndarray, score: np.ndarray, rows: Rows, tile: np.ndarray) -> np.ndarray:
        """Raise what the scores of some anchors must reach to the few best of this tile; which do."""
        best, lowest = self.best, score.dtype.type(-LAST)
        fit = ((self.label[block, None] == rows.label[tile]) == self.same) & (self.x[block, None] != rows.x[tile])
        for s in range(best.slots if len(tile) >= best.keep else 0):
            own = np.where(fit & (score <= best.cap[block, s, None].astype(score.dtype)), score, lowest)
            enough = np.partition(own, -best.keep, axis=1)[:, -best.keep]
            ok = np.flatnonzero(enough > lowest)
            best.raise_to(block[ok] * best.slots + s, enough[ok].astype(np.int64))
        return fit & (score >= best.least[block].min(axis=1)[:, None].astype(score.dtype))

    def settle(self, rows: Rows) -> None:
        if not self.hits:
            return
        anchor, row, score = (np.concatenate(h) for h in zip(*self.hits))
        self.hits, self.n_hits = [], 0
        fit = ((self.label[anchor] == rows.label[row]) == self.same) & (self.x[anchor] != rows.x[row])
        anchor, row, score = anchor[fit], row[fit], score[fit]
        self.best.add(anchor, rows.id[row], rows.x[row], score)


class Search:
    """The ``keep`` best rows of the same (or of another) label per anchor and slot with
    ``floor <= score <= cap`` (anchors × slots), of rows that come in parts. A row is not its
    own partner."""

    def __init__(self, anchors: Rows, floor: np.ndarray, cap: np.ndarray, keep: int, same: bool):
        order = np.lexsort((anchors.norm, anchors.label))
        self.groups = [Group(anchors, order[at : at + GROUP], floor, cap, keep, same) for at in range(0, len(order), GROUP)]

    def add(self, rows: Rows) -> None:
        if len(rows.x):
            tiles = Tiles(rows)
            for g in self.groups:
                g.search(tiles)

    def found(self) -> Iterator[dict]:
        for g in self.groups:
            g.best.merge()
            key, ids, x, score = g.best.pool
            yield {"a": g.x[key // g.best.slots], "slot": (key % g.best.slots).astype(np.int32), "id": ids, "x": x, "score": score}


def search_cell(anchors: Rows, rows: Rows, floor: np.ndarray, cap: np.ndarray, keep: int, same: bool) -> Search:
    """A search of rows that come in one part."""
    search = Search(anchors, floor, cap, keep, same)
    search.add(rows)
    return search


def search_cells(batches: Iterable[pa.RecordBatch], begin: Callable[[pa.Table], Search], kind: str) -> Iterator[dict]:
    """Batches sorted by ``cell`` and ``row``, with the anchors (``row`` is false) of a cell
    before its rows, to what the search that ``begin`` makes of the anchors finds. Components
    are of ``kind``."""
    cell, search, anchors, held, size = None, None, [], [], 0

    def part() -> Rows:
        return Rows(pa.Table.from_batches(held), kind)

    for b in batches:
        code = 2 * b.column("cell").to_numpy().astype(np.int64) + b.column("row").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            if cell != code[s] // 2:
                if search and held:
                    search.add(part())
                if search:
                    yield from search.found()
                cell, search, anchors, held, size = code[s] // 2, None, [], [], 0
            some = b.slice(s, e - s)
            if not code[s] % 2:
                anchors.append(some)
                continue
            if anchors:
                search, anchors = begin(pa.Table.from_batches(anchors)), []
            if search:
                held.append(some)
                size += some.column("q").nbytes * 4 // np.dtype(kind).itemsize
                if size >= PART_BYTES:
                    search.add(part())
                    held, size = [], 0
    if search and held:
        search.add(part())
    if search:
        yield from search.found()


def _grid(rows: DataFrame, anchors: DataFrame, begin, kind: str, n_rows: int, n_anchors: int, anchor_bytes: int) -> DataFrame:
    """What the searches that ``begin(anchor table)`` makes find over every pair of an anchor
    and a row once."""
    cells = max(-(-n_rows * n_anchors // CELL_PAIRS), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    # as many groups of each as move the fewest rows, counting what is found as two anchors
    anchor_groups = max(1, round(math.sqrt(3 * cells * n_anchors / max(n_rows, 1))), -(-n_anchors * anchor_bytes // CELL_BYTES))
    row_groups = -(-cells // anchor_groups)

    def group(n: int) -> Column:
        return F.pmod(F.xxhash64("x"), F.lit(n)).cast("int")

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(side: DataFrame, is_row: bool, ga: Column, gr: Column) -> DataFrame:
        side = side.withColumn("ga", ga).withColumn("gr", gr)
        return side.select((F.col("ga") * row_groups + F.col("gr")).alias("cell"), F.lit(is_row).alias("row"), *rest(side))

    def rest(side: DataFrame) -> list[str]:
        return [c for c in side.columns if c not in ("anchor", "ga", "gr")]

    both = dealt(anchors, False, group(anchor_groups), numbers(row_groups)).unionByName(
        dealt(rows, True, numbers(anchor_groups), group(row_groups)), allowMissingColumns=True
    )
    met = both.repartitionById(anchor_groups * row_groups, "cell").sortWithinPartitions("cell", "row")
    return map_rows(met, lambda batches: search_cells(batches, begin, kind), _PAIR)


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    """The best of all cells, with their rank from 1."""
    order = Window.partitionBy("a", "slot").orderBy(F.desc("score"), "id", "x")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _id(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(LAST))


def mine(
    rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, references: int = REFERENCES
) -> DataFrame:
    """Hard negatives of the rows with ``anchor``, of ``vec_id, embedding, label, anchor``.

    An anchor's positives are its best ``positives`` rows of the same label. For each, the
    best ``negatives`` rows of other labels whose score is between ``low`` and ``high``
    hundredths of the positive's. Columns ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``; anchors without any such row have none.
    """
    vectors = written(whole_vectors(rows), "whole-vectors")
    n_rows, n_anchors, longest, most = vectors.agg(F.count("*"), F.count_if("anchor"), F.max(F.length("q")), F.max("most")).first()
    kind = "<i2" if (most or 0) < 2**15 else "<i4"
    stored = written(with_angles(vectors, references, kind), "angles")
    anchors = stored.where("anchor")

    def searched(side: DataFrame, begin, slots: int, keep: int) -> DataFrame:
        # components twice, angles, numbers; the best rows while they are merged
        each = 2 * (longest or 0) + 4 * references + 64 + slots * (24 + 40 * keep)
        return _ranked(_grid(stored, side, begin, kind, n_rows, n_anchors, each), keep)

    def nearest(t: pa.Table) -> Search:
        floor = np.full((t.num_rows, 1), -LAST, np.int64)
        return Search(Rows(t, kind), floor, np.full_like(floor, LAST), positives, same=True)

    firsts = searched(anchors, nearest, 1, positives).select("a", "rank", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    firsts = written(firsts, "positives")
    # whole bounds of the scores wanted: rounded up below, down above
    windows = firsts.where("positive_score >= 0").select(
        "a",
        F.struct(
            "rank",
            F.expr(f"({low} * positive_score + 99) div 100").alias("floor"),
            F.expr(f"{high} * positive_score div 100").alias("cap"),
        ).alias("w"),
    )
    windows = windows.groupBy("a").agg(F.sort_array(F.collect_list("w")).alias("windows"))
    seeking = anchors.join(windows.withColumnRenamed("a", "x"), "x")

    def between(t: pa.Table) -> Search:
        floor = np.full((t.num_rows, positives), LAST, np.int64)  # unused slots want nothing
        cap = np.full((t.num_rows, positives), -LAST, np.int64)
        own = np.repeat(np.arange(t.num_rows), pc.list_value_length(t["windows"]).to_numpy())
        wanted = pc.list_flatten(t["windows"])
        slot, low, high = (pc.struct_field(wanted, f).to_numpy() for f in ("rank", "floor", "cap"))
        floor[own, slot - 1], cap[own, slot - 1] = low, high
        return Search(Rows(t, kind), floor, cap, negatives, same=False)

    chosen = searched(seeking, between, positives, negatives).select(
        "a", (F.col("slot") + 1).alias("slot"), "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score")
    )
    named = firsts.withColumnRenamed("rank", "slot").join(chosen, ["a", "slot"])
    named = named.join(anchors.select(F.col("x").alias("a"), F.col("vec_id").alias("anchor_id")), "a")
    return named.select(
        "anchor_id", _id("positive").alias("positive_id"), "rank", _id("negative").alias("negative_id"), "positive_score", "negative_score"
    )
