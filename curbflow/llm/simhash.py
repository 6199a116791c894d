"""Near duplicates by SimHash, with tables of distances to reference fingerprints.

Fingerprints that differ in at most four of 64 bits agree in at least two of six blocks.
Each distinct fingerprint is sent once per pair of blocks, with a precomputed table of
its distances to sixteen reference fingerprints. Within a bucket a pair is discarded when
any coordinate of the tables differs by more than four, which the triangle inequality
allows; survivors are compared bit by bit. A bucket links its members by a spanning
forest, not by all pairs: a fingerprint that is already reached is not compared again.

Buckets above ``bucket_limit`` are divided into parts and every two parts are compared by
a task of their own, so no task holds more than the limit, and no pair is left out.

``near_texts`` serves similarities such as 0.8, where 64 bits would differ in a dozen
places: it takes the minima of the distinct shingles under 256 hashes, a bit of each as
fingerprint, and joins through 32 runs of four whole minima. A pair at 0.8 shares a run but
for one in 10 million, and lies within the radius, five deviations wide, but for one in 100,000.
Tables, buckets and links are the same, but these links only propose groups: within a
group the exact Jaccard similarity of the shingle sets decides, for all pairs that are
not connected already. A large group is divided into parts that each
meet the group's first text; what that does not connect meets all parts.

Cases: a null or empty text has fingerprint zero and is linked like any other. A text of
fewer words than a shingle is one shingle. Repeated rows are each answered. A null
``doc_id`` never names a component; one of null ids alone has none.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import in_sieve, map_rows, ship, sieve, text_key, written
from curbflow.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
BUCKET_LIMIT = 40_000
_BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # first bit, bits
_PIVOTS = [xxhash.xxh64_intdigest(str(i), 7) for i in range(16)]


def shingle_hashes(text: str, size: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII space
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def _majority(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes; as a signed number."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str, size: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, size)
    return _majority(hashes) if len(hashes) else 0


_MIXERS = np.array([xxhash.xxh64_intdigest(f"m{i}") | 1 for i in range(256)], np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of a set under each of 256 mixes; two sets agree in one with
    the probability of their Jaccard similarity, whatever their sizes."""
    out = np.full(len(_MIXERS), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1000):
        part = hashes[at : at + 1000, None] * _MIXERS
        out = np.minimum(out, (part ^ (part >> np.uint64(32))).min(axis=0))
    return out


def wide_fingerprint(least: np.ndarray) -> np.ndarray:
    """A bit of every minimum, as signed numbers."""
    return np.packbits((least & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.int64)


def bucket_runs(least: np.ndarray, length: int) -> list[int]:
    """Names of 32 runs of ``length`` minima."""
    runs = least[: RUNS * length].reshape(RUNS, length)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(runs)]


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b.column(0), "fp": [fingerprint(t or "", size) for t in b.column(1).to_pylist()]}

    return map_rows(docs.select("doc_id", "text"), run, "doc_id bigint, fp bigint")


def _tables() -> list:
    """Distances to the references, eight to a number, a byte each."""

    def packed(pivots: list[int]):
        out = F.lit(0).cast("long")
        for i, p in enumerate(pivots):
            signed = p - (1 << 64) if p >> 63 else p
            distance = F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed).cast("long"))).cast("long")
            out = out.bitwiseOR(F.shiftleft(distance, 8 * i))
        return out

    return [packed(_PIVOTS[:8]).alias("near"), packed(_PIVOTS[8:]).alias("far")]


def _bucketed(prints: DataFrame) -> DataFrame:
    """Each fingerprint once per pair of blocks."""

    def block(i: int):
        at, n = _BLOCKS[i]
        return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))

    pairs = [(i, j) for i in range(6) for j in range(i)]
    keys = [
        F.shiftleft(F.lit(k).cast("long"), 24).bitwiseOR(F.shiftleft(block(i), 11)).bitwiseOR(block(j))
        for k, (i, j) in enumerate(pairs)
    ]
    return prints.select(F.col("fp").alias("id"), "fp", *_tables(), F.explode(F.array(*keys)).alias("bucket"))


def _divided(rows: DataFrame, limit: int) -> DataFrame:
    """Rows with ``part``: 0, or for large buckets one row per pair of parts."""
    large = written(rows.groupBy("bucket").count().where(F.col("count") > limit), "large-buckets")
    if large.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long"))
    rows = rows.join(large, "bucket", "left")
    parts = F.ceil(F.col("count") * 2 / limit).cast("long")
    own = F.pmod(F.xxhash64("id", F.lit(3)), parts)
    low, high = F.least(own, F.col("other")), F.greatest(own, F.col("other"))
    split = (
        rows.where("count is not null")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .withColumn("part", low * parts + high)
    )
    plain = rows.where("count is null").withColumn("part", F.lit(0).cast("long"))
    return plain.unionByName(split.select(*plain.columns)).drop("count")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # unsigned, as numpy counts the bits of a negative number's absolute value
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _close(fp: np.ndarray, tables: np.ndarray, one: int, others: np.ndarray, radius: int) -> np.ndarray:
    """Members of ``others`` within ``radius`` of ``one``: tables first, then bits."""
    gap = np.abs(tables[others] - tables[one]).max(axis=1)
    left = others[gap <= radius]
    return left[_apart(fp[left], fp[one]) <= radius]


def spanning_links(fp: np.ndarray, tables: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A link from every member to the first of its component within the bucket."""
    links: list[tuple[int, int]] = []
    unseen = np.arange(len(fp))
    while len(unseen) > 1:
        root, unseen = unseen[0], unseen[1:]
        front = [root]
        while front and len(unseen):
            found = _close(fp, tables, front.pop(), unseen, radius)
            if len(found):
                links += [(int(root), int(f)) for f in found]
                unseen = np.setdiff1d(unseen, found, assume_unique=True)
                front += found.tolist()
    return links


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[dict]:
    """Links within each bucket of rows sorted by bucket and part."""

    def links(keys: np.ndarray, ids: np.ndarray, fp: np.ndarray, tables: np.ndarray) -> dict:
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts = np.concatenate([[0], edges])
        ends = np.concatenate([edges, [len(keys)]])
        sizes = ends - starts
        two = starts[sizes == 2]  # by far the most, all at once
        two = two[np.abs(tables[two] - tables[two + 1]).max(axis=1, initial=0) <= radius]
        two = two[_apart(fp[two], fp[two + 1]) <= radius]
        a, b = ids[two].tolist(), ids[two + 1].tolist()
        for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
            for x, y in spanning_links(fp[s:e], tables[s:e], radius):
                a.append(int(ids[s + x]))
                b.append(int(ids[s + y]))
        return {"a": a, "b": b}

    kept: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, part, ids, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if len(rest) == 2:  # binary columns
            fp = np.frombuffer(b"".join(rest[0]), np.int64).reshape(len(ids), -1)
            tables = np.frombuffer(b"".join(rest[1]), np.int16).reshape(len(ids), -1)
        else:
            fp = np.ascontiguousarray(rest[0]).reshape(-1, 1)
            near = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) for x in rest[1:]]
            tables = np.concatenate(near, axis=1).astype(np.int16)
        now = (np.stack([bucket, part], axis=1), ids, fp, tables)
        if kept is not None:
            now = tuple(np.concatenate(x) for x in zip(kept, now))
        keys = now[0]
        whole = np.flatnonzero((keys != keys[-1]).any(axis=1))
        cut = whole[-1] + 1 if len(whole) else 0  # the last bucket may go on
        if cut:
            yield links(*(x[:cut] for x in now))
        kept = tuple(x[cut:] for x in now)
    if kept is not None:
        yield links(*kept)


def _linked(rows: DataFrame, columns: tuple[str, ...], radius: int, bucket_limit: int) -> DataFrame:
    rows = _divided(rows, bucket_limit).select("bucket", "part", "id", *columns)
    rows = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "id")
    return map_rows(rows, lambda batches: _bucket_links(batches, radius), "a bigint, b bigint", batch=1 << 20)


def near_links(prints: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints within ``radius`` of each other."""
    if radius > 4:
        raise ValueError("six blocks taken by two find differences of up to four bits")
    return _linked(_bucketed(prints), ("fp", "near", "far"), radius, bucket_limit)


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """``doc_id``, ``fingerprint`` in hex and ``component_id``, the smallest id reachable."""
    known = written(fingerprints(docs, size), "fingerprints")
    # copies share a fingerprint: one row for all of them, however many
    prints = written(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(near_links(prints, radius, bucket_limit))
    labelled = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(least, "root").select("fp", "component_id")
    return known.join(labelled, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


RUNS = 32
RUN_MISSES = 1e-6  # pairs at the wanted similarity that may share no run


def run_length(similarity: float) -> int:
    """The longest run, up to four, by which hardly any pair of this similarity is missed."""
    return max([n for n in (1, 2, 3, 4) if (1 - similarity**n) ** RUNS <= RUN_MISSES], default=1)


def similarity_radius(similarity: float, bits: int) -> int:
    """Bits that differ between sets of this Jaccard similarity, and five deviations more."""
    share = (1 - similarity) / 2
    return math.ceil(bits * share + 5 * (bits * share * (1 - share)) ** 0.5)


def near_texts(
    docs: DataFrame, similarity: float = 0.8, size: int = 5, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """``k1, root``: texts by key, with the representative of the group of texts that
    are similar to each other, directly or through others. Texts alone are left out."""
    words = len(_MIXERS) // 64
    pivots = np.array([xxhash.xxh64_intdigest(f"{i}.{j}", 7) for i in range(16) for j in range(words)], np.uint64)
    pivots = pivots.view(np.int64).reshape(16, words)
    length = run_length(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            least = [minima(np.unique(shingle_hashes(t, size))) for t in b.column(1).to_pylist()]
            prints = [wide_fingerprint(x) for x in least]
            tables = [_apart(pivots, p).astype(np.int16).tobytes() for p in prints]
            runs = [bucket_runs(x, length) for x in least]
            yield {"id": b.column(0), "fp": [p.tobytes() for p in prints], "tables": tables, "buckets": runs}

    texts = docs.select(text_key()[0].alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "id bigint, fp binary, tables binary, buckets array<bigint>"
    prints = map_rows(texts, run, schema, batch=500).groupBy("id").agg(*(F.first(c).alias(c) for c in ("fp", "tables", "buckets")))
    rows = written(prints, "prints").select("id", "fp", "tables", F.explode("buckets").alias("bucket"))
    links = _linked(rows, ("fp", "tables"), similarity_radius(similarity, 64 * words), bucket_limit)
    groups = written(components(links).select(F.col("node").alias("id"), F.col("root").alias("bucket")), "proposed")
    return components(_exact_links(_shingle_sets(texts, groups, size), similarity)).withColumnRenamed("node", "k1")


def _shingle_sets(texts: DataFrame, groups: DataFrame, size: int) -> DataFrame:
    """``bucket, id, shingles`` of the texts in a proposed group."""
    bitmap = sieve(groups, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            b = b.filter(pa.array(in_sieve(bitmap.value, b.column(0).to_numpy())))
            sets = [np.unique(shingle_hashes(t, size)).tobytes() for t in b.column(1).to_pylist()]
            yield {"id": b.column(0), "shingles": sets}

    sets = map_rows(texts, run, "id bigint, shingles binary", batch=500).groupBy("id").agg(F.first("shingles").alias("shingles"))
    return written(sets.join(groups, "id").select("bucket", "id", "shingles"), "shingles")


PART_ROWS = (128, 20_000)  # texts of a part of a group: from, and at most, above 64 parts
_PARTS = 64


def _parts(n: Column) -> Column:
    few, most = (F.ceil(n / rows).cast("long") for rows in PART_ROWS)
    return F.greatest(F.least(few, F.lit(_PARTS).cast("long")), most)


def _numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _exact_links(members: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links that connect all texts of a group (``bucket``, its smallest id) whose
    shingle sets are similar. A pair is left out only where both are connected already."""

    def linked(rows: DataFrame) -> DataFrame:
        rows = rows.select("bucket", "part", "id", "shingles").repartition("bucket", "part")
        rows = rows.sortWithinPartitions("bucket", "part", "id")
        return map_rows(rows, lambda batches: _set_links(batches, similarity), "a bigint, b bigint")

    large = members.groupBy("bucket").count().where(F.col("count") > PART_ROWS[0])
    large = written(large.select("bucket", _parts(F.col("count")).alias("parts")), "large-groups")
    if large.isEmpty():
        return linked(members.withColumn("part", F.lit(0).cast("long")))
    rows = members.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")))
    first = F.col("id") == F.col("bucket")
    near = rows.where(~first).withColumn("part", F.col("own"))
    near = near.unionByName(rows.where(first).withColumn("part", _numbers(F.col("parts"))))
    links = written(linked(near), "near-links")
    # the first text is the smallest, so what it is connected to has it as root
    known = components(links).withColumnRenamed("root", "found")
    rows = rows.where("parts > 1")
    left = rows.join(known, rows["id"] == known["node"], "left").where(~F.coalesce(F.col("found") == F.col("bucket"), F.lit(False)) & ~first)
    left = written(left.select(*rows.columns), "left")
    again = written(left.groupBy("bucket").agg(_parts(F.count("*")).alias("again")), "left-parts")
    if again.isEmpty():
        return links
    left = left.join(again, "bucket").withColumn("mine", F.pmod(F.xxhash64("id", F.lit(7)), F.col("again")))
    left = left.withColumn("own", _numbers(F.col("parts")))
    rows = rows.join(again, "bucket").withColumn("mine", _numbers(F.col("again")))
    met = left.unionByName(rows).withColumn("part", F.col("own") * F.col("again") + F.col("mine"))
    return links.unionAll(linked(met.dropDuplicates(["bucket", "part", "id"])))


def set_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """As ``spanning_links``, by the Jaccard similarity of sets; empty sets are equal."""
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    links: list[tuple[int, int]] = []
    unseen = np.arange(len(sets))
    while len(unseen) > 1:
        root, unseen = unseen[0], unseen[1:]
        front = [root]
        while front and len(unseen):
            one = front.pop()
            inside = np.zeros(len(names), bool)
            inside[codes[ends[one] : ends[one + 1]]] = True
            seen = np.concatenate([[0], np.cumsum(inside[codes])])
            both = (seen[ends[1:]] - seen[ends[:-1]])[unseen]
            whole = sizes[unseen] + sizes[one] - both
            found = unseen[np.where(whole > 0, both / np.maximum(whole, 1), 1.0) >= similarity]
            links += [(int(root), int(f)) for f in found]
            unseen = np.setdiff1d(unseen, found, assume_unique=True)
            front += found.tolist()
    return links


def _set_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[dict]:
    """Links within each part of rows sorted by group and part."""
    key, ids, sets = None, [], []

    def links() -> dict:
        found = set_links(sets, similarity) if len(sets) > 1 else []
        return {"a": [ids[x] for x, _ in found], "b": [ids[y] for _, y in found]}

    for batch in batches:
        for bucket, part, i, shingles in zip(*(c.to_pylist() for c in batch.columns)):
            if (bucket, part) != key:
                yield links()
                key, ids, sets = (bucket, part), [], []
            ids.append(i)
            sets.append(np.frombuffer(shingles, np.uint64))
    yield links()


def first_of_each(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the smallest id; equal
    texts are copies too. Rows and columns are as they came.

    Only rows that may have to go are shuffled: a bitmap of their keys tells the scan.
    """
    names = docs.columns
    groups = written(near_texts(docs, similarity, size), "groups")
    row = [F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "k1", "k2", F.lit(i)).alias(f"r{i}") for i in (1, 2)]
    keyed = docs.select(F.col("doc_id").alias("doc_id"), *text_key())
    slim = written(keyed.select("doc_id", "k1", *row), "rows")
    slim = slim.join(groups, "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "r1", "r2")
    least = slim.groupBy("root").agg(F.min(order).alias("least"), F.count("*").alias("n")).where("n > 1")
    stay = least.select(F.col("least.r1").alias("r1"), F.col("least.r2").alias("r2"), F.lit(True).alias("stays"))
    several = slim.join(least.select("root"), "root").select("r1", "r2").distinct()
    several = written(several.join(stay, ["r1", "r2"], "left"), "several")
    bitmap = sieve(several, "r1")
    packed = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), "doc_id", *text_key())
    packed = packed.select("row", *row)

    def passing(inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(in_sieve(bitmap.value, b.column(1).to_numpy()) == inside))

        return packed.mapInArrow(run, packed.schema)

    ship(docs.sparkSession)
    single = passing(False).select("row.*")
    # repeated rows have one key; one of them stays
    kept = passing(True).join(several.withColumn("known", F.lit(True)), ["r1", "r2"], "left")
    lone = kept.where("known is null").select("row.*")
    chosen = kept.where("stays").groupBy("r1", "r2").agg(F.first("row").alias("row")).select("row.*")
    return single.unionAll(lone).unionAll(chosen)
