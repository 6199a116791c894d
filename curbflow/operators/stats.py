"""Patterns, exact quantiles, duplicates, samples and set checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.functions.aggregates import Mean
from curbflow.operators.cleaning import fare_rate_trips
from curbflow.operators.joins import broadcast_if_small
from curbflow.session import enable_checkpoints


def fare_rate_pattern(trips: DataFrame, keys: Sequence[str], *, mean: Mean = F.avg) -> DataFrame:
    """Mean fare rate of usual trips, e.g. by weekday × hour or month × hour."""
    return (
        fare_rate_trips(trips)
        .groupBy(*keys)
        .agg(mean(F.col("fare_rev_per_hour")).alias("fare_rev_per_hour"))
    )


def means_by(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str], *, mean: Mean = F.avg
) -> DataFrame:
    return df.groupBy(*keys).agg(*[mean(F.col(m)).alias(m) for m in measures])


def value_range(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest, largest and largest absolute value."""
    return df.groupBy(*keys).agg(
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.max(F.abs(F.col(value))).alias("max_abs"),
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: Sequence[str] = (),
    *,
    bucket_width: float | None = None,
) -> DataFrame:
    """Interpolated quantiles per key, exact, without gathering any group.

    Without keys, or without a ``bucket_width`` that suits the values, see
    ``refined_quantiles``. Otherwise values are counted before the shuffle, then ranked in two levels: running
    totals over buckets of ``bucket_width``, and running counts of the distinct
    values inside each bucket. No task sees more than the buckets of one key or
    the distinct values of one bucket, however many rows the key has.

    ``probs`` maps output names to probabilities. Adds ``n``, the row count.
    """
    if not keys or bucket_width is None:
        return refined_quantiles(df, value, probs, keys)
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", F.floor(F.col(value) / F.lit(float(bucket_width))))
    )
    key_window = Window.partitionBy(*keys)
    before = F.sum("bucket_n").over(
        key_window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    buckets = (
        counts.groupBy(*keys, "bucket")
        .agg(F.sum("n").alias("bucket_n"))
        .select(
            *[F.col(k).alias(f"_{k}") for k in [*keys, "bucket"]],
            F.coalesce(before, F.lit(0)).alias("before"),
            F.sum("bucket_n").over(key_window).alias("total"),
        )
    )
    # null-safe: keeps an unknown key, and adds no filter that would tell the two
    # uses of the counts apart, so that they are computed once
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "bucket"]]
    inner = Window.partitionBy(*keys, "bucket").orderBy(value)
    ranked = counts.join(buckets, same).withColumn(
        "upto", F.col("before") + F.sum("n").over(inner)
    )

    def at_rank(rank: Column) -> Column:
        holds = (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(holds, F.col(value)))

    aggs = [F.first("total").alias("n")]
    for name, p in probs.items():
        position = (F.col("total") - 1) * F.lit(p)
        aggs.append(at_rank(F.floor(position)).alias(f"{name}_low"))
        aggs.append(at_rank(F.ceil(position)).alias(f"{name}_high"))
    picked = ranked.groupBy(*keys).agg(*aggs)
    return picked.select(*keys, *_interpolated(probs), "n")


def _interpolated(probs: dict[str, float]) -> list[Column]:
    """Quantiles between the values at the ranks below and above, of ``n`` values."""
    out = []
    for name, p in probs.items():
        position = (F.col("n") - 1) * F.lit(p)
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return out


def _bucket(x: Column, low: Column, high: Column, buckets: int) -> Column:
    """Bucket of ``x`` in ``low .. high``, never falling as ``x`` rises; both ends lie in
    different buckets. A range across zero is split by sign, one over several powers of
    two evenly in its logarithm, any other evenly: so a few rounds part any two doubles."""

    def share(of: Column) -> Column:
        return F.floor(of * F.lit(float(buckets)))

    same_scale = 4.0
    return (
        F.when((low <= 0) & (high >= 0), F.signum(x).cast("bigint"))
        .when((low > 0) & (high / low > same_scale), share((F.ln(x) - F.ln(low)) / (F.ln(high) - F.ln(low))))
        .when((high < 0) & (low / high > same_scale), share((F.ln(-low) - F.ln(-x)) / (F.ln(-low) - F.ln(-high))))
        .otherwise(share((x - low) / (high - low)))
    )


def weighted_quantiles(df: DataFrame, value: str, weight: str, probs: dict[str, float]) -> DataFrame:
    """``refined_quantiles`` of values that are counted already."""
    return refined_quantiles(df, value, probs, weight=weight)


def refined_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: Sequence[str] = (),
    *,
    weight: str | None = None,
    buckets: int = 1024,
) -> DataFrame:
    """Interpolated quantiles, of everything or per key, exact, for values of any spread.

    Selection by refinement: values are counted over coarse buckets, the running totals
    over a range's buckets tell which one holds the rank that is looked for, and only that
    bucket is split again, until it holds a single value. A round reads the counted
    values once; a task sorts no more than the ``buckets`` of a range, whatever the number
    of rows or of different values. NULL, NaN and infinite values are not ranked.

    ``probs`` maps output names to probabilities; a row counts ``weight`` times. Adds
    ``n``, the number of values ranked; without keys an empty table gives one row of NULLs.
    """
    enable_checkpoints(df.sparkSession)
    by = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    named = [F.col(k).alias(b) for k, b in zip(keys, by)] or [F.lit(0).alias("_k0")]
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    # -0.0 and 0.0 are one value
    counts = (
        df.where(finite)
        .select(*named, (x + F.lit(0.0)).alias("x"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("w"))
        .groupBy(*by, "x")
        .agg(F.sum("w").alias("n"))
        .checkpoint()
    )
    totals = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).checkpoint()
    at = [
        F.struct(F.lit(f"{name}_{side}").alias("name"), rounded((F.col("n") - 1) * F.lit(p)).alias("rank"))
        for name, p in probs.items()
        for side, rounded in (("low", F.floor), ("high", F.ceil))
    ]
    sought = totals.select(*by, "low", "high", F.lit(0).cast("bigint").alias("before"), F.explode(F.array(*at)).alias("at"))
    sought = sought.select(*by, "low", "high", "before", "at.*")
    found = None
    while True:
        sought = sought.checkpoint()
        closed = sought.where("low = high").select(*by, "name", F.col("low").alias("value"))
        found = closed if found is None else found.unionByName(closed)
        open_ranks = sought.where("low < high")
        if open_ranks.isEmpty():
            break
        ranges = open_ranks.select(*[F.col(b).alias(f"r{b}") for b in by], "low", "high").distinct()
        same = [F.col(b).eqNullSafe(F.col(f"r{b}")) for b in by]
        inside = counts.join(
            broadcast_if_small(ranges), [*same, F.col("x") >= F.col("low"), F.col("x") <= F.col("high")]
        ).withColumn("bucket", _bucket(F.col("x"), F.col("low"), F.col("high"), buckets))
        per_bucket = inside.groupBy(*by, "low", "bucket").agg(
            F.sum("n").alias("n"), F.min("x").alias("least"), F.max("x").alias("most")
        )
        # a range has a bounded number of buckets
        order = Window.partitionBy(*by, "low").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        steps = per_bucket.select(
            *[F.col(b).alias(f"s{b}") for b in by],
            F.col("low").alias("start"),
            "n",
            "least",
            "most",
            F.coalesce(F.sum("n").over(order), F.lit(0)).alias("skipped"),
        )
        here = [F.col(b).eqNullSafe(F.col(f"s{b}")) for b in by]
        past = F.col("before") + F.col("skipped")
        holds = (F.col("rank") >= past) & (F.col("rank") < past + F.col("n"))
        sought = open_ranks.join(steps, [*here, F.col("low") == F.col("start"), holds]).select(
            *by, F.col("least").alias("low"), F.col("most").alias("high"), past.alias("before"), "name", "rank"
        )
    picks = [F.max(F.when(F.col("name") == f"{p}_{side}", F.col("value"))).alias(f"{p}_{side}") for p in probs for side in ("low", "high")]
    picked = found.groupBy(*by).agg(*picks).withColumnsRenamed({b: f"s{b}" for b in by})
    joined = totals.select(*by, "n").join(picked, [F.col(b).eqNullSafe(F.col(f"s{b}")) for b in by])
    out = joined.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *_interpolated(probs), "n")
    # without keys there is one row, of an empty table too
    return out if keys else out.agg(*[F.max(c).alias(c) for c in out.columns])


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once, with the number of copies."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key repeats, each with the number of copies.

    Copies are counted before the shuffle rather than with a window, which would
    gather a key's rows in one task. The repeated keys are stored once and the
    rows found by a join: a broadcast while the keys are few, else a shuffled
    join whose hot partitions are split at run time.
    """
    enable_checkpoints(df.sparkSession)
    renamed = {k: f"_{k}" for k in keys}
    repeated = repeated_keys(df, keys).withColumnsRenamed(renamed).checkpoint()
    same = [df[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(broadcast_if_small(repeated), same).drop(*[f"_{k}" for k in keys])


def busiest(df: DataFrame, key: str) -> DataFrame:
    """The key with most rows, ties included."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") == counts.agg(F.max("n")).scalar())


def sample_rows(df: DataFrame, k: int, rank: Column, *tie_break: str) -> DataFrame:
    """``k`` rows, the same on every run: those with the lowest ``rank``.

    ``rank`` is a hash of identifying columns, e.g. ``F.xxhash64("trip_id",
    F.lit(seed))``.
    """
    return df.orderBy(rank, *tie_break).limit(k)


def only_in_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids that occur in one of two tables but not in both."""
    sides = a.select(key, F.lit(True).alias("_a")).unionByName(
        b.select(key, F.lit(False).alias("_a"))
    )
    return (
        sides.groupBy(key)
        .agg(F.bool_or("_a").alias("in_a"), F.bool_or(~F.col("_a")).alias("in_b"))
        .where(F.col("in_a") != F.col("in_b"))
    )


def missing_ids(domain: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Ids of ``domain`` that do not occur in ``present``."""
    return domain.select(key).join(present.select(key).distinct(), key, "left_anti")
