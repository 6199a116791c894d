"""Helpers shared by the text operators: tables, written intermediates, words."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}

_WORDS = re.compile("[^\x20\x09-\x0d]+").findall
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]").search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path that nothing else uses, in the folder all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored in the shared folder and read back: lineage ends here, and a
    lost executor costs no recomputation of what came before."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: str) -> list[str]:
    """Maximal runs without space, tab, LF, VT, FF or CR."""
    return text.split() if _ODD_SPACE(text) is None else _WORDS(text)


ARROW_ROWS = 2000  # rows in a batch between Spark and Python; texts are long


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application, and keep the
    batches that go there small."""
    context = spark.sparkContext
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(batch)) > ARROW_ROWS:
        spark.conf.set(batch, ARROW_ROWS)
    package = Path(__file__).resolve().parents[1]
    if any(f.endswith(f"/{package.name}.zip") for f in context.listFiles):
        return
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))


def map_rows(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str, batch: int = 2000
) -> DataFrame:
    """``mapInArrow`` for a generator of column dicts."""
    ship(df.sparkSession)
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(_sliced(batches, batch)):
            arrays = [_as_array(columns[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def _as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], schema).schema
    return to_arrow_schema(kind)


def sieve(keys: DataFrame, column: str, bits: int = 26) -> Broadcast:
    """A bitmap of ``2**bits`` bits over a bigint column, as a broadcast.

    Its size is fixed (8 MB), however many keys there are. A set bit may be a
    false alarm, a clear bit is certain: callers send what hits the bitmap
    through an exact join and spare the rest that shuffle. With very many keys all
    rows take the join; the result stays the same.
    """
    word = F.shiftrightunsigned(F.col(column), 64 - bits + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")
    rows = keys.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), dtype=np.int64)
    bitmap[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def in_sieve(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which int64 keys may be among those the bitmap was made of."""
    bits = int(bitmap.size).bit_length() - 1 + 6
    top = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[top >> np.uint64(6)].view(np.uint64) >> (top & np.uint64(63))) & np.uint64(1) > 0


def text_key(column: str = "text") -> list:
    """A 128-bit name for a text: equal texts share it; two columns ``k1, k2``."""
    text = F.coalesce(F.col(column), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2")]
