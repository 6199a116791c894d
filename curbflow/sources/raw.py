"""Raw trip files: repair lines, harmonise headers, read.

Files of three header generations share the meaning of columns 1-13 and 15-17
by position. Column 14 changed its meaning and keeps its own name; the total is
column 18 or, in the widest generation, column 19.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.functions.text import file_month, file_name, file_year
from curbflow.functions.timeparts import wall_clock
from curbflow.operators.joins import broadcast_if_small
from curbflow.session import enable_checkpoints

# Canonical names of the columns by position, from 1.
CANONICAL_BY_POSITION = {
    1: "vendor_id",
    2: "pickup_datetime",
    3: "dropoff_datetime",
    4: "passenger_count",
    5: "trip_distance",
    6: "pickup_longitude",
    7: "pickup_latitude",
    8: "rate_code",
    9: "store_and_fwd_flag",
    10: "dropoff_longitude",
    11: "dropoff_latitude",
    12: "payment_type",
    13: "fare_amount",
    15: "mta_tax",
    16: "tip_amount",
    17: "tolls_amount",
}
TOTAL = "total_amount"

# Types of the canonical columns that are not text.
CANONICAL_TYPES = {
    "passenger_count": "int",
    "rate_code": "int",
    "trip_distance": "double",
    "pickup_longitude": "double",
    "pickup_latitude": "double",
    "dropoff_longitude": "double",
    "dropoff_latitude": "double",
    "fare_amount": "double",
    "mta_tax": "double",
    "tip_amount": "double",
    "tolls_amount": "double",
    "total_amount": "double",
    "surcharge": "double",
    "extra": "double",
    "improvement_surcharge": "double",
}

Header = tuple[str, ...]


# --- files -----------------------------------------------------------------


def list_files(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """Path, name, size, year and month of the files below ``root``.

    The binary reader lists files; their contents are not read because only the
    listing columns are selected.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    return files.select(
        "path",
        file_name(F.col("path")).alias("file_name"),
        "length",
        file_year(F.col("path")).alias("year"),
        file_month(F.col("path")).alias("month"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A headerless one-column list of addresses."""
    return manifest_parts(spark.read.schema("url string").option("header", False).csv(path))


def manifest_parts(urls: DataFrame) -> DataFrame:
    """File name, year and month of every address."""
    return urls.select(
        "url",
        file_name(F.col("url")).alias("file_name"),
        file_year(F.col("url")).alias("year"),
        file_month(F.col("url")).alias("month"),
    )


# --- lines -----------------------------------------------------------------


def drop_blank_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    return lines.where(~F.col(line).rlike(r"^\s*$"))


def field_count(line: Column) -> Column:
    """Number of comma-separated fields, quotes not considered."""
    return F.size(F.split(line, ",", -1))


def keep_field_count(lines: DataFrame, n: int, line: str = "value") -> DataFrame:
    return lines.where(field_count(F.col(line)) == n)


def rejected_lines(lines: DataFrame, n: int, line: str = "value") -> DataFrame:
    """Non-blank lines of another width, kept for inspection."""
    return drop_blank_lines(lines, line).where(field_count(F.col(line)) != n)


def header_names(line: Column) -> Column:
    """Names in a header line, without blanks and quotes around them. A name left empty
    is called by its position: the row numbers of an export become ``V1``."""
    names = F.transform(F.split(line, ",", -1), lambda name: F.trim(F.btrim(F.trim(name), F.lit('"'))))
    return F.transform(
        names, lambda name, i: F.when(name == "", F.concat(F.lit("V"), (i + 1).cast("string"))).otherwise(name)
    )


def is_header(line: Column, names: Column, first: Column) -> Column:
    """Does the line hold these names? ``first`` is one of them: only lines in which it
    occurs are split and compared."""
    return line.contains(first) & (header_names(line) == names)


def parse_lines(lines: DataFrame, header: Sequence[str], line: str = "value") -> DataFrame:
    """Split CSV lines into text columns named by ``header``; header lines go,
    with or without blanks around their names."""
    schema = ", ".join(f"`{name}` string" for name in header)
    names = [name.strip() for name in header]
    literal = F.array(*[F.lit(name) for name in names])
    body = lines.where(~is_header(F.col(line), literal, F.lit(max(names, key=len))))
    return body.select(F.from_csv(line, schema, {"mode": "PERMISSIVE"}).alias("row")).select("row.*")


# --- headers ---------------------------------------------------------------

MOST_HEADERS = 1000  # different headers that one data set may have


def raw_lines(spark: SparkSession, paths: str | Iterable[str], **options: str) -> DataFrame:
    """``value`` of every line, the ``path`` of its file, and ``place``, which sorts the
    lines of a file. ``options`` go to the text source, e.g. ``pathGlobFilter``."""
    options = {"recursiveFileLookup": "true", **options}  # folders named key=value are no columns here
    lines = spark.read.options(**options).text([paths] if isinstance(paths, str) else list(paths))
    # a file's blocks sort by where they start, the lines of a block by the running number
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines.select("value", F.col("_metadata.file_path").alias("path"), place.alias("place"))


def survey_headers(spark: SparkSession, paths: str | Iterable[str], **options: str) -> DataFrame:
    """``path, header``: the names in the first non-blank line of every file that has one.

    One job over all files, whatever their number: the first line of each is a minimum,
    taken in the scan and then across the blocks of a file.
    """
    lines = drop_blank_lines(raw_lines(spark, paths, **options))
    first = lines.groupBy("path").agg(F.min_by("value", "place").alias("value"))
    return first.select("path", header_names(F.col("value")).alias("header"))


def distinct_headers(survey: DataFrame) -> list[Header]:
    """The generations of a survey, those of most files first."""
    counted = survey.groupBy("header").agg(F.count(F.lit(1)).alias("files"))
    rows = counted.orderBy(F.desc("files"), "header").limit(MOST_HEADERS + 1).collect()
    if len(rows) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers; are these files of one data set?")
    return [tuple(row["header"]) for row in rows]


def canonical_names(header: Sequence[str]) -> dict[str, str]:
    """Raw name → canonical name for one header, by position. A column of row numbers in
    front does not count."""
    names_only = header[1:] if header and header[0] == "V1" else header
    names = {
        names_only[position - 1]: canonical
        for position, canonical in CANONICAL_BY_POSITION.items()
        if position <= len(names_only)
    }
    if len(names_only) >= 18:
        names[names_only[-1]] = TOTAL
    return names


def alias_sets(headers: Iterable[Header]) -> dict[str, list[str]]:
    """Canonical name → distinct raw names over all headers, in order of appearance."""
    sets: dict[str, dict[str, None]] = {}
    for header in dict.fromkeys(headers):
        for raw, canonical in canonical_names(header).items():
            sets.setdefault(canonical, {})[raw] = None
    return {canonical: list(raws) for canonical, raws in sets.items()}


def rename_canonical(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename every column found in an alias set; others keep their names."""
    present = set(df.columns)
    renames = {
        raw: canonical
        for canonical, raws in aliases.items()
        for raw in raws
        if raw in present and raw != canonical
    }
    return df.withColumnsRenamed(renames)


def typed(df: DataFrame) -> DataFrame:
    """Cast the canonical text columns; unreadable text becomes NULL."""
    present = set(df.columns)
    casts = {c: F.col(c).try_cast(t) for c, t in CANONICAL_TYPES.items() if c in present}
    return df.withColumns(casts) if casts else df


# --- reading ---------------------------------------------------------------


def file_layouts(spark: SparkSession, headers: Sequence[Header]) -> tuple[list[str], DataFrame]:
    """The columns of all generations together, and for each header the places in its lines
    where they stand: ``header, width, named, slots``, a slot being null where a generation
    lacks the column."""
    canonical = {raw: name for name, raws in alias_sets(headers).items() for raw in raws}
    renamed = [[canonical.get(raw, raw) for raw in header] for header in headers]
    columns = list(dict.fromkeys(name for names in renamed for name in names))
    rows = [
        (list(header), len(header), max(header, key=len), [names.index(c) if c in names else None for c in columns])
        for header, names in zip(headers, renamed)
    ]
    return columns, spark.createDataFrame(rows, "header array<string>, width int, named string, slots array<int>")


def read_trips(
    spark: SparkSession, paths: str | Iterable[str], *, exact_width: bool = False, **options: str
) -> DataFrame:
    """All raw trip files under one canonical schema, in one scan.

    A survey finds the header of every file; each line then meets its file's layout by a
    join on the path, and every column is taken from the place where that layout has it.
    Neither files nor generations multiply the scans, and no list of files is kept on the
    driver. Columns a generation lacks are NULL. Blank lines and repeated headers go;
    with ``exact_width`` so do lines that are wider or narrower than their header.
    """
    enable_checkpoints(spark)
    survey = survey_headers(spark, paths, **options).checkpoint()
    headers = distinct_headers(survey)
    if not headers:
        raise ValueError("no file with a header line")
    columns, layouts = file_layouts(spark, headers)
    by_path = survey.join(F.broadcast(layouts), "header")
    lines = drop_blank_lines(raw_lines(spark, paths, **options)).drop("place").join(broadcast_if_small(by_path), "path")
    if exact_width:
        lines = lines.where(field_count(F.col("value")) == F.col("width"))
    lines = lines.where(~is_header(F.col("value"), F.col("header"), F.col("named")))
    widest = max(map(len, headers))
    schema = ", ".join(f"_{i} string" for i in range(widest))
    mode = {"mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    fields = lines.select(F.from_csv("value", schema, mode).alias("row"), "slots")
    fields = fields.select(F.array(*[F.col(f"row._{i}") for i in range(widest)]).alias("fields"), "slots")
    rows = fields.select(*[F.get("fields", F.get("slots", F.lit(k))).alias(name) for k, name in enumerate(columns)])
    clocks = [c for c in ("pickup_datetime", "dropoff_datetime") if c in columns]
    return typed(rows).withColumns({c: wall_clock(F.col(c)) for c in clocks})
