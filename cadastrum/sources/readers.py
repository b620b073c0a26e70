"""Scans: delimited text, gzip by name or content, yearly Parquet folders and JSON documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadastrum.session import materialise, small_table
from cadastrum.sources.records import json_documents, lines_of, parse_records, read_quoted

# Candidate delimiters in order of preference among equals.
DELIMITERS = (",", "\t", ";", "|")
_FIELD_START = "(^|[,\\t;|])"
# Without a consistent candidate the header decides, in this order.
HEADER_FALLBACK = ("|", ";", ",")


def _unquoted(line: Column) -> Column:
    """The line without its quoted fields and without one that it does not close."""
    closed = F.regexp_replace(line, _FIELD_START + '"[^"]*+(?:""[^"]*+)*+"', "$1")
    return F.when(F.contains(line, F.lit('"')), F.regexp_replace(closed, _FIELD_START + '"[\\s\\S]*$', "$1")).otherwise(line)


def delimiter_profile(lines: DataFrame, by: list[str]) -> DataFrame:
    """How consistently each candidate splits the lines of every file.

    ``lines`` has a ``value`` column plus the ``by`` columns. For each
    candidate: the most common count per line and the share of lines with it.
    Quoted fields count as empty. All steps are map-side combinable; counts per line take few values.
    """
    bare = _unquoted(F.col("value"))
    counts = F.array(
        *[
            F.struct(
                F.lit(d).alias("delimiter"),
                F.lit(-rank).alias("preference"),
                (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("per_line"),
            )
            for rank, d in enumerate(DELIMITERS)
        ]
    )
    spread = lines.where(F.trim("value") != "").select(*by, F.inline(counts))
    histogram = spread.groupBy(*by, "delimiter", "preference", "per_line").agg(F.count("*").alias("lines"))
    return histogram.groupBy(*by, "delimiter", "preference").agg(
        F.max_by("per_line", F.struct("lines", "per_line")).alias("per_line"),
        F.max("lines").alias("matching"),
        F.sum("lines").alias("total"),
    )


def consistent_delimiter(profile: DataFrame, by: list[str]) -> DataFrame:
    """Per file the candidate with the same non-zero count on at least nine of ten lines, or null.

    The most consistent wins, then preference.
    """
    share = F.floor(F.col("matching") * 100 / F.col("total"))
    fit = (F.col("per_line") > 0) & (F.col("matching") * 10 >= F.col("total") * 9)
    return profile.groupBy(*by).agg(
        F.max_by(F.when(fit, F.col("delimiter")), F.when(fit, F.struct(share, "preference"))).alias("consistent")
    )


def choose_delimiter(profile: DataFrame, headers: DataFrame, by: list[str]) -> DataFrame:
    """One row per file with its delimiter.

    Without a consistent candidate the header line decides; a file of blank lines alone gets the comma.
    """
    fallback = reduce(
        lambda rest, d: F.when(F.contains("header", F.lit(d)), d).otherwise(rest),
        reversed(HEADER_FALLBACK),
        F.lit(","),
    )
    files = headers.join(consistent_delimiter(profile, by), by, "left")
    return files.select(*by, F.coalesce("consistent", fallback, F.lit(",")).alias("delimiter"))


def first_lines(lines: DataFrame, by: list[str], place: str) -> DataFrame:
    """The first non-blank line of every file by its ``place``, null for a file of blank lines."""
    filled = F.trim("value") != ""
    return lines.groupBy(*by).agg(F.min_by("value", F.when(filled, F.col(place))).alias("header"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and an ascending place in it."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        # A file's splits are numbered in their order, and rows within a split in theirs.
        F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("place"),
    )


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter of a data set of like files: the one most of its files have, by all of their lines.

    Headers are looked up only if no file has a consistent one.
    """
    return _chosen_delimiter(text_lines(spark, path))


def _chosen_delimiter(lines: DataFrame) -> str:
    def most_common(files: DataFrame, name: str) -> str | None:
        row = files.where(F.col(name).isNotNull()).groupBy(name).count().orderBy(F.desc("count"), name).first()
        return row[name] if row else None

    profile = delimiter_profile(lines, ["file"])
    return (
        most_common(consistent_delimiter(profile, ["file"]), "consistent")
        or most_common(choose_delimiter(profile, first_lines(lines, ["file"], "place"), ["file"]), "delimiter")
        or ","
    )


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str = "UTF-8",
    multi_line: bool = False,
) -> DataFrame:
    """Header row, every column text, blanks kept as empty text.

    ``multi_line`` allows line breaks inside quotes. Files in UTF-8 stay splittable; others are read by one task each.
    """
    sep = sep or detect_delimiter(spark, path)
    if multi_line and encoding.upper() == "UTF-8":
        return read_quoted(spark, path, sep)
    raw = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )
    return raw.toDF(*[name.lstrip("\ufeff") for name in raw.columns]).fillna("")


def read_gzip(spark: SparkSession, path: str, partitions: int | None = None, **options) -> DataFrame:
    """Gzip files decode in one task each, so rows are spread before further work.

    Without a number AQE sizes the partitions by the decoded bytes.
    """
    rows = read_delimited(spark, path, **options)
    return rows.repartition(partitions) if partitions else rows.hint("rebalance")


GZIP_MAGIC = b"\x1f\x8b"
_GZIP_NAME = r"\.gz$"
_CHUNK = 1 << 20


def misnamed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, gzip) of the files whose first bytes say other than their names. Executors read them; files beyond 2 GB go by name."""
    files = spark.read.format("binaryFile").load(path).where("length < 2147483647")
    gzip = F.substring("content", 1, 2) == F.lit(GZIP_MAGIC)
    return files.select("path", gzip.alias("gzip")).where(F.col("gzip") != F.rlike("path", F.lit(_GZIP_NAME)))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole files, a chunk at a time; gzip members are decoded one after the other."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data, rest, row = content.as_buffer(), b"", 0
            for chunk in _chunks(memoryview(data)):
                *lines, rest = (rest + chunk).split(b"\n")
                if lines:
                    yield _line_batch(path, row, lines)
                    row += len(lines)
            if rest:
                yield _line_batch(path, row, [rest])


def _line_batch(path: str, row: int, lines: list[bytes]) -> pa.RecordBatch:
    texts = [line.decode("utf-8", "replace") for line in lines]
    rows = pa.array(range(row, row + len(lines)), type=pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), rows, pa.array(texts)], names=["file", "row", "value"])


def _chunks(data: memoryview) -> Iterator[bytes]:
    if bytes(data[:2]) != GZIP_MAGIC:
        for at in range(0, len(data), _CHUNK):
            yield bytes(data[at : at + _CHUNK])
        return
    while len(data):
        member = zlib.decompressobj(wbits=31)
        for at in range(0, len(data), _CHUNK):
            yield member.decompress(bytes(data[at : at + _CHUNK]))
            if member.eof:
                data = data[min(len(data), at + _CHUNK) - len(member.unused_data) :]
                break
        else:
            return


def read_sniffed(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Delimited text, plain or gzip by content, whatever the files are named, with quoted line breaks.

    Files whose name tells the truth take Spark's own scan; plain ones stay splittable. The others are
    opened by the executors, decoded in chunks and never held as text whole. One header per file, as in ``read_quoted``.
    """
    wrong = materialise(misnamed_files(spark, path), "misnamed").select(F.col("path").alias("file"))

    def by(column: str) -> Column:
        return F.regexp_replace(column, "^file:/+", "file:///")

    wrong = wrong.select(by("file").alias("file"))
    well_named = [r.path for r in _plain_names(spark, path, wrong).collect()]
    opened = spark.read.format("binaryFile").load(path).join(wrong, by("path") == F.col("file"), "left_semi")
    decoded = opened.select("path", "content").mapInArrow(_decoded, "file string, row long, value string").select(
        "file", F.lit(0).cast("long").alias("range"), "row", F.ltrim("value", F.lit("\ufeff")).alias("value")
    )
    lines = lines_of(spark, well_named).unionByName(decoded) if well_named else decoded
    lines = materialise(lines, "sniffed-lines")
    if sep is None:
        named = lines.withColumn("place", F.struct("range", "row"))
        sep = _chosen_delimiter(named)
    return parse_records(lines, sep, placed=False)


def _plain_names(spark: SparkSession, path: str, wrong: DataFrame) -> DataFrame:
    """Names of the files that Spark's scan reads right: a row per file of one data set, as Spark's own listing keeps."""
    named = F.regexp_replace("path", "^file:/+", "file:///")
    return spark.read.format("binaryFile").load(path).select("path").join(wrong, named == F.col("file"), "left_anti")


def read_years(
    spark: SparkSession,
    base: str,
    columns: list[str] | None = None,
    years: list[int] | None = None,
    schema: StructType | None = None,
) -> DataFrame:
    """``base/year=YYYY`` folders as one table; only listed years and columns are read.

    A year without a folder is just absent; a column some years lack is null there.
    With a ``schema`` no footers are read to find the columns.
    """
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)
    table = reader.parquet(base)
    if columns is not None:
        absent = [c for c in columns if c not in table.columns]
        table = table.withColumns({c: F.lit(None).cast("double") for c in absent}).select(*columns, "year")
    if years is not None:
        table = table.where(F.col("year").isin([int(y) for y in dict.fromkeys(years)]))
    return table.withColumn("year", F.col("year").cast("long"))


def year_folders(spark: SparkSession, base: str) -> list[int]:
    """The years of ``base/year=YYYY``. No file is opened: executors see a row per file, the driver one per year."""
    files = spark.read.format("binaryFile").load(base).select(F.col("year").cast("int").alias("year"))
    return sorted(row["year"] for row in files.where("year IS NOT NULL").distinct().collect())


def read_harmonised_years(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """Union of the year folders that carry every column of ``schema``; others are skipped."""
    found = year_folders(spark, base)
    needed = [name for name in schema.fieldNames() if name != "year"]
    kept = []
    for year in found:
        rows = spark.read.parquet(f"{base}/year={year}")
        if not set(needed) - set(rows.columns):
            kept.append(rows.select(*needed, F.lit(year).cast("long").alias("year")))
    if not kept:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, kept).select(*schema.fieldNames())


def camel(snake: str) -> str:
    head, *rest = snake.split("_")
    return head + "".join(part.capitalize() for part in rest)


# Fields by snake_case name: type, and the default for an absent value (None: null).
Fields = dict[str, tuple[str, object]]


def either_case_schema(fields: Fields, mark: str = " ") -> str:
    """DDL of the fields under both their snake_case and their camelCase names."""
    return ",".join(
        f"`{name}`{mark}{kind}" for snake, (kind, _) in fields.items() for name in dict.fromkeys((camel(snake), snake))
    )


def either_case_columns(fields: Fields, inside: str | None = None) -> list[Column]:
    """The fields of a row (or of its struct ``inside``); the camelCase name wins, then the other, then the default."""
    columns = []
    for snake, (kind, default) in fields.items():
        found = [F.col(f"{inside}.{name}" if inside else name) for name in dict.fromkeys((camel(snake), snake))]
        if default is not None:
            found.append(F.lit(default).cast(kind))
        columns.append(F.coalesce(*found).alias(snake))
    return columns


BROKEN = "_broken"


def parsed_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The documents of JSON files, indented or one per line, as rows of the declared schema (absent fields null).

    ``readable`` is false for a document that is cut off or no JSON; its fields are all null.
    """
    found = json_documents(spark, path)
    parsed = F.from_json("text", f"{schema}, {BROKEN} string", {"columnNameOfCorruptRecord": BROKEN})
    rows = found.select(parsed.alias("one"), "complete").select(
        "one.*", (F.col("complete") & F.col(f"one.{BROKEN}").isNull()).alias("readable")
    ).drop(BROKEN)
    return rows.select(*[F.when(F.col("readable"), F.col(c)).alias(c) for c in rows.columns if c != "readable"], "readable")


def read_either_case(spark: SparkSession, path: str, fields: Fields) -> DataFrame:
    """JSON documents whose fields have snake_case or camelCase names, with ``readable``.

    Defaults fill absent fields of documents that could be read, never a document that could not.
    """
    rows = parsed_documents(spark, path, either_case_schema(fields))
    filled = [F.when(F.col("readable"), column).alias(name) for name, column in zip(fields, either_case_columns(fields), strict=True)]
    return rows.select(*filled, "readable")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, indented or one per line, with a declared schema (absent fields null)."""
    return parsed_documents(spark, path, schema).drop("readable")


def describe(df: DataFrame) -> DataFrame:
    """``(column_name, column_type)`` of a table, in column order."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes, start=1)]
    return small_table(df.sparkSession, rows, "position int, column_name string, column_type string")
