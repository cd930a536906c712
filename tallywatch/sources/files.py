"""Transactions from CSV, spreadsheet exports (as CSV) and JSON lines."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywatch.functions.numbers import parse_number, parse_timestamp
from tallywatch.schema import canonicalise, resolve_aliases
from tallywatch.session import ensure_checkpoint_dir

# The labelled payments CSV, by position; the second "Account" is the receiver's.
LABELLED_SCHEMA = T.StructType(
    [
        T.StructField("Timestamp", T.StringType()),
        T.StructField("From Bank", T.StringType()),
        T.StructField("Account", T.StringType()),
        T.StructField("To Bank", T.StringType()),
        T.StructField("Account.1", T.StringType()),
        T.StructField("Amount Received", T.DoubleType()),
        T.StructField("Receiving Currency", T.StringType()),
        T.StructField("Amount Paid", T.DoubleType()),
        T.StructField("Payment Currency", T.StringType()),
        T.StructField("Payment Format", T.StringType()),
        T.StructField("Is Laundering", T.IntegerType()),
    ]
)

# The JSON transaction; only the amount is required.
JSON_SCHEMA = T.StructType(
    [
        T.StructField("amount", T.DoubleType()),
        T.StructField("payment_format", T.StringType()),
        T.StructField("sender_account", T.StringType()),
        T.StructField("receiver_account", T.StringType()),
        T.StructField("sender_country", T.StringType()),
        T.StructField("receiver_country", T.StringType()),
        T.StructField("merchant_category_code", T.StringType()),
        T.StructField("mcc", T.StringType()),
        T.StructField("merchant_name", T.StringType()),
        T.StructField("transaction_date", T.StringType()),
        T.StructField("card_number", T.StringType()),
        T.StructField("receiver_first_name", T.StringType()),
        T.StructField("receiver_last_name", T.StringType()),
        T.StructField("transaction_reference", T.StringType()),
    ]
)


MOST_HEADERS = 1000
CORRUPT = "_corrupt_record"
JSON_RECORD = T.StructType([*JSON_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
REJECT_COLUMNS = ("source", "position", "reason", "record")


def unique_names(names: list[str]) -> list[str]:
    """Trimmed headers; repeats of X become X.1, X.2, ..."""
    seen: dict[str, int] = {}
    result = []
    for name in (n.strip() for n in names):
        count = seen.get(name, 0)
        seen[name] = count + 1
        result.append(f"{name}.{count}" if count else name)
    return result


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header) of every CSV file under ``path`` that is not empty, read by tasks.

    The first line of a file's first split is its header. A split of full size has a task to itself, which stops
    after its first batch of lines; only smaller splits, which may share a task, are read to their end.
    """
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            places = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()))
            found = [i for i, place in enumerate(places) if place != (places[i - 1] if i else last) and place[1] == 0]
            last = places[-1] if places else last
            yield batch.select(["file", "value"]).take(pa.array(found, pa.int64()))
            if places and batch.column("length")[0].as_py() >= size:
                return

    place = ("file_path", "file"), ("file_block_start", "start"), ("file_block_length", "length")
    lines = spark.read.text(path).select("value", *(F.col(f"_metadata.{a}").alias(b) for a, b in place))
    return lines.mapInArrow(first_lines, "file string, value string").select("file", F.ltrim("value", F.lit("\ufeff")).alias("header"))


def _names_of(header: str) -> tuple[str, ...]:
    return tuple(next(csv.reader([header]), ()))


def files_by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The names in each distinct header and the files that have it; where all have one, the path itself."""
    found = file_headers(spark, path).persist()
    try:
        distinct = sorted(r["header"] for r in found.select("header").distinct().limit(MOST_HEADERS + 1).collect())
        if len(distinct) > MOST_HEADERS:
            raise ValueError(f"{path} has more than {MOST_HEADERS} different headers")
        out: dict[tuple[str, ...], list[str]] = {}
        for header in distinct:
            files = [path] if len(distinct) == 1 else [r["file"] for r in found.filter(F.col("header") == header).collect()]
            out.setdefault(_names_of(header), []).extend(files)
        return out
    finally:
        found.unpersist()


def with_row_ids(df: DataFrame) -> DataFrame:
    """Stores rows of text files as Parquet and adds ``txn_id``: the dense, 0-based file position.

    A split of a file is read by one task from start to end, so the position within a split follows
    from the running id. The text is parsed once; storing fixes the splits and ids, and every later
    pass reads pruned columns. Offsets come from one row per split.
    """
    return _numbered(_placed(df))


def _placed(df: DataFrame) -> DataFrame:
    place = F.struct("_metadata.file_path", "_metadata.file_block_start")
    return df.select(*(F.col(f"`{c}`") for c in df.columns), place.alias("_place"))


def _numbered(tagged: DataFrame) -> DataFrame:
    spark = tagged.sparkSession
    names = [c for c in tagged.columns if c != "_place"]
    folder = f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    tagged.select(
        "*", F.xxhash64("_place").alias("_split"), F.monotonically_increasing_id().alias("_mid")
    ).write.parquet(folder)
    stored = spark.read.parquet(folder)

    splits = stored.groupBy("_split").agg(
        F.min("_place").alias("_place"), F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    rows_before = F.coalesce(F.sum("_n").over(before), F.lit(0))
    offsets = splits.select("_split", (rows_before - F.col("_first")).alias("_shift"))
    placed = stored.join(offsets, "_split")
    return placed.select((F.col("_mid") + F.col("_shift")).alias("txn_id"), *(F.col(f"`{c}`") for c in names))


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """The labelled payments file, under an explicit schema; another header in any file is an error."""
    wanted = LABELLED_SCHEMA.fieldNames()
    for header, names in files_by_header(spark, path).items():
        if header and unique_names(list(header)) != wanted:
            raise ValueError(f"{names[0]} has other columns: {', '.join(header)}")
    rows = spark.read.schema(LABELLED_SCHEMA).option("header", True).option("enforceSchema", True).csv(path)
    return with_row_ids(rows)


def read_batch_csv(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """CSV files with headers, as text; numbers and dates are parsed by ``canonicalise``.

    Columns are found by each file's own header; one that a file lacks is null there. Quoted values
    with ``line_breaks`` need whole files per task, so they are asked for.
    """
    return _csv_rows(spark, path, line_breaks).drop(CORRUPT)


def _csv_rows(spark: SparkSession, path: str, line_breaks: bool) -> DataFrame:
    """The rows of CSV files with ids, and the whole line of those with another number of values than their header."""
    by_header = {header: names for header, names in files_by_header(spark, path).items() if header}
    if not by_header:
        raise ValueError(f"{path} has no header")
    reader = spark.read.option("header", True).option("enforceSchema", True).option("multiLine", line_breaks)
    reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    rows = None
    for header, names in by_header.items():
        fields = unique_names([value or f"Unnamed: {i}" for i, value in enumerate(header)])
        schema = T.StructType([T.StructField(field, T.StringType()) for field in (*fields, CORRUPT)])
        own = _placed(reader.schema(schema).csv(names))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    return _numbered(rows)


def _blank(column: Column) -> Column:
    return F.coalesce(F.trim(column), F.lit("")).isin("", "nan", "None")


def csv_rejects(spark: SparkSession, path: str, profile: str = "v3", line_breaks: bool = False) -> DataFrame:
    """What CSV files hold that cannot be taken as it is, as source, position, reason and record: rows with more or
    fewer values than the header (broken quotes among them), and amounts and times that are missing or do not parse.
    A row has one line per reason. ``read_batch_csv`` keeps such rows, with nulls."""
    rows = _csv_rows(spark, path, line_breaks)
    values = [c for c in rows.columns if c not in ("txn_id", CORRUPT)]
    chosen = resolve_aliases(values, profile)
    reasons = [F.when(F.col(CORRUPT).isNotNull(), "number of values")]
    whole = F.col(CORRUPT).isNull()
    for name, parsed in (("amount", parse_number), ("ts", parse_timestamp)):
        if name in chosen:
            given = F.col(f"`{chosen[name]}`")
            found = parsed(given, T.StringType())
            reasons.append(F.when(whole & _blank(given), f"no {name}").when(whole & found.isNull(), f"{name} does not parse"))
    listed = rows.withColumn("reason", F.explode(F.array_compact(F.array(*reasons))))
    record = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*(F.col(f"`{c}`") for c in values))))
    return listed.select(F.lit("csv").alias("source"), F.col("txn_id").alias("position"), "reason", record.alias("record"))


def read_sheet_csv(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """A spreadsheet exported as CSV, blanks normalised."""
    return blank_normalised(read_batch_csv(spark, path, line_breaks))


def blank_normalised(df: DataFrame) -> DataFrame:
    """Text ``nan``, ``None`` and nulls of text columns become blank."""

    def clean(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, T.StringType):
            return column
        return F.when(column.isNull() | column.isin("nan", "None"), "").otherwise(column).alias(field.name)

    return df.select(*(clean(f) for f in df.schema.fields))


def from_json_rows(rows: DataFrame) -> DataFrame:
    """JSON transactions (batch or stream) in canonical form.

    A missing date is the current time, countries are upper-cased, other missing text is blank. Rows
    without a ``txn_id`` (those of a stream, which knows no positions) get a random one, so that equal
    records stay apart; a sink that commits a micro-batch once keeps it.
    """
    text = [f.name for f in JSON_SCHEMA.fields if isinstance(f.dataType, T.StringType)]
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in text}
    row_id = F.col("txn_id") if "txn_id" in rows.columns else F.xxhash64(F.uuid())
    named = rows.select(
        row_id.alias("txn_id"),
        F.coalesce("transaction_date", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("ts"),
        F.col("amount").alias("amount"),
        blank["sender_account"].alias("sender_account"),
        blank["receiver_account"].alias("receiver_account"),
        F.upper(blank["sender_country"]).alias("sender_country"),
        F.upper(blank["receiver_country"]).alias("receiver_country"),
        F.coalesce("merchant_category_code", "mcc", F.lit("")).alias("mcc"),
        blank["merchant_name"].alias("merchant_name"),
        blank["card_number"].alias("card_number"),
        blank["receiver_first_name"].alias("receiver_first_name"),
        blank["receiver_last_name"].alias("receiver_last_name"),
        blank["payment_format"].alias("payment_format"),
        F.col("transaction_reference").alias("reference"),
    )
    return canonicalise(named)


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """All JSON records with their position as ``txn_id``; a line that does not parse is kept as text."""
    return with_row_ids(spark.read.schema(JSON_RECORD).json(path))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The records with an amount; ``json_rejects`` has the others."""
    return from_json_rows(json_records(spark, path).filter(F.col("amount").isNotNull()))


def json_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The records that cannot be scored, as they are: without an amount, or not JSON."""
    return json_records(spark, path).filter(F.col("amount").isNull())


def named_rejects(records: DataFrame, source: str) -> DataFrame:
    """Source, position, reason and record of JSON records (batch or stream) that cannot be scored; a stream knows no
    positions."""
    position = F.col("txn_id") if "txn_id" in records.columns else F.lit(None).cast("bigint")
    reason = F.when(F.col(CORRUPT).isNotNull(), "not JSON or of other types").otherwise("no amount")
    record = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*JSON_SCHEMA.fieldNames())))
    return records.filter(F.col("amount").isNull()).select(
        F.lit(source).alias("source"), position.alias("position"), reason.alias("reason"), record.alias("record")
    )
