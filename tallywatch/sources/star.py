"""Transactions derived from the star-schema tables (events, customer, supplier)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch.session import ensure_checkpoint_dir

# Country per nation key and merchant code per last digit (FIXTURES.md, section 2).
NATION_ISO = (
    "USA GBR DEU FRA IRN JPN CAN NGA BRA IND CHE RUS SGP AUS ESP ITA PAK NLD SWE MEX ZAF CUB ARE POL KOR".split()
)
MERCHANT_CODES = "5411 7995 5812 6051 5541 4829 5999 5311 4111 5732".split()


# Known table schemas: reading with them needs no job to look into file footers.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def stream_events(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Event files as a stream: ``events*.parquet`` of a folder, or all files under a glob."""
    if "*" not in folder:
        options.setdefault("pathGlobFilter", "events*.parquet")
    return spark.readStream.schema(SCHEMAS["events"]).options(**options).parquet(folder)


def transactions(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """One transaction per event (of the table, or of a stream): its user pays one of the suppliers.

    Join strategies are left to the optimiser, which broadcasts a side only below its size limit.
    """
    events = read_table(spark, folder, "events") if events is None else events
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    supplier = read_table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    suppliers = supplier.count()

    chosen = (F.col("event_id") * 7919 + F.col("user_id") * 31) % suppliers
    events = events.select("event_id", "ts", "user_id", "event_type", "value", chosen.alias("supplier_key"))
    rows = events.join(customer, F.col("user_id") == F.col("c_custkey")).join(
        supplier, F.col("supplier_key") == F.col("s_suppkey")
    )

    iso = F.array(*map(F.lit, NATION_ISO))
    codes = F.array(*map(F.lit, MERCHANT_CODES))
    digit = ((F.col("event_id") * 13 + F.floor("value")) % 10).cast("int")
    mcc = F.get(codes, digit)
    card_tail = (F.col("event_id") % (1 + F.col("user_id") % 12)).cast("string")
    large = (F.col("value") * 200 > 30000) & (F.col("event_id") % 3 == 0)
    return rows.select(
        F.col("event_id").alias("txn_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 200).alias("amount"),
        F.col("c_name").alias("sender_account"),
        F.col("s_name").alias("receiver_account"),
        F.get(iso, F.col("c_nationkey")).alias("sender_country"),
        F.get(iso, F.col("s_nationkey")).alias("receiver_country"),
        mcc.alias("mcc"),
        F.concat(F.lit("Merchant "), mcc).alias("merchant_name"),
        F.concat(
            F.lit("4000"), F.lpad(F.col("user_id").cast("string"), 8, "0"), F.lpad(card_tail, 4, "0")
        ).alias("card_number"),
        F.lit("Cust").alias("sender_first_name"),
        F.col("user_id").cast("string").alias("sender_last_name"),
        F.concat(F.lit("R"), F.col("supplier_key").cast("string")).alias("receiver_first_name"),
        (F.col("event_id") % (1 + F.col("supplier_key") % 40)).cast("string").alias("receiver_last_name"),
        F.col("event_type").alias("payment_format"),
        F.when(large | (F.col("event_id") % 97 == 0), 1).otherwise(0).alias("label"),
    )


_STORED: dict[tuple, tuple] = {}


def _files(spark: SparkSession, folder: str) -> tuple:
    """Names, lengths and times of the files that the transactions are made from."""
    out = []
    for name in SCHEMAS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found]
    return tuple(sorted(out))


def transactions_table(spark: SparkSession, folder: str) -> DataFrame:
    """``transactions``, stored once per session in the shared folder.

    Scoring reads its input several times (statistics, key counts, rows): the tables are joined once,
    and later passes scan pruned columns. When a file changes, the tables are joined anew.
    """
    key = (spark.sparkContext.applicationId, folder, _files(spark, folder))
    if key not in _STORED:
        path = f"{ensure_checkpoint_dir(spark)}/transactions-{uuid.uuid4().hex}"
        rows = transactions(spark, folder)
        rows.write.parquet(path)
        _STORED[key] = (path, rows.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)
