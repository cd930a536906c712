"""Stored results: scored batches, exports, alert actions, and the model registry."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywatch.operators.rollups import is_high

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("model_version", T.StringType()),
        T.StructField("trained_at", T.TimestampType()),
        T.StructField("dataset_rows", T.LongType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("classifier_path", T.StringType()),
        T.StructField("forest_path", T.StringType()),
        T.StructField("codes_path", T.StringType()),
        T.StructField("raw_low", T.DoubleType()),
        T.StructField("raw_high", T.DoubleType()),
    ]
)


def save_scored(scored: DataFrame, path: str, batch_id: str) -> None:
    """One partition per batch. Writing a batch again replaces only that batch."""
    (
        scored.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def load_scored(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("batch_id") == batch_id).drop("batch_id")


def lookup_transaction(scored: DataFrame, txn_id: int) -> DataFrame:
    """A point lookup; on Parquet the predicate reaches the scan and skips row groups."""
    return scored.filter(F.col("txn_id") == F.lit(txn_id))


def export_columns(scored: DataFrame) -> dict[str, list[str]]:
    """The columns of each view of an export."""
    every = scored.columns
    training = [c for c in every if c.startswith("feature_")] + ["score", "risk_level"]
    return {"all_transactions": every, "high_risk": every, "medium_risk": every, "training_data": training}


def export_views(scored: DataFrame) -> DataFrame:
    """Every row as often as there are views that it belongs to, ``view`` naming them; columns that a view
    does not have are null."""
    views = {
        "all_transactions": F.lit(True),
        "high_risk": is_high(),
        "medium_risk": F.col("risk_level") == "MEDIUM",
        "training_data": F.lit(True),
    }
    named = F.array_compact(F.array(*(F.when(belongs, name) for name, belongs in views.items())))
    tagged = scored.withColumn("view", F.explode(named))
    training = export_columns(scored)["training_data"]
    hidden = {c: F.when(F.col("view") != "training_data", F.col(c)) for c in scored.columns if c not in training}
    return tagged.withColumns(hidden)


def write_export(scored: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """Writes the four views in one pass, a folder each."""
    views = export_views(scored)
    if fmt == "csv":
        views = views.drop(*(f.name for f in views.schema.fields if isinstance(f.dataType, T.ArrayType)))
    views.write.mode("overwrite").option("header", True).partitionBy("view").format(fmt).save(folder)


def read_export(spark: SparkSession, folder: str, view: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """One view of an export of rows with ``schema``; the other folders are not read."""
    kept = [f for f in schema.fields if fmt != "csv" or not isinstance(f.dataType, T.ArrayType)]
    rows = spark.read.schema(T.StructType(kept)).option("header", True).format(fmt).load(f"{folder}/view={view}")
    training = [c for c in rows.columns if c.startswith("feature_") or c in ("score", "risk_level")]
    return rows.select(*training) if view == "training_data" else rows


def append_actions(actions: DataFrame, path: str) -> None:
    """Alert actions are facts: they are only ever appended."""
    actions.select("alert_id", "action", "at", "note").write.mode("append").parquet(path)


def register_model(spark: SparkSession, path: str, **entry) -> None:
    """Appends one row to the registry; the models themselves lie under their version's folder."""
    entry.setdefault("trained_at", datetime.now(timezone.utc).replace(tzinfo=None))
    row = tuple(entry.get(name) for name in REGISTRY_SCHEMA.fieldNames())
    spark.createDataFrame([row], REGISTRY_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def latest_model(spark: SparkSession, path: str) -> dict | None:
    """The newest registry entry, or None when nothing was trained yet."""
    try:
        registry = spark.read.schema(REGISTRY_SCHEMA).parquet(path)
    except AnalysisException:
        return None
    entry = registry.agg(F.max_by(F.struct(*REGISTRY_SCHEMA.fieldNames()), "trained_at").alias("m")).first()["m"]
    return entry.asDict() if entry else None


def models_ready(spark: SparkSession, path: str) -> bool:
    """Both models of the newest entry are known."""
    entry = latest_model(spark, path)
    return bool(entry and entry["classifier_path"] and entry["forest_path"])


def model_status(spark: SparkSession, path: str) -> dict:
    entry = latest_model(spark, path) or {}
    ready = models_ready(spark, path)
    return {
        "ready": ready,
        "model_version": entry.get("model_version", "not-trained"),
        "trained_at": entry.get("trained_at"),
        "classifier_path": entry.get("classifier_path"),
        "forest_path": entry.get("forest_path"),
    }
