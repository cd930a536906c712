"""Training, storing and loading the two models, and scoring batches with them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.operators import attribution, boosting, forest, hybrid, quality
from tallywatch.operators.features import PaymentCodes, build_features, fit_payment_codes
from tallywatch.operators.rules import AmountStats, amount_stats, score_rules, with_texts
from tallywatch.schema import CANONICAL, canonicalise, has
from tallywatch.session import ensure_checkpoint_dir
from tallywatch.sources import tables


@dataclass(frozen=True)
class Models:
    """What scoring needs: classifier, forest, format codes, raw range, attribution tables."""

    classifier: boosting.Booster
    forest: forest.Forest
    codes: PaymentCodes | None
    raw_low: float
    raw_high: float
    leaf_tables: attribution.LeafTables
    version: str


def train_models(
    df: DataFrame,
    store: str,
    rounds: int = C.BOOST_ROUNDS,
    trees: int = C.FOREST_TREES,
) -> dict:
    """Trains both models on canonical rows, stores them, and appends metrics to the registry.

    Labelled rows train on 80 % and are measured on the other 20 %; without positive labels the
    most anomalous rows stand in for them and there are no metrics. The feature table is written
    once and read back, so no later pass computes it again.
    """
    spark = df.sparkSession
    trained_at = datetime.now(timezone.utc).replace(tzinfo=None)
    version = f"v{trained_at:%Y%m%d%H%M}-{uuid.uuid4().hex[:6]}"
    root = f"{store}/{version}"

    stats = amount_stats(df)
    codes = fit_payment_codes(df) if has(df, "payment_format") else None
    if codes is not None:
        codes.table.write.parquet(f"{root}/codes")
        codes = load_codes(spark, f"{root}/codes")
    build_features(df, stats, codes).write.parquet(f"{root}/features")
    features = spark.read.parquet(f"{root}/features")

    nodes, size = forest.fit_forest(features, stats.rows, trees=trees)
    nodes.withColumn("sample_size", F.lit(size)).write.parquet(f"{root}/forest")
    grown = load_forest(spark, f"{root}/forest")
    raw = forest.with_anomaly_raw(features, grown)
    raw.write.parquet(f"{root}/raw")
    low, high = hybrid.raw_range(spark.read.parquet(f"{root}/raw"))

    metrics: dict = {"precision": None, "recall": None, "f1": None}
    counts, test = quality.class_counts(features)[:2] if "label" in features.columns else (0, 0), None
    if counts[0] > 0:
        parts = quality.stratified_split(features)
        train, test = parts.filter(~F.col("is_test")), parts.filter("is_test")
        fitted = boosting.fit_classifier(train, quality.class_counts(train)[:2], f"{root}/bins", rounds=rounds)
    else:
        synthetic = quality.weak_labels(spark.read.parquet(f"{root}/raw"))
        counts = quality.class_counts(synthetic)[:2]
        fitted = boosting.fit_classifier(synthetic, counts, f"{root}/bins", False, rounds, C.BOOST_DEPTH_WEAK)
    fitted.coalesce(1).write.parquet(f"{root}/classifier")
    classifier = boosting.load_classifier(spark, f"{root}/classifier")
    if test is not None:
        measured = quality.classifier_metrics(boosting.with_probability(test, classifier)).first()
        metrics = {name: measured[name] for name in metrics}

    entry = {
        "model_version": version,
        "trained_at": trained_at,
        "dataset_rows": stats.rows,
        **metrics,
        "classifier_path": f"{root}/classifier",
        "forest_path": f"{root}/forest",
        "codes_path": f"{root}/codes" if codes is not None else None,
        "raw_low": low,
        "raw_high": high,
    }
    tables.register_model(spark, f"{store}/registry", **entry)
    return entry


def load_codes(spark: SparkSession, path: str) -> PaymentCodes:
    return PaymentCodes(spark.read.parquet(path))


def load_forest(spark: SparkSession, path: str) -> forest.Forest:
    nodes = spark.read.parquet(path)
    return forest.Forest.from_nodes(nodes.drop("sample_size"), nodes.select("sample_size").first()[0])


def load_models(spark: SparkSession, store: str) -> Models | None:
    """The newest trained models, or None when there are none."""
    entry = tables.latest_model(spark, f"{store}/registry")
    if not entry or not entry["classifier_path"] or not entry["forest_path"]:
        return None
    return Models(
        classifier=boosting.load_classifier(spark, entry["classifier_path"]),
        forest=load_forest(spark, entry["forest_path"]),
        codes=load_codes(spark, entry["codes_path"]) if entry["codes_path"] else None,
        raw_low=entry["raw_low"],
        raw_high=entry["raw_high"],
        leaf_tables=attribution.build_tables(spark.read.parquet(entry["classifier_path"])),
        version=entry["model_version"],
    )


def with_model_columns(featured: DataFrame, models: Models) -> DataFrame:
    """Adds raw anomaly, probability and attributions to rows that carry the features."""
    raw = forest.with_anomaly_raw(featured, models.forest)
    rated = boosting.with_probability(raw, models.classifier).drop("prediction")
    return attribution.with_attributions(rated, models.leaf_tables)


def score_batch(
    df: DataFrame,
    profile: C.RuleProfile = C.V3,
    models: Models | None = None,
    penalise: bool = False,
) -> DataFrame:
    """Rules, and models when there are any: blended score, attributions, optional penalty.

    With models the levels are those of v3 in either profile. The rows carry their rule scores
    through the feature shuffle, so no join brings the two together. Because the anomaly is rescaled
    by the range of the whole batch, the modelled rows are stored before the range is taken:
    the Python scoring runs once.
    """
    scored = score_rules(df, profile)
    if models is None:
        return hybrid.without_models(scored)
    spark = df.sparkSession
    carried = tuple(c for c in scored.columns if c != "txn_id")
    featured = build_features(scored, codes=models.codes, keep=carried, source=df)
    rated = with_model_columns(featured, models).drop(*(c for c in C.FEATURE_COLUMNS if c not in scored.columns))
    path = f"{ensure_checkpoint_dir(spark)}/rated-{uuid.uuid4().hex}"
    rated.write.parquet(path)
    rated = spark.read.schema(rated.schema).parquet(path)
    return blend(rated, *hybrid.raw_range(rated), penalise)


def blend(rated: DataFrame, low: float | None, high: float | None, penalise: bool = False) -> DataFrame:
    """Final score and level from rule score, raw anomaly and probability."""
    anomaly = hybrid.rescaled_anomaly(F.col("anomaly_raw"), low, high)
    model = hybrid.model_score(anomaly, F.col("probability"))
    merged = rated.withColumn("model_score", model).withColumn(
        "score", hybrid.merged_score(F.col("score"), F.col("model_score"))
    )
    return hybrid.apply_penalty(merged, C.V3) if penalise else with_texts(merged, C.V3)


def alert_attributions(alerts: DataFrame, models: Models, n: int = 5) -> DataFrame:
    """(alert_id, attributions) computed anew from the stored fields of alerts.

    An alert is explained as a lone record: no spread, velocities of 1, a new payee.
    """
    names = [f for f in CANONICAL.fieldNames() if f != "txn_id"]
    fields = F.from_json("all_fields", ", ".join(f"{name} string" for name in names))
    parsed = alerts.select("alert_id", "txn_id", fields.alias("f")).select("alert_id", "txn_id", "f.*")
    rows = canonicalise(parsed, keep=("alert_id",))
    features = build_features(rows, AmountStats(rows=1), models.codes, keep=("alert_id",), stateless=True)
    return attribution.with_attributions(features, models.leaf_tables, n).select("alert_id", "attributions")
