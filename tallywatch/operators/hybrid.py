"""Blending rule scores with model scores, and penalties from attributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.functions import text as X
from tallywatch.functions.numbers import clipped
from tallywatch.operators.rules import with_texts

ATTRIBUTION_TYPE = "array<struct<feature:string,label:string,impact:double>>"


def raw_range(df: DataFrame, raw: str = "anomaly_raw") -> tuple[float | None, float | None]:
    """Lowest and highest raw anomaly score of a batch: one row of facts."""
    return tuple(df.agg(F.min(raw), F.max(raw)).first())


def rescaled_anomaly(raw: Column, low: float | None, high: float | None) -> Column:
    """1 for the most anomalous row of the range, 0 for the least; no span divides by 1.

    Rows outside a stored range (a stream's, say) are kept within 0 and 1.
    """
    if low is None or high is None:
        return F.lit(None).cast("double")
    span = high - low if high > low else 1.0
    return clipped(1.0 - (raw - F.lit(low)) / F.lit(span), 0.0, 1.0)


def model_score(anomaly: Column, probability: Column) -> Column:
    """0..100 from the rescaled anomaly and the class-1 probability."""
    return clipped((C.ANOMALY_WEIGHT * anomaly + C.CLASSIFIER_WEIGHT * probability) * 100, 0.0, 100.0)


def merged_score(rule_score: Column, model: Column) -> Column:
    """Weighted mean of rule and model score, rounded half to even."""
    return F.rint(clipped(C.RULE_WEIGHT * rule_score + C.MODEL_WEIGHT * model, 0.0, 100.0)).cast("int")


def top_attributions(impacts: dict[str, Column], n: int = C.TOP_ATTRIBUTIONS) -> Column:
    """The n strongest impacts of a row, negligible ones left out, rounded to four places.

    Equal strengths keep the order of ``impacts``: the sort key is (-strength, position).
    """
    entries = F.array(
        *(
            F.struct(
                (-F.abs(impact)).alias("weakness"),
                F.lit(i).alias("position"),
                F.lit(name).alias("feature"),
                impact.alias("impact"),
            )
            for i, (name, impact) in enumerate(impacts.items())
        )
    )
    strongest = F.slice(F.array_sort(entries), 1, n)
    notable = F.filter(strongest, lambda e: F.abs(e["impact"]) > C.MIN_IMPACT)
    return F.transform(
        notable,
        lambda e: F.struct(
            e["feature"].alias("feature"),
            X.feature_label(e["feature"]).alias("label"),
            F.round(e["impact"], 4).alias("impact"),
        ),
    )


def _penalties(attributions: Column) -> Column:
    """(label, points) of every attribution that costs points."""

    def points(entry: Column) -> Column:
        steps = ((entry["impact"] - 1.0) * C.PENALTY_SLOPE).cast("int")
        return F.least(steps, F.lit(C.PENALTY_EACH))

    strong = F.filter(attributions, lambda e: e["impact"] >= C.PENALTY_MIN_IMPACT)
    scored = F.transform(strong, lambda e: F.struct(e["label"].alias("label"), points(e).alias("points")))
    return F.filter(scored, lambda e: e["points"] > 0)


def apply_penalty(scored: DataFrame, profile: C.RuleProfile = C.V3) -> DataFrame:
    """Adds the attribution penalty to score, flags and breakdown, and sets the level anew.

    Expects an ``attributions`` column. Everything is array expressions on the row.
    """
    items = scored.withColumn("_penalties", _penalties(F.coalesce("attributions", F.array().cast(ATTRIBUTION_TYPE))))
    summed = F.aggregate("_penalties", F.lit(0), lambda total, e: total + e["points"])
    items = items.withColumn("_penalty", F.least(summed, F.lit(C.PENALTY_TOTAL)))
    reasons = F.transform(
        "_penalties",
        lambda e: F.concat(
            F.lit("AI Risk Indicator: "), e["label"], F.lit(" (+"), e["points"].cast("string"), F.lit(" pts)")
        ),
    )
    part = F.concat(F.lit("ML Interpretability Penalty +"), F.col("_penalty").cast("string"))
    adjusted = items.withColumns(
        {
            "score": F.least(F.col("score") + F.col("_penalty"), F.lit(C.SCORE_CAP)).cast("int"),
            "flags": F.concat("flags", reasons),
            "breakdown": F.when(F.col("_penalty") > 0, F.array_append("breakdown", part)).otherwise(F.col("breakdown")),
        }
    )
    return with_texts(adjusted.drop("_penalties", "_penalty"), profile)


def without_models(scored: DataFrame) -> DataFrame:
    """The rule score stands and there is nothing to attribute."""
    return scored.withColumn("attributions", F.array().cast(ATTRIBUTION_TYPE))
