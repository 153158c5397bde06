"""Train -> register -> forecast, end to end (TRN6-9, MOD3, FCT1-6, SNK3).

``forecast_run`` resolves one model per dataset from a run's registry,
builds each requested series (dataset totals, or a category/region segment
scored with the dataset's model, as the reference does), and dispatches on
the model kind: recursive tree forecast + RMSE band, or the additive
model's direct forecast + residual band.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.operators import forecast as fc
from tidemark.operators.selection import current_active, resolve_model
from tidemark.operators.training import TrainingRun


SERIES_PER_TASK = 256       # series of one model that a task holds


def forecast_run(run: TrainingRun, sales: DataFrame, horizon: int = 30,
                 algorithm: str | None = None, category: str | None = None,
                 region: str | None = None, segment_keys: Sequence[str] = ()) -> DataFrame:
    """FCT5: forecast points (keys, step, target_date, predicted_revenue,
    lower_bound, upper_bound, confidence_score, algorithm, model_id)."""
    fc.check_horizon(horizon)
    spark = sales.sparkSession
    keys = run.keys
    series_keys = keys + [k for k in segment_keys if k not in keys]
    # One row per dataset: small, read by several branches below.
    models = resolve_model(current_active(run.registry, keys), keys, algorithm).cache()
    kinds = {r["kind"] for r in models.select("kind").distinct().collect()}
    if not kinds:
        raise LookupError("No trained model found for these datasets.")
    daily = agg.daily_revenue(fc.segment_filter(sales, category, region), series_keys)
    parts = []
    if "tree" in kinds:
        tree_models = models.where(F.col("kind") == "tree")
        nodes = fc.tree_nodes(spark, tree_models)
        has_index = "series_index" in tree_models.columns
        pooled = has_index and tree_models.where(F.col("series_index").isNotNull()) \
            .limit(1).count() > 0
        extra = (F.when(F.col("series_index").isNotNull(), F.array(F.col("series_index")))
                 .otherwise(F.array().cast("array<double>")) if has_index
                 else F.array().cast("array<double>"))
        # one row per dataset: Spark broadcasts it if it is small
        series_model = tree_models.select(*keys, fc.local_path(F.col("file_path")).alias("_model"),
                                          extra.alias("_extra"))
        tagged = daily.join(series_model, keys)
        # Many series per model (segments, or one pooled model) are dealt to
        # as many groups as their number asks for.
        salt = 1
        if len(series_keys) > len(keys) or pooled:
            salt = -(-max(1, tagged.select(*series_keys).distinct().count()) // SERIES_PER_TASK)
        points = fc.recursive_forecast(tagged, nodes, series_keys, horizon, salt=salt)
        parts.append(fc.tree_band(points, tree_models, series_keys, keys)
                     .join(tree_models.select(*keys, "algorithm", "model_id"), keys))
    if "nodes" in kinds:        # models of a grouped run: rows of its node table
        node_models = models.where(F.col("kind") == "nodes")
        series_model = node_models.select(*keys, F.col("model_id").alias("_model"),
                                          F.array().cast("array<double>").alias("_extra"))
        tagged = daily.join(series_model, keys)
        salt = 1
        if len(series_keys) > len(keys):
            per_model = tagged.groupBy("_model").agg(F.countDistinct(F.struct(*series_keys)).alias("n"))
            salt = -(-(per_model.agg(F.max("n")).first()[0] or 1) // SERIES_PER_TASK)
        points = fc.recursive_forecast(tagged, fc.stored_nodes(spark, node_models), series_keys, horizon, salt=salt)
        parts.append(fc.tree_band(points, node_models, series_keys, keys)
                     .join(node_models.select(*keys, "algorithm", "model_id"), keys))
    if "additive" in kinds:
        add_models = models.where(F.col("kind") == "additive")
        parts.append(fc.additive_forecast(daily, add_models, series_keys, keys, horizon)
                     .withColumn("error", F.lit(None).cast("string"))
                     .join(add_models.select(*keys, "algorithm", "model_id"), keys))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
