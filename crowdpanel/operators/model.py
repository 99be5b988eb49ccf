"""Counterfactual models, baselines and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import share_if
from .aggregates import exact_quantiles

# Feature order of the counterfactual. No event feature, and not the
# hour-grain reporting count, which would leak the target.
FEATURES = (
    "unit_code", "base_k2", "base_k4", "base_cap120", "n_cap120", "hour", "dow", "month", "t_index", "n_poi_live",
    "n_poi", "food_share", "dist_m", "bearing_deg", "temp_hr", "prcp_hr", "wind_hr", "holiday",
)
UNKNOWN = -1.0
NOMINAL = ("unit_code",)


def prepare(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles; NULLs become a constant plus a 0/1 indicator column."""
    out = df
    for f in features:
        out = out.withColumn(f"x_{f}", F.coalesce(F.col(f).cast("double"), F.lit(UNKNOWN))).withColumn(
            f"m_{f}", F.col(f).isNull().cast("double"))
    return out


def fit_counterfactual(rows: DataFrame, features: Sequence[str] = FEATURES, label: str = "y", seed: int = 0,
                       trees: int = 100, depth: int = 5, bins: int = 512, nominal: Sequence[str] = NOMINAL) -> PipelineModel:
    """Boosted trees on control rows only, log target. Distributed over the rows.

    ``nominal`` features are split by sets of values, not by order. Values that no control row has share one further
    category, so rows of unseen units are predicted too. ``bins`` grows to the number of categories where that is larger.
    """
    columns = [p + f for f in features for p in ("x_", "m_")]
    train = prepare(rows.filter("is_control"), features).select(*columns, label)
    stages = []
    codes = [f for f in features if f in nominal]
    if codes:
        indexer = StringIndexer(inputCols=[f"x_{f}" for f in codes], outputCols=[f"u_{f}" for f in codes], handleInvalid="keep",
                                stringOrderType="alphabetAsc").fit(train)
        bins = max(bins, *[len(values) + 1 for values in indexer.labelsArray])
        columns = [("u_" if p == "x_" and f in codes else p) + f for f in features for p in ("x_", "m_")]
        stages.append(indexer)
    stages += [VectorAssembler(inputCols=columns, outputCol="features"),
               GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, maxBins=bins, stepSize=0.1, seed=seed,
                            predictionCol="cf_log")]
    return Pipeline(stages=stages).fit(train)


def predict_cf(model: PipelineModel, rows: DataFrame, features: Sequence[str] = FEATURES, leaves: str | None = None) -> DataFrame:
    """Rows with the counterfactual ``cf_log`` and, where a name is given, the leaf the row reaches in each tree."""
    made = [p + f for f in features for p in ("x_", "m_", "u_")] + ["features"]
    ready = prepare(rows, features)
    if leaves is None:
        return model.transform(ready).drop(*made)
    out = model.transform(ready, {model.stages[-1].leafCol: leaves})
    return out.withColumn(leaves, vector_to_array(leaves).cast("array<int>")).drop(*made)


def tree_weights(model: PipelineModel) -> list[float]:
    """How much each tree of the fitted ensemble counts."""
    return [abs(float(w)) for w in model.stages[-1].treeWeights]


def how_baselines(train: DataFrame, test: DataFrame, y: str = "y", unit: str = "unit_id") -> DataFrame:
    """Test rows with the hour-of-week mean of their unit (global one as fallback) and globally."""
    how = ["dow", "hour"]
    per_unit = train.groupBy(unit, *how).agg(F.avg(y).alias("_unit"))
    overall = train.groupBy(*how).agg(F.avg(y).alias("how_global"))
    out = test.join(per_unit, [unit, *how], "left").join(overall, how, "left")
    return out.withColumn("how_unit", F.coalesce("_unit", "how_global")).drop("_unit")


def scores(df: DataFrame, y: Column, p: Column, by: Sequence[str] = ()) -> DataFrame:
    """n, MAE, RMSE, bias and R2 per group from one aggregate."""
    e = p - y
    s = df.filter(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.sum(e * e).alias("_sse"), F.var_pop(y).alias("_var"))
    return s.withColumn("r2", 1 - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n"))).drop("_sse", "_var")


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Both predictors on the rows they share: MAE, RMSE and percent improvement of b on a."""
    both = a.select(*keys, y, F.col(pred).alias("_a")).join(b.select(*keys, F.col(pred).alias("_b")), list(keys))
    ea, eb = F.col("_a") - F.col(y), F.col("_b") - F.col(y)
    out = both.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull()).agg(
        F.count("*").alias("n"), F.avg(F.abs(ea)).alias("mae_a"), F.avg(F.abs(eb)).alias("mae_b"),
        F.sqrt(F.avg(ea * ea)).alias("rmse_a"), F.sqrt(F.avg(eb * eb)).alias("rmse_b"))
    return out.withColumn("improvement_pct", 100 * (F.col("mae_a") - F.col("mae_b")) / F.col("mae_a"))


def residual_interval(valid: DataFrame, test: DataFrame, keys: Sequence[str], y: str = "y", p: str = "cf_log",
                      level: float = 0.90, accuracy: int = 10000) -> DataFrame:
    """Test rows with lo and hi: prediction plus validation-residual percentiles per key."""
    tail = (1 - level) / 2
    r = F.col(y) - F.col(p)
    q = valid.groupBy(*keys).agg(F.percentile_approx(r, F.lit(tail), F.lit(accuracy)).alias("_lo"),
                                 F.percentile_approx(r, F.lit(1 - tail), F.lit(accuracy)).alias("_hi"))
    return test.join(q, list(keys), "left").withColumn("lo", F.col(p) + F.col("_lo")).withColumn(
        "hi", F.col(p) + F.col("_hi")).drop("_lo", "_hi")


def leaf_interval(valid: DataFrame, test: DataFrame, leaves: str, weights: Sequence[float], y: str = "y", p: str = "cf_log",
                  level: float = 0.90) -> DataFrame:
    """Test rows with lo and hi: prediction plus residual quantiles of the leaves a row reaches, weighted over trees.

    ``leaves`` holds the row's leaf number (from 0) in each tree. Quantiles are exact and come from the validation rows of the
    same leaf; a leaf without any takes those of all validation rows, and without validation rows lo and hi are NULL.
    The table of leaves is one row of at most trees x leaves entries, whatever the size of the data, so test rows are not shuffled.
    """
    tail = (1 - level) / 2
    ends = {"lo": tail, "hi": 1 - tail}
    errors = valid.select((F.col(y) - F.col(p)).alias("_r"), F.col(leaves).alias("_leaves"))
    per_leaf = exact_quantiles(errors.select("_r", F.posexplode("_leaves").alias("_tree", "_leaf")), "_r", ends, ["_tree", "_leaf"])
    known = F.map_from_entries(F.collect_list(F.struct("_leaf", F.struct("lo", "hi"))))
    trees = per_leaf.groupBy("_tree").agg(known.alias("_known"), F.max("_leaf").alias("_top")).select(
        "_tree", F.transform(F.sequence(F.lit(0), "_top"), lambda i: F.try_element_at("_known", i)).alias("_ends"))
    table = trees.agg(F.sort_array(F.collect_list(F.struct("_tree", "_ends"))).alias("_trees"))
    overall = exact_quantiles(errors, "_r", ends).select(F.struct("lo", "hi").alias("_overall"))
    wide = test.join(F.broadcast(table)).join(F.broadcast(overall))
    each = F.zip_with(leaves, "_trees", lambda leaf, tree: F.coalesce(F.get(tree["_ends"], leaf), F.col("_overall")))
    counted = wide.withColumn("_each", F.zip_with(each, F.array(*[F.lit(float(w)) for w in weights]), lambda e, w: F.struct(
        (e["lo"] * w).alias("lo"), (e["hi"] * w).alias("hi"))))
    made = {end: F.col(p) + F.aggregate(F.col("_each")[end], F.lit(0.0), lambda acc, x: acc + x) / F.lit(float(sum(weights)))
            for end in ends}
    return counted.withColumns(made).drop("_trees", "_overall", "_each")


def interval_coverage(df: DataFrame, y: str = "y") -> DataFrame:
    """One row: share of rows inside their interval."""
    return df.agg(F.count("*").alias("n"), share_if(F.col(y).between(F.col("lo"), F.col("hi"))).alias("coverage"))


def standardize(df: DataFrame, columns: Sequence[str], split: str = "split", train: str = "train") -> tuple[DataFrame, DataFrame]:
    """(scaled, stats): mean and population sd of the training split applied to all rows; sd 0 counts as 1."""
    rows = df.filter(F.col(split) == train)
    stats = rows.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns],
                     *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_sd") for c in columns])
    scaled = df.join(F.broadcast(stats))
    z = [((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")).alias(f"{c}_z") for c in columns]
    return scaled.select(*df.columns, *z), stats


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """0/1 columns of the listed values."""
    return df.select("*", *[(F.coalesce(F.col(column) == v, F.lit(False))).cast("int").alias(f"{column}_{v}") for v in values])


def feature_contract(df: DataFrame, features: Sequence[str] = FEATURES) -> list[str]:
    """Problems of a frame against the feature order: missing, misplaced or non-numeric."""
    names = [c for c in df.columns if c in features]
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean"}
    bad = [f"missing {f}" for f in features if f not in names]
    bad += [f"type of {c}" for c, t in df.dtypes if c in features and t not in numeric]
    if not bad and names != list(features):
        bad.append("order")
    return bad


def unknown_codes(df: DataFrame, codes: DataFrame, unit: str = "unit_id") -> DataFrame:
    """One row: rows and distinct units without a known code."""
    lost = df.join(codes.select(unit), unit, "left_anti")
    return lost.agg(F.count("*").alias("n_rows"), F.countDistinct(unit).alias("n_units"))
