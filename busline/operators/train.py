"""Training data, gates, metrics and the tree models (pyspark.ml)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from busline import contracts as C
from busline.functions import scalars
from busline.operators import eta

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
PLACE = ["route_id", "stop_id"]
#: Values that trees tell apart in a feature (the trainer's own default).
BINS = 32


# --- gates and metrics ------------------------------------------------------------------------

def sufficiency(history: DataFrame, records: DataFrame, as_of_ms: int, limits: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """One row: age of the history in days (30-day look-back), record count, stops with enough
    recent records, reasons and the verdict. The seasonal count is reported and does not gate."""
    one = history.filter(F.col("t") >= as_of_ms - 30 * DAY_MS).agg(
        F.coalesce(F.greatest(F.lit(0.0), (as_of_ms - F.min("t")) / F.lit(float(DAY_MS))), F.lit(0.0)).alias("history_days"))
    one = one.withColumn("record_count", records.agg(F.count("*")).scalar()).withColumn(
        "ready_stops", ready_stops(records, as_of_ms, limits).scalar())
    reasons = F.array_compact(F.array(
        F.when(F.col("history_days") < limits.retrain_days,
               F.format_string(f"history_days %.1f < {limits.retrain_days}", "history_days")),
        F.when(F.col("record_count") < limits.retrain_records,
               F.format_string(f"eta_records %d < {limits.retrain_records}", "record_count"))))
    return one.withColumn("reasons", F.array_join(reasons, "; ")).withColumn(
        "sufficient", F.col("reasons") == "")


def ready_stops(records: DataFrame, as_of_ms: int, limits: C.Thresholds = C.DEFAULTS, least: int = 10) -> DataFrame:
    recent = records.filter(F.col("t") >= as_of_ms - limits.seasonal_hours * HOUR_MS)
    return recent.groupBy(*PLACE).count().filter(F.col("count") >= least).agg(F.count("*").alias("ready_stops"))


def error_metrics(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    gap = F.col(actual) - F.col(predicted)
    return df.groupBy(*(by or [])).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"),
                                       F.count("*").alias("n"))


def classification_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy and weighted F1 from confusion counts; one row."""
    cells = df.groupBy(label, predicted).agg(F.count("*").alias("n"))
    # the confusion table has at most classes x classes rows
    of_label, of_pred = Window.partitionBy(label), Window.partitionBy(predicted)
    sized = cells.withColumns({"support": F.sum("n").over(of_label), "guessed": F.sum("n").over(of_pred)})
    hit = F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)
    per_label = sized.groupBy(label).agg(
        F.sum(hit).alias("tp"), F.first("support").alias("support"),
        F.max(F.when(F.col(label) == F.col(predicted), F.col("guessed"))).alias("guessed"))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("support") + F.col("guessed"))).otherwise(0.0)
    return per_label.agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                         (F.sum(f1 * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def promotable(metrics: DataFrame, limits: C.Thresholds = C.DEFAULTS) -> DataFrame:
    return metrics.filter(F.col("rmse") < limits.promote_rmse)


# --- hourly series -----------------------------------------------------------------------------

def hourly_means(records: DataFrame) -> DataFrame:
    """Mean arrival estimate per (route, stop, hour); hours without records do not appear."""
    return (records.withColumn("hour_ms", F.col("t") - F.pmod(F.col("t"), F.lit(HOUR_MS)))
            .groupBy(*PLACE, "hour_ms").agg(F.avg("eta_seconds").alias("eta_seconds")))


def hold_out(hourly: DataFrame) -> DataFrame:
    """Mark the last min(24, n div 4) hours of each series. A series is as long as the calendar."""
    series = Window.partitionBy(*PLACE)
    newest = F.row_number().over(series.orderBy(F.desc("hour_ms")))
    n = F.count("*").over(series)
    return hourly.withColumns({"n_hours": n, "held_out": newest <= F.least(F.lit(24), F.floor(n / 4))})


# --- tree models -------------------------------------------------------------------------------

def split_by_hash(df: DataFrame, keys: list[str], train_share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the row's identity: the same on every run and cluster size."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(1000))
    edge = int(round(train_share * 1000))
    return df.filter(bucket < edge), df.filter(bucket >= edge)


def eta_features(records: DataFrame) -> DataFrame:
    """Records with the tree model's inputs and target."""
    at = F.timestamp_millis("t")
    columns = eta.feature_columns(F.col("distance_m"), F.col("speed_ms"), F.col("stops_remaining"), at)
    keep = [c for c in records.columns if c not in columns]
    return records.select(*keep, *[c.alias(n) for n, c in columns.items()])


def standing_values(rows: DataFrame, features: list[str], most: int = BINS) -> dict[str, list[float]]:
    """Up to ``most`` ascending values per feature: all that it has if they are so few, else the middles of equal shares of the rows."""
    middles = [(2 * i + 1) / (2 * most) for i in range(most)]
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in features}
    told = rows.agg(*[F.percentile_approx(v, middles, 10_000).alias(c) for c, v in clean.items()],
                    *[F.approx_count_distinct(v).alias(f"_n_{c}") for c, v in clean.items()]).first()
    few = [c for c in features if told[f"_n_{c}"] <= 2 * most]
    found = rows.agg(*[F.collect_set(clean[c]).alias(c) for c in few]).first() if few else {}
    return {c: sorted(found[c] if c in few and len(found[c]) <= most else set(told[c] or [])) for c in features}


def snapped(value: Column, values: list[float]) -> Column:
    """The nearest of ascending values, halfway the lower one; NULL and NaN are above all, as in a tree."""
    if len(values) < 2:
        return F.lit(values[0] if values else None).cast("double")
    middle = len(values) // 2
    cut = (values[middle - 1] + values[middle]) / 2.0
    return F.when(value <= cut, snapped(value, values[:middle])).otherwise(snapped(value, values[middle:]))


def merged(rows: DataFrame, features: list[str], label: str, most: int = BINS) -> DataFrame:
    """Rows between the same cuts as one row: snapped features, mean label, and their number as ``weight``.

    A tree cuts halfway between values that stand next to each other, so it sends a row and the merged row to the same leaf,
    and the gain of a cut and the value of a leaf are those of the single rows. The number of merged rows is bounded by the
    values, not by the input. They are dealt and ordered by their features.
    """
    values = standing_values(rows, features, most)
    cells = rows.select(*[snapped(F.col(c), values[c]).alias(c) for c in features], F.col(label).cast("double").alias(label)).groupBy(*features).agg(
        F.when(F.count(label) == F.count("*"), F.avg(label)).alias(label), F.count("*").cast("double").alias("weight"))
    return cells.repartition(rows.sparkSession.sparkContext.defaultParallelism, *features).sortWithinPartitions(*features)


def train_eta_model(train: DataFrame, trees: int = 100, depth: int = 6, seed: int = 42) -> PipelineModel:
    """Boosted trees on merged rows, of which each tree draws four fifths; the cost of a tree does not grow with the records."""
    assembler = VectorAssembler(inputCols=C.ETA_FEATURES, outputCol="features", handleInvalid="keep")
    model = GBTRegressor(featuresCol="features", labelCol="eta_seconds", predictionCol="tree_eta", maxIter=trees, weightCol="weight", maxBins=BINS,
                         maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    cells = merged(train, C.ETA_FEATURES, "eta_seconds").persist()
    try:
        return Pipeline(stages=[assembler, model]).fit(cells)
    finally:
        cells.unpersist()


def score_eta(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("features")


def regression_metrics(scored: DataFrame, label: str = "eta_seconds", prediction: str = "tree_eta") -> dict[str, float]:
    grade = RegressionEvaluator(labelCol=label, predictionCol=prediction)
    return {m: grade.evaluate(scored, {grade.metricName: m}) for m in ("rmse", "mae")}


def train_crowd_model(train: DataFrame, trees: int = 100, depth: int = 6, seed: int = 42,
                      minimum_rows: int = 50) -> PipelineModel | None:
    """Occupancy classifier, or None when there is too little data."""
    if train.limit(minimum_rows).count() < minimum_rows:
        return None
    # the label index is fixed by order, so class numbers keep their meaning
    index = StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep")
    assembler = VectorAssembler(inputCols=C.CROWD_FEATURES, outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label_index", numTrees=trees, maxDepth=depth,
                                    seed=seed)
    return Pipeline(stages=[index, assembler, forest]).fit(train.withColumn("label", F.col("label").cast("string")))


def classifier_metrics(scored: DataFrame) -> dict[str, float]:
    grade = MulticlassClassificationEvaluator(labelCol="label_index", predictionCol="prediction")
    return {"accuracy": grade.evaluate(scored, {grade.metricName: "accuracy"}),
            "weighted_f1": grade.evaluate(scored, {grade.metricName: "f1"})}


def historical_score(model: PipelineModel | None, requests: DataFrame) -> DataFrame:
    """``historical`` score of each request: the model's class, or the rush-hour rule without a model."""
    at = F.timestamp_millis("t")
    if model is None:
        return requests.withColumn("historical", scalars.cold_start_score(at))
    labels = model.stages[0].labels
    ready = requests.withColumns({
        "direction_id": F.coalesce("direction_id", F.lit(0)), "stop_sequence": F.lit(1), "hour_of_day": F.hour(at),
        "day_of_week": F.weekday(at), "is_weekend": scalars.is_weekend(at), "label": F.lit(labels[0])})
    names = F.array(*[F.lit(int(x)) for x in labels])
    scored = model.transform(ready).withColumn("_class", F.get(names, F.col("prediction").cast("int")))
    return scored.withColumn("historical", scalars.class_score(F.col("_class"))).select(*requests.columns, "historical")


def load_model(path: str) -> PipelineModel | None:
    """Stored model, or None so that callers fall back to physics."""
    try:
        return PipelineModel.load(path)
    except Exception as error:  # noqa: BLE001 - any unreadable model means "no model"
        if "does not exist" in str(error) or "PATH_NOT_FOUND" in str(error) or "empty" in str(error):
            return None
        raise
