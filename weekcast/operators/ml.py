"""Machine learning operators (M1-M7, C15, C16) on ``pyspark.ml``.

Training is distributed by MLlib itself (split statistics are aggregated by
executors); nothing is collected to the driver except the fitted model.
Seeds are fixed so runs repeat.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekcast.operators.windows import rank_within_groups
from weekcast.sources.sinks import materialize


def split_by_week(df: DataFrame, week_col: str, last_train_week) -> tuple[DataFrame, DataFrame]:
    """Time-based split (M7, F19): train = week <= last_train_week, test = the rest."""
    w = F.col(week_col).cast("int")
    return df.filter(w <= int(last_train_week)), df.filter(w > int(last_train_week))


def decision_tree_model(categorical=("holiday", "promotion"), numeric=("pro_percent",),
                        label: str = "qty", seed: int = 42, max_depth: int = 5,
                        max_bins: int = 32) -> Pipeline:
    """StringIndexer per category (unseen labels kept, M1) -> VectorAssembler (M2) ->
    DecisionTreeRegressor (M3), as one Pipeline (M4).

    The tree takes at most ``maxBins`` (32) labels a category, which bounds the indexers'
    lists; ``category_index`` is for columns with more.  A numeric feature with fewer distinct
    values than ``max_bins`` is split exactly: every threshold between two values is tried.
    """
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_in", handleInvalid="keep")
           for c in categorical]
    va = VectorAssembler(inputCols=[f"{c}_in" for c in categorical] + list(numeric),
                         outputCol="features", handleInvalid="keep")
    dt = DecisionTreeRegressor(labelCol=label, featuresCol="features", seed=seed,
                               maxDepth=max_depth, maxBins=max_bins)
    return Pipeline(stages=[*idx, va, dt])


def fit_predict(pipeline: Pipeline, train: DataFrame, test: DataFrame) -> DataFrame:
    model: PipelineModel = pipeline.fit(train)
    return model.transform(test)


def evaluate(pred: DataFrame, label: str = "qty", prediction: str = "prediction") -> dict:
    """RMSE and MAE with ``RegressionEvaluator`` (M5)."""
    ev = RegressionEvaluator(labelCol=label, predictionCol=prediction)
    return {m: ev.setMetricName(m).evaluate(pred) for m in ("rmse", "mae")}


def regression_metrics(pred: DataFrame, label: str = "qty",
                       prediction: str = "prediction") -> DataFrame:
    """RMSE and MAE as a one-row aggregate (the SQL twin of ``evaluate``)."""
    d = F.col(prediction) - F.col(label)
    return pred.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
                    F.count(F.lit(1)).alias("n"))


def kmeans_segments(df: DataFrame, features, k: int = 2, seed: int = 1) -> DataFrame:
    """k-means over the numeric ``features`` (M6, C16); adds ``prediction``.

    A NULL feature is an error; fill or filter such rows first.
    """
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    km = KMeans(k=k, seed=seed, featuresCol="features")
    return Pipeline(stages=[va, km]).fit(df).transform(df).drop("features")


def lloyd_segments(df: DataFrame, key: str, features, k: int = 2, rounds: int = 10) -> DataFrame:
    """k-means by Lloyd's rounds from fixed starting rows (M6, C16); adds ``prediction``.

    The start is the ``k`` rows with the smallest ``key`` (which must be unique), so a run can
    be repeated, and checked, on any engine.  A round assigns every row to its nearest centre
    (ties: the smaller number) and takes the means; a centre without rows stays.  It ends
    after ``rounds`` rounds or when no centre moved.  Centres are stages of ``k`` rows that
    the rows read as one scalar subquery: no join, and one partial aggregate a round.  Rows
    with a NULL feature have no segment.  ``df`` is read once a round: pass a stage.
    """
    features = list(features)
    values = [F.col(f).cast("double") for f in features]
    usable = F.lit(True)
    for f in features:
        usable = usable & F.col(f).isNotNull()
    start = df.filter(usable).orderBy(key).limit(k).select(
        (F.row_number().over(Window.orderBy(key)) - 1).alias("c"), F.array(*values).alias("at"))
    centres = materialize(start, "centres")

    def nearest(centres):
        m = centres.agg(F.array_sort(F.collect_list(F.struct("c", "at"))).alias("m")).scalar()
        # k distances as plain columns: a lambda may not hold a subquery
        far = []
        for j in range(k):
            centre = F.get(m, F.lit(j))
            at = centre["at"]
            d = sum(((v - at[i]) * (v - at[i]) for i, v in enumerate(values)), F.lit(0.0))
            far.append(F.when(at.isNotNull(), F.struct(d.alias("d"), centre["c"].alias("c"))))
        return F.when(usable, F.array_min(F.array(*far))["c"])

    for _ in range(rounds):
        means = df.withColumn("_c", nearest(centres)).filter(F.col("_c").isNotNull()).groupBy("_c").agg(
            F.array(*[F.avg(v) for v in values]).alias("_mean"))
        old, centres = centres, materialize(centres.join(means, F.col("c") == F.col("_c"), "left").select(
            "c", F.coalesce("_mean", "at").alias("at")), "centres")
        if centres.exceptAll(old).isEmpty():
            break
    return df.withColumn("prediction", nearest(centres))


def category_index(train: DataFrame, columns) -> DataFrame:
    """(name, label, category_index, n) of each category of each column: 0 is the most
    frequent label, ties go by label (M1); NULL is no category.

    For columns of any cardinality: the labels are counted (combined before the shuffle) and
    ranked by one range-partitioned sort over all columns (``windows.rank_within_groups``).
    No list of labels is held by the driver or by one task.
    """
    columns = list(columns)
    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("label")) for c in columns])).alias("c")) \
        .select("c.*").filter(F.col("label").isNotNull())
    counts = long.groupBy("name", "label").agg(F.count(F.lit(1)).alias("n"))
    ranked = rank_within_groups(counts, ["name"], "n", ["label"], name="_rank", count_name="_labels")
    return ranked.select("name", "label", (F.col("_rank") - 1).cast("double").alias("category_index"), "n")


def encode_categories(df: DataFrame, index: DataFrame, columns, suffix: str = "_in") -> DataFrame:
    """``df`` with the index of each column as ``<column><suffix>`` (M1, M2).

    ``index`` is the result of ``category_index``; a label that it lacks, and NULL, get the
    number of labels, one past the last index.  A join a column: Spark broadcasts a small
    index and shuffles a large one, with skewed labels split by AQE.
    """
    out = df
    for c in columns:
        own = index.filter(F.col("name") == c)
        many = own.agg(F.count(F.lit(1)).cast("double").alias("k")).scalar()
        own = own.select(F.col("label").alias("_label"), F.col("category_index").alias("_index"))
        out = out.join(own, out[c].cast("string") == own["_label"], "left") \
            .withColumn(c + suffix, F.coalesce("_index", many)).drop("_label", "_index")
    return out


def mean_by_category(train: DataFrame, test: DataFrame, categories, label: str = "qty") -> DataFrame:
    """``test`` with the mean label of its categories in ``train`` as ``prediction`` (0 for
    categories that ``train`` lacks): a deterministic baseline for M5."""
    names = {c: f"_c_{c}" for c in categories}
    means = train.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(
        F.avg(label).alias("_mean"))
    cond = None
    for c, n in names.items():
        e = test[c].eqNullSafe(means[n])
        cond = e if cond is None else cond & e
    return test.join(means, cond, "left").withColumn(
        "prediction", F.coalesce("_mean", F.lit(0.0))).drop("_mean", *names.values())


def leaf_violations(pred: DataFrame, label: str = "qty", tolerance: float = 1e-6) -> DataFrame:
    """How many training rows sit in a leaf whose prediction is not its rows' mean label (M3)."""
    leaves = pred.groupBy("prediction").agg(F.avg(label).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    wrong = F.abs(F.col("_mean") - F.col("prediction")) > tolerance
    return leaves.agg(F.sum("_n").alias("n_rows"), F.coalesce(
        F.sum(F.when(wrong, F.col("_n"))), F.lit(0)).alias("n_violations"))


def centre_violations(df: DataFrame, features, k: int = 2, seed: int = 1,
                      tolerance: float = 1e-9) -> DataFrame:
    """How many rows of a k-means segmentation are nearer to another centre (M6).

    The ``k`` centres are the model; distances are column expressions.
    """
    features = list(features)
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    model = Pipeline(stages=[va, KMeans(k=k, seed=seed, featuresCol="features")]).fit(df)
    far = F.array(*[sum(((F.col(f) - F.lit(float(x))) ** 2 for f, x in zip(features, centre)),
                        F.lit(0.0)) for centre in model.stages[-1].clusterCenters()])
    rows = model.transform(df).withColumn("_d", far)
    wrong = F.get("_d", F.col("prediction")) > F.array_min("_d") + tolerance
    return rows.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count(F.when(wrong, 1)).alias("n_violations"))
