"""Congestion score: a regression of log-density on cell behaviour, scaled to [0, 1]."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from kerbsight.functions import columns as C, fixed
from kerbsight.operators.ranking import grouped_percentile
from kerbsight.session import Workspace

TARGET = "_target"
PREDICTION = "congestion_raw"
DEPTH = 5


def is_test_row(cell_id: Column) -> Column:
    """One cell in five, by hash: the same split for any partitioning and on any retry."""
    return F.conv(F.substring(F.md5(cell_id), 1, 4), 16, 10).cast("int") % 5 == 0


def train_test_split(cells: DataFrame) -> DataFrame:
    return cells.withColumn("is_test", is_test_row(F.col("cell_id")))


@dataclass
class CongestionModel:
    """Fitted model with its metrics on the test rows and importances in percent."""

    method: str
    model: PipelineModel | DataFrame
    metrics: DataFrame
    importance: dict[str, float]
    feature_columns: list[str]

    def predict(self, cells: DataFrame) -> DataFrame:
        """Cells, training rows included, with the raw prediction."""
        if self.method == "ols":
            return _predict_line(cells, self.model)
        prepared = _prepare(cells, self.feature_columns)
        return self.model.transform(prepared).select(*cells.columns, PREDICTION)


def metrics(scored: DataFrame, label: str = TARGET, prediction: str = PREDICTION) -> DataFrame:
    """Mean absolute error and R², one row."""
    y, p = F.col(label), F.col(prediction)
    mean = scored.agg(F.avg(label)).scalar()
    residual, total = F.sum((y - p) * (y - p)), F.sum((y - F.col("_mean")) * (y - F.col("_mean")))
    return scored.withColumn("_mean", mean).agg(
        F.avg(F.abs(y - p)).alias("mae"), (1 - residual / total).alias("r2")
    )


def _prepare(cells: DataFrame, feature_columns: list[str]) -> DataFrame:
    inputs = {f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feature_columns}
    return cells.withColumns({**inputs, TARGET: F.log1p("violation_count")})


def available_features(cells: DataFrame) -> list[str]:
    return [c for c in fixed.FEATURE_COLUMNS if c in cells.columns]


def train_gbt(cells: DataFrame, rounds: int = 200, seed: int = 42) -> CongestionModel:
    """Boosted regression trees on all cells outside the test part.

    Depth 5 allows 32 leaves. Spark ML trains by histogram aggregation, so a tree level costs one
    pass over the cells; `checkpointInterval` cuts the lineage of the residuals in
    the shared folder.
    """
    names = available_features(cells)
    prepared = _prepare(cells, names)
    test = is_test_row(F.col("cell_id"))
    gbt = GBTRegressor(
        featuresCol="_features",
        labelCol=TARGET,
        predictionCol=PREDICTION,
        maxIter=rounds,
        maxDepth=DEPTH,
        stepSize=0.05,
        subsamplingRate=0.8,
        featureSubsetStrategy="0.9",
        checkpointInterval=10,
        seed=seed,
    )
    assembler = VectorAssembler(inputCols=[f"_x_{c}" for c in names], outputCol="_features")
    model = Pipeline(stages=[assembler, gbt]).fit(prepared.where(~test))
    gains = model.stages[-1].featureImportances
    importance = {c: round(float(gains[i]) * 100, 1) for i, c in enumerate(names)}
    return CongestionModel(
        "gbt", model, metrics(model.transform(prepared.where(test))), importance, names
    )


def node_table(ws: Workspace, model: CongestionModel) -> DataFrame:
    """The boosted trees as one row per node: `tree`, its `weight`, `node` (the root is 0), the children `left`
    and `right` (-1 at a leaf), the `feature` and `threshold` that a row is compared with (at most: left), the
    `prediction`, and the training `n_rows` and variance `gain` of the node."""
    path = ws.path("trees")
    model.model.stages[-1].write().save(path)
    nodes = ws.spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = ws.spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "_", "weight").drop("_")
    names = F.array(*map(F.lit, model.feature_columns))
    is_leaf = F.col("leftChild") < 0
    return nodes.join(weights, "treeID").select(
        F.col("treeID").alias("tree"),
        "weight",
        F.col("id").alias("node"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.when(~is_leaf, F.get(names, F.col("split.featureIndex"))).alias("feature"),
        F.when(~is_leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        "prediction",
        F.col("rawCount").alias("n_rows"),
        F.when(~is_leaf, F.col("gain")).alias("gain"),
    )


def score_nodes(cells: DataFrame, nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """`cells` with the raw prediction of a node table, by descent in plain expressions.

    The trees reach the rows as one scalar, whose size is that of the model: rounds times at most
    2^(depth + 1) nodes, whatever the data. A missing feature counts as 0.
    """
    names = [c for c in fixed.FEATURE_COLUMNS if c in cells.columns]
    place = F.array_position(F.array(*map(F.lit, names)), F.col("feature")).cast("int") - 1
    node = F.struct("node", place.alias("feature"), "threshold", "left", "right", "prediction")
    trees = nodes.groupBy("tree", "weight").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    # numbered from 0 without gaps, so a node's number is its place in the sorted array
    forest = trees.agg(F.array_sort(F.collect_list(F.struct("tree", "weight", "nodes"))).alias("f"))
    leaf = f"""aggregate(sequence(1, {depth}), 0, (at, i) -> CASE
        WHEN t.nodes[at].left < 0 THEN at
        WHEN coalesce(_x[t.nodes[at].feature], 0D) <= t.nodes[at].threshold THEN t.nodes[at].left
        ELSE t.nodes[at].right END)"""
    total = F.expr(f"aggregate(_forest, 0D, (s, t) -> s + t.weight * t.nodes[{leaf}].prediction)")
    inputs = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names))
    return cells.withColumns({"_x": inputs, "_forest": forest.scalar()}).select(
        *cells.columns, total.alias(PREDICTION)
    )


def evaluate(model: CongestionModel, cells: DataFrame) -> dict[str, float]:
    """Test metrics through Spark ML's evaluator."""
    scored = model.predict(cells.where(is_test_row(F.col("cell_id"))))
    scored = scored.withColumn(TARGET, F.log1p("violation_count"))
    evaluator = RegressionEvaluator(labelCol=TARGET, predictionCol=PREDICTION)
    return {
        "mae": evaluator.evaluate(scored, {evaluator.metricName: "mae"}),
        "r2": evaluator.evaluate(scored, {evaluator.metricName: "r2"}),
    }


def train_line(cells: DataFrame) -> CongestionModel:
    """Least squares of log-count on log-unique-vehicles: a one-pass model SQL can check."""
    x, y = F.log1p("unique_vehicles"), F.log1p("violation_count")
    line = cells.where(~is_test_row(F.col("cell_id"))).agg(
        F.struct(
            F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
        ).alias("line")
    )
    test = cells.where(is_test_row(F.col("cell_id"))).withColumn(TARGET, y)
    return CongestionModel(
        "ols", line, metrics(_predict_line(test, line)), {"unique_vehicles": 100.0}, ["unique_vehicles"]
    )


def _predict_line(cells: DataFrame, line: DataFrame) -> DataFrame:
    """Rounded to 9 digits: partial sums arrive in any order and differ in the last bits."""
    found = line.scalar()
    value = F.col("_line.intercept") + F.col("_line.slope") * F.log1p("unique_vehicles")
    return cells.withColumn("_line", found).select(
        *cells.columns, F.round(value, 9).alias(PREDICTION)
    )


def congestion_scores(predicted: DataFrame) -> DataFrame:
    """Min-max scaled prediction; the extremes are a one-row scalar subquery."""
    extremes = predicted.agg(
        F.struct(F.min(PREDICTION).alias("low"), F.max(PREDICTION).alias("high")).alias("e")
    ).scalar()
    scaled = C.unit_range(F.col(PREDICTION), F.col("_e.low"), F.col("_e.high"))
    return predicted.withColumn("_e", extremes).select(
        *predicted.columns, C.clip01(scaled).alias("congestion_score")
    )


def station_congestion(ws: Workspace, scored: DataFrame, stations: DataFrame) -> DataFrame:
    """Stations with the score roll-up of the cells they have the majority in.

    The station's score is the 90th percentile of those cells; a station without any gets 0
    cells and score 0.
    """
    plain = scored.groupBy("police_station").agg(
        F.avg("congestion_score").alias("congestion_score_mean"),
        F.max("congestion_score").alias("congestion_score_max"),
        F.count_if("is_hotspot").alias("hotspot_cells"),
        F.count("cell_id").alias("total_cells"),
    )
    p90 = grouped_percentile(
        ws, scored, "police_station", "congestion_score", ["cell_id"], 0.9, "congestion_score_p90"
    )
    joined = stations.join(plain, "police_station", "left").join(p90, "police_station", "left")
    return joined.select(
        *stations.columns,
        "congestion_score_mean",
        "congestion_score_max",
        "congestion_score_p90",
        F.coalesce("hotspot_cells", F.lit(0)).alias("hotspot_cells"),
        F.coalesce("total_cells", F.lit(0)).alias("total_cells"),
        C.clip01(F.coalesce("congestion_score_p90", F.lit(0.0))).alias("congestion_score"),
    )
