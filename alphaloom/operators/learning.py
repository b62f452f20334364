"""Time-ordered splits and linear models over factor tables."""

from __future__ import annotations

import itertools

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.sources.store import scratch


def walk_forward(dates: DataFrame, train: int, test: int, gap: int = 1) -> DataFrame:
    """window_id, train_start, train_end, test_start, test_end over the distinct dates (one row a date)."""
    d = dates.select("dt").distinct().withColumn("i", F.row_number().over(W.orderBy("dt")) - 1)
    first = train + gap
    d = d.withColumn("window_id", F.floor((F.col("i") - first) / test))
    tests = d.filter("window_id >= 0").groupBy("window_id").agg(F.min("dt").alias("test_start"), F.max("dt").alias("test_end"), F.min("i").alias("s"))
    at = d.select("i", F.col("dt").alias("d"))
    out = tests.join(at.select((F.col("i") + first).alias("s"), F.col("d").alias("train_start")), "s")
    return out.join(at.select((F.col("i") + 1 + gap).alias("s"), F.col("d").alias("train_end")), "s").select("window_id", "train_start", "train_end", "test_start", "test_end")


def purged_folds(dates: DataFrame, folds: int = 6, tests: int = 2, embargo: int = 1) -> DataFrame:
    """combination, dt, role (train, test or purged): every choice of ``tests`` of ``folds`` blocks of dates.

    Dates within ``embargo`` rows of a test block, on both sides, are purged.
    """
    d = dates.select("dt").distinct().withColumn("fold", F.ntile(folds).over(W.orderBy("dt")) - 1)  # one row a date
    spark = dates.sparkSession
    choices = spark.createDataFrame([(i, list(c)) for i, c in enumerate(itertools.combinations(range(folds), tests))], "combination int, chosen array<int>")
    x = d.crossJoin(F.broadcast(choices)).withColumn("is_test", F.array_contains("chosen", F.col("fold").cast("int")))  # a fixed number of choices
    near = W.partitionBy("combination").orderBy("dt").rowsBetween(-embargo, embargo)
    role = F.when(F.col("is_test"), "test").when(F.max(F.col("is_test")).over(near), "purged").otherwise("train")
    return x.select("combination", "dt", role.alias("role"))


def ridge(df: DataFrame, features: list[str], label: str, penalty: float = 0.1):
    """A ridge regression by pyspark.ml on rows where all columns are known."""
    known = df.dropna(subset=[*features, label])
    table = VectorAssembler(inputCols=features, outputCol="features").transform(known).select("features", F.col(label).alias("label"))
    return LinearRegression(regParam=penalty, elasticNetParam=0.0, solver="normal").fit(table)


def predict(model, df: DataFrame, features: list[str]) -> DataFrame:
    known = VectorAssembler(inputCols=features, outputCol="features").transform(df.dropna(subset=features))
    return model.transform(known).drop("features")


def boosted(df: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 3, seed: int = 7):
    """Gradient boosted trees by pyspark.ml on rows where all columns are known."""
    known = df.dropna(subset=[*features, label])
    table = VectorAssembler(inputCols=features, outputCol="features").transform(known).select("features", F.col(label).alias("label"))
    return GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed).fit(table)


def stacked(df: DataFrame, features: list[str], label: str, folds: int = 3) -> DataFrame:
    """code, dt, ridge, boosted, stacked: predictions of two models from other blocks of dates, and a ridge over both.

    Blocks are runs of dates; a row is predicted by models that never saw its block. Rows with a null
    feature have no prediction; rows with a null label are predicted but teach nothing.
    """
    blocks = df.select("dt").distinct().withColumn("_block", F.ntile(folds).over(W.orderBy("dt")))  # one row a date
    path = scratch(df.sparkSession, "stacked")  # read once for each block
    df.select("code", "dt", *features, label).join(blocks, "dt").write.parquet(path)
    df = df.sparkSession.read.parquet(path)
    parts = []
    for k in range(1, folds + 1):
        seen, new = df.filter(F.col("_block") != k), df.filter(F.col("_block") == k)
        out = predict(ridge(seen, features, label), new, features).withColumnRenamed("prediction", "ridge")
        parts.append(predict(boosted(seen, features, label), out, features).withColumnRenamed("prediction", "boosted"))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    model = ridge(both, ["ridge", "boosted"], label, 0.0)
    return predict(model, both, ["ridge", "boosted"]).select("code", "dt", "ridge", "boosted", F.col("prediction").alias("stacked"))


def adversarial_auc(a: DataFrame, b: DataFrame, features: list[str], trees: int = 20, seed: int = 7) -> float:
    """How well a forest tells the rows of two tables apart (0.5: not at all), on a fifth of the rows held out by hash."""
    both = a.select(*features, F.lit(0.0).alias("label")).unionByName(b.select(*features, F.lit(1.0).alias("label"))).dropna()
    both = VectorAssembler(inputCols=features, outputCol="features").transform(both.withColumn("_h", F.pmod(F.xxhash64(*features), F.lit(5))))
    model = RandomForestClassifier(numTrees=trees, maxDepth=4, seed=seed).fit(both.filter("_h > 0"))
    return BinaryClassificationEvaluator().evaluate(model.transform(both.filter("_h = 0")))
