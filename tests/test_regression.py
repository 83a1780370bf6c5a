"""Boosted trees on counted combinations against the single rows."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tensorloom.operators import expression, stats


def test_counted_rows_fit_as_single_rows(spark, monkeypatch):
    i = F.col("id")
    one = spark.range(700).select((i % 7).cast("double").alias("a"), (i % 3).cast("double").alias("b"), (i * 37 % 50).cast("double").alias("c"), (i % 7 * 3 + F.sqrt(i * 37 % 50) + i % 11 / 10).alias("y"))
    df = one.crossJoin(spark.range(6)).drop("id")
    rho, places = [], {}
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).withColumn("_h", F.xxhash64("a", "b", "c", "y")).withColumnRenamed("y", "label").cache()
    for seed in (1, 2):
        side = F.pmod(F.xxhash64("_h", F.lit(seed)), F.lit(10))
        model = GBTRegressor(maxIter=5, maxDepth=3, seed=seed).fit(v.where(side > 0))
        for f, x in zip("abc", model.featureImportances.toArray(), strict=True):
            places.setdefault(f, []).append(float(x))
        held = model.transform(v.where(side == 0)).toPandas()
        rho.append(held["label"].rank().corr(held["prediction"].round(9).rank()) if len(held) else 0.0)
    seen, real = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, rows: seen.append(rows.count()) or real(self, rows))
    got, found = expression.gbt_regression(df, ["a", "b", "c"], "y", [1, 2])
    for r in got.collect():
        assert r.importance == pytest.approx(sum(places[r.feature]) / 2, rel=1e-9)
    assert found == pytest.approx(rho, abs=1e-6) and max(seen) <= 700
    with pytest.raises(ValueError):
        expression.gbt_regression(df.withColumn("y", F.when(F.col("a") > 0, F.col("y"))), ["a", "b", "c"], "y", [1])


def test_spearman_of_counted_rows(spark):
    rows = [(i % 2, float(i * 7 % 5), float(i * i % 9), 1 + i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, x double, y double, n int")
    plain = {r.g: r.value for r in stats.spearman(df.withColumn("_", F.explode(F.sequence(F.lit(1), "n"))), "x", "y", ["g"]).collect()}
    assert {r.g: r.value for r in stats.spearman(df, "x", "y", ["g"], "n").collect()} == pytest.approx(plain, rel=1e-9)
