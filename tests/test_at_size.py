"""What larger tables and other rows showed: results against SQL, plain versions and Spark's own."""

import random
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import pairs


@pytest.mark.parametrize(("n", "copies"), ((3, 60), (50, 1)))
def test_edges_equal_sql_to_the_last_bit(spark, n, copies):
    draw = random.Random(n)
    values = [round(draw.uniform(900, 1400), 2) for _ in range(n)] * copies
    at = ", ".join(str(i / 20) for i in range(1, 20))
    want = duckdb.connect().execute(f"SELECT list_sort(list_distinct(quantile_cont(v, [{at}]))) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchone()[0]
    assert pairs.edges(spark.createDataFrame([(v,) for v in values], "v double"), "v") == want


def test_bitmap_reaches_the_driver_packed(spark):
    from tabforge.llm import common

    keys = spark.range(100_000).select(F.xxhash64("id").alias("k"))
    tracemalloc.start()
    packed = common.bitmap(keys, F.col("k"), 1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.array([r.k for r in keys.collect()], np.int64)
    assert common.among_packed(packed, want).all() and np.unpackbits(packed).sum() == len(np.unique(want % (1 << 20)))
    assert peak < 16 * len(packed)  # rows of words took about sixty times its size


def test_gower_regions_equal_all_pairs(spark, monkeypatch):
    from tabforge.operators import gower
    from tabforge.schema import ColumnSchema as C

    draw = random.Random(4)
    schema = [C("n", "float"), C("m", "integer"), C("c", "categorical"), C("b", "categorical")]
    row = lambda i: (i, draw.choice([None, float("nan"), 1.0, draw.gauss(0, 9)]), draw.choice([None, draw.randint(0, 40)]), draw.choice([None, "a", "b", "é"]), draw.choice("xy"))
    train, queries = [row(i) for i in range(300)] * 2, [row(i) for i in range(150)]
    frames = [spark.createDataFrame(rows, "k long, n double, m long, c string, b string").repartition(3) for rows in (train, queries)]
    limits = gower.bounds(frames[0], schema)
    low, high = (np.array([limits[c][i] for c in "nm"]) for i in (0, 1))
    plain = lambda rows: np.clip(np.array([[np.nan if v is None else v for v in r[1:3]] for r in rows], float), low, high)
    x, y = plain(queries), plain(train)
    gap = np.abs(x[:, None] - y[None]) / (high - low)
    gap = np.where(np.isnan(x)[:, None] & np.isnan(y)[None], 0.0, np.where(np.isnan(gap), 1.0, gap)).sum(2) + [[sum(q[j] != t[j] for j in (3, 4)) for t in train] for q in queries]
    want = np.sort(gap / 4, 1)[:, :2]
    monkeypatch.setattr(gower, "MOST_QUERIES", 20)
    got = np.array([r[1:] for r in sorted(map(tuple, gower.nearest_two(*frames, schema, "k").collect()))])
    assert np.allclose(got, want)
    assert len({*gower._regions(gower._tree([([np.arange(90.0)], 1.0)], {0: 89.0}, 20), [np.arange(90.0)])}) == 8


def test_boosting_cells_equals_boosting_rows(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from tabforge.operators import classify

    draw = random.Random(2)
    rows = [(float(a), float(b), 3.0 * a + (b % 3) * 5 + draw.gauss(0, 1)) for a, b in ((draw.randint(0, 9), draw.randint(0, 5)) for _ in range(2000))]
    monkeypatch.setattr(classify, "TREES", classify.TREES | {"maxIter": 6})
    df = spark.createDataFrame(rows, "a double, b double, __label double").coalesce(2).persist()
    x = VectorAssembler(inputCols=["a", "b"], outputCol="__x").transform(df)
    spark_ml = GBTRegressor(featuresCol="__x", labelCol="__label", seed=0, **classify.TREES).fit(x).transform(x)
    want = spark_ml.agg(F.sqrt(F.avg((F.col("prediction") - F.col("__label")) ** 2))).first()[0]
    assert classify._boosted_rmse(df, df, ["a", "b"]) == pytest.approx(want, rel=1e-4)
