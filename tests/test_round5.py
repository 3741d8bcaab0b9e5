"""Findings of round 4: each test failed before its finding was mended."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.ml import recommendation, regression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark import registry
from tidemark.ml import boosting
from tidemark.operators import neighbours
from tidemark.plans import models
from tidemark.session import scratch, shared_root, small_batches, stored, swept

SF = "/root/testdata/sf0.001"


def test_near_duplicate_stage_leaves_only_what_its_result_reads(spark):
    """The join's sets and rounds lay in the shared folder until the job's end, beside all later stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = set(os.listdir(shared_root(spark)))
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(shared_root(spark))) - before}
    assert left == {"marked", "heads"}
    assert 0 < kept.count() <= docs.count()


def test_swept_keeps_what_is_named_outside_and_what_kept_frames_read(spark):
    outer = stored(spark.range(5), "outer")
    with swept(spark) as keep_all:
        with swept(spark) as keep:
            lost = scratch(spark, "lost")
            spark.range(3).write.parquet(lost)
            inner = keep(stored(spark.range(7), "inner"))
        assert not os.path.exists(lost)
        assert (outer.count(), inner.count()) == (5, 7)
        keep_all(outer)
        path = inner.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(path)  # nothing kept it outside
    assert outer.count() == 5


@pytest.mark.parametrize("name", ["mo24_als", "mo24_als_implicit"])
def test_ratings_lie_in_as_many_blocks_as_they_need(spark, tables, monkeypatch, name):
    """Ten blocks, however many ratings, made a task hold a tenth of them."""
    made = []

    class Recorded:
        def ALS(self, **options):  # noqa: N802
            made.append((options.get("numUserBlocks", 10), options.get("numItemBlocks", 10)))
            return recommendation.ALS(**options)

    monkeypatch.setattr(models, "recommendation", Recorded())
    small = registry.load_all()[name].build(tables).count()
    monkeypatch.setattr(models, "RATINGS_PER_BLOCK", 400, raising=False)
    assert registry.load_all()[name].build(tables).count() == small > 0
    n = models.ratings(tables).count()
    assert made == [(10, 10), (-(-n // 400), -(-n // 400))] and n > 4000


@pytest.mark.parametrize("n", [300, 12_000])
def test_boosted_trees_are_the_library_s(spark, n):
    """From counts of cells, where every round read all rows several times and kept them in memory."""
    rng = np.random.default_rng(n)
    a, b, c = rng.standard_normal(n), np.round(rng.random(n) * 6) / 2 * (rng.random(n) < 0.6), np.full(n, 3.0)
    y = a * a + b + rng.standard_normal(n) / 3
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y)], "a double, b double, c double, label double").repartition(3, "a").cache()
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    found = boosting.boosted(df, "label", ["a", "b", "c"], ["squared", "absolute"], rounds=4, depth=3)
    for loss, p in found.items():
        was = regression.GBTRegressor(maxIter=4, maxDepth=3, seed=1, lossType=loss).fit(rows).transform(rows)
        assert was.where(F.abs(p - F.col("prediction")) > 1e-9).count() == 0
    assert df.select(found["absolute"].alias("p")).distinct().count() > 8
    df.unpersist()


def test_boosted_trees_want_numbers(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "a double, label double")
    for some in (df, df.limit(0), df.selectExpr("double('NaN') AS a", "label")):
        with pytest.raises(ValueError):
            boosting.boosted(some, "label", ["a"], ["squared"], rounds=2, depth=2)


@pytest.mark.parametrize("size", [1e-8, 1.0, 1e12])
def test_close_pairs_are_all_pairs_within_the_limit(size):
    """Tiles of single precision rule out far pairs only; exact distances decide."""
    rng = np.random.default_rng(4)
    q, v = rng.standard_normal((300, 8)) * size, rng.standard_normal((1500, 8)) * size
    v[:50], v[7, 0], q[5, 1] = q[:50] + size * 1e-4, np.inf, np.nan
    with np.errstate(invalid="ignore"):
        d = np.sqrt(np.cumsum((v[None] - q[:, None]) ** 2, axis=2)[:, :, -1])
    for limit in (d[0, 0], float(np.nanquantile(d[np.isfinite(d)], 0.01)), 2 * size):
        i, j, exact = neighbours.close_pairs(q, v, limit)
        assert sorted(zip(i.tolist(), j.tolist())) == [tuple(x) for x in np.argwhere(d <= limit)]
        assert (exact == d[i, j]).all()
    assert not len(neighbours.close_pairs(q[:0], v, 1.0)[0])


def test_near_pairs_bring_their_distance_along(spark, capfd):
    """Vectors were joined to the pairs once more, one row of floats for each of a number that grows with the square."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((400, 6)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    found = neighbours.near_pairs(df, "id", "v", 1.0, 0.999)
    found.explain()
    assert "Join" not in capfd.readouterr().out
    w = v.astype(float)
    d = np.sqrt(np.cumsum((w[None] - w[:, None]) ** 2, axis=2)[:, :, -1])
    wanted = {(i, j): d[i, j] for i, j in np.argwhere(d <= 1.0).tolist() if i < j}
    got = {(r["a"], r["b"]): r["distance"] for r in found.collect()}
    assert len(got) >= 0.97 * len(wanted) and all(wanted[k] == x for k, x in got.items())
    # a key that stands twice: all its vectors are compared
    twice = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.5, 0.0]), (2, [0.1, 0.0])], "id bigint, v array<float>")
    assert sorted(round(r["distance"], 3) for r in neighbours.near_pairs(twice, "id", "v", 1.0, 0.999).collect()) == [0.1, 0.4]


def test_small_batches_hold_inside_only(spark):
    """Texts went to Python workers by 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    texts = spark.range(30, numPartitions=1).selectExpr("repeat('x', 1000000) AS text")
    with small_batches(spark):
        found = [r[0] for r in texts.mapInArrow(sizes, "n bigint").collect()]
    assert len(found) > 2 and max(found) < 16 << 20 and sum(found) > 30_000_000
    assert spark.conf.get(key) == before
