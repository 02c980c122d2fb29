"""Nearest rows with pivots against brute force: ties, repeated rows, clusters, few rows."""

import numpy as np
import pytest

from cogspark.operators import models as M


def brute(q, ref, k, exclude_self):
    out = []
    for i, v in q:
        d = sorted((round(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), 9), j) for j, w in ref if not (exclude_self and i == j))
        out += [(i, r, j, x) for r, (x, j) in enumerate(d[:k], 1)]
    return sorted(out)


def got(df):
    return sorted((r["id"], r["rank"], r["ref_id"], round(r["dist"], 9)) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 6])
@pytest.mark.parametrize("pivot_rows,block,group", [(1 << 20, 1 << 14, 1 << 17), (20, 16, 50)])
def test_nearest_with_ties(spark, parts, pivot_rows, block, group):
    rng = np.random.default_rng(4)
    ref = [(i, [float(c) for c in rng.integers(0, 3, 3)]) for i in range(300, 0, -1)]  # a grid: nearly all distances tie
    ref += [(1000 - i, [1.0, 1.0, 1.0]) for i in range(80)] + [(5000, [40.0, 0.0, 0.0])]
    df = spark.createDataFrame(ref, "id long, vector array<double>").repartition(parts)
    assert got(M.knn_join(df, df, "id", k=5, block=block, group=group, pivot_rows=pivot_rows)) == brute(ref, ref, 5, True)
    q = [(7, [0.0, 0.0, 0.0]), (9, [1.0, 1.0, 1.0]), (11, [100.0, 1.0, 1.0])]
    asked = spark.createDataFrame(q, "id long, vector array<double>")
    assert got(M.knn_join(asked, df, "id", k=4, exclude_self=False, block=block, group=group, pivot_rows=pivot_rows)) == brute(q, ref, 4, False)


def test_forty_equal_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40, 0, -1)], "id long, vector array<double>")
    q = spark.createDataFrame([(99, [0.0, 0.0])], "id long, vector array<double>")
    for parts in (1, 4):
        assert [r["ref_id"] for r in M.knn_join(q, df.repartition(parts), "id", k=5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_clusters_leave_most_rows_out(spark, monkeypatch):
    rng = np.random.default_rng(6)
    middle = rng.standard_normal((12, 5)) * 50
    ref = [(i, [float(c) for c in middle[i % 12] + rng.standard_normal(5)]) for i in range(1200)]
    df = spark.createDataFrame(ref, "id long, vector array<double>").repartition(3)
    sent = spark.sparkContext.accumulator(0)
    inner = M._nearest

    def counting(k, exclude_self):
        run = inner(k, exclude_self)

        def counted(batches):
            def each():
                for b in batches:
                    sent.add(b.num_rows)
                    yield b

            return run(each())

        return counted

    monkeypatch.setattr(M, "_nearest", counting)
    assert got(M.knn_join(df, df, "id", k=3, block=64, pivot_rows=30)) == brute(ref, ref, 3, True)
    assert sent.value < 1200 * 12  # all rows to all blocks would be 1,200 x some 40


def test_nearest_of_few_and_none(spark):
    empty = spark.createDataFrame([], "id long, vector array<double>")
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (None, [0.0, 0.0])], "id long, vector array<double>")
    assert M.knn_join(one, empty, "id").count() == 0 and M.knn_join(empty, one, "id").count() == 0
    assert M.knn_join(one, one, "id").count() == 0 and M.knn_join(one, one, "id", exclude_self=False).count() == 1
