"""Boosted trees against a plain loop, the choice of a configuration and the mask by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cogspark.operators import boosting as B


def data(n=240, d=5, k=3, seed=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, d)), 2)
    x[rng.random((n, d)) < 0.05] = np.nan
    y = np.nan_to_num(x[:, 0] + 0.5 * x[:, 1] > 0.3).astype(int) + (np.nan_to_num(x[:, 2]) > 0.8)
    return x, y % k


def frame(spark, x, y):
    rows = [(i, [None if np.isnan(c) else float(c) for c in r], f"c{int(v)}") for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, v array<double>, label string")
    return df.select("id", "label", *[F.get("v", i).alias(f"x{i}") for i in range(x.shape[1])])


def plain(x, edges, y, fold, stop, run, rounds, k, base, seed=42):
    """Margins of every row after each round: one run, row by row where that is simple."""
    config, f = run
    bins = np.array([[0 if np.isnan(c) else 1 + int((e < c).sum()) for c, e in zip(r, edges)] for r in x])
    width = max(len(e) for e in edges) + 2
    margins, out = np.repeat(base[None], len(x), 0), []
    train = [i for i in range(len(x)) if fold[i] != f and not stop[i]]
    out.append(margins.copy())
    for nth in range(rounds):
        g, h = B.gradients(margins, y, np.ones(len(y)))
        add = np.zeros_like(margins)
        for c in range(k):
            seen = B.seen_features(config, nth, c, x.shape[1], seed)
            leaf = lambda rows: -config.rate * sum(int(g[i, c]) for i in rows) / (sum(int(h[i, c]) for i in rows) + config.l2 * B.UNIT)  # noqa: B023, E731
            groups = [(train, range(len(x)), leaf(train))]
            done, count = [], 1
            for _ in range(config.depth):
                found = []
                for at, (rows, every, value) in enumerate(groups):
                    best = (0.0, None, None)
                    for j in np.flatnonzero(seen):
                        for b in range(width):
                            left = [i for i in rows if bins[i, j] <= b]
                            right = [i for i in rows if bins[i, j] > b]
                            if len(left) < config.min_rows or len(right) < config.min_rows:
                                continue
                            s = lambda r: (sum(int(g[i, c]) for i in r) / B.UNIT) ** 2 / (sum(int(h[i, c]) for i in r) / B.UNIT + config.l2 + 1e-12)  # noqa: B023, E731
                            gain = s(left) + s(right) - s(rows)
                            if gain > best[0]:
                                best = (gain, j, b)
                    found.append((-best[0], at, best))
                nxt, gone = [], set()
                for _, at, (gain, j, b) in sorted(found, key=lambda t: t[:2]):
                    rows, every, value = groups[at]
                    if gain <= 1e-9 or count >= config.leaves:
                        continue
                    count += 1
                    gone.add(at)
                    for side in (False, True):
                        r = [i for i in rows if (bins[i, j] > b) == side]
                        nxt.append((r, [i for i in every if (bins[i, j] > b) == side], leaf(r)))
                done += [q for at, q in enumerate(groups) if at not in gone]
                groups = nxt
            for _, every, value in done + groups:
                add[list(every), c] = value
        margins = margins + add
        out.append(margins.copy())
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_boosting_equals_a_plain_loop(spark, parts):
    x, y = data()
    df = frame(spark, x, y).repartition(parts)
    features = [f"x{i}" for i in range(5)]
    edges = B.quantile_edges(df, features, 6)
    binned = B.bin_rows(df, features, edges, fold=F.col("id") % 2, stop=F.col("id") % 5 == 0)
    assert binned.labels == ["c0", "c1", "c2"]
    configs = [B.Config(4, 10, 0.7, 3, 0.3), B.Config(3, 5, 1.0, 2, 0.5)]
    model = B.boost(binned, configs, rounds=10, patience=None)  # beyond one table of margins
    got = B.out_of_fold(binned, model).toPandas()
    assert got.groupby(["config", "id"]).p.sum().sub(1).abs().max() < 1e-12
    fold, stop = np.arange(len(x)) % 2, np.arange(len(x)) % 5 == 0
    for i, run in enumerate(model.runs):
        every = plain(x, edges, y, fold, stop, run, 10, 3, model.base[i])
        held = stop & (fold != run[1])
        loss = [-np.log(B._probabilities(m[held])[np.arange(held.sum()), y[held]]).mean() for m in every]
        assert np.allclose(model.losses[i], loss, atol=1e-6)
        assert model.best(i) == int(np.argmin(np.round(loss, 7)))
        p = B._probabilities(every[model.best(i)])
        mine = got[(got.config == configs.index(run[0])) & (got.fold == run[1])].pivot(index="id", columns="label", values="p")
        assert np.allclose(mine.to_numpy(), p[mine.index.to_numpy()], atol=1e-9)


def test_patience_refit_and_choice(spark):
    x, y = data(150)
    df = frame(spark, x, y)
    features = [f"x{i}" for i in range(5)]
    binned = B.bin_rows(df, features, B.quantile_edges(df, features, 6), fold=F.col("id") % 2, stop=F.col("id") % 3 == 0)
    truths = df.select("id", F.create_map("label", F.lit(1.0)).alias("truths"))
    configs = B.grid((2, 4), (5,), (1.0,), depth=2, rate=0.9)
    model, scores = B.cross_validate(binned, configs, truths, rounds=12, patience=2)
    assert all(len(t) < 12 or len(t) - model.best(i) <= 12 for i, t in enumerate(model.trees))
    assert any(len(t) < 12 for t in model.trees)
    rows = {r["config"]: r for r in scores.collect()}
    assert set(rows) == {0, 1} and all(r["n"] == 150 and r["macro_f1_mean"] > 0.4 and r["log_loss_mean"] < 0.9 for r in rows.values())
    want = min(rows.values(), key=lambda r: (-round(r["macro_f1_mean"], 6), r["log_loss_mean"]))["config"]
    assert B.select_config(scores).first()["config"] == want
    again, _ = B.cross_validate(binned, configs[:1], truths, rounds=4, patience=2, refit=True)
    assert [len(t) for t in again.trees] == [max(1, model.best(i)) if model.best(i) <= 4 else 4 for i in range(2)]


def test_waves_do_not_change_the_trees(spark, monkeypatch):
    x, y = data(120)
    df = frame(spark, x, y)
    binned = B.bin_rows(df, ["x0", "x1"], B.quantile_edges(df, ["x0", "x1"], 5), fold=F.col("id") % 3)
    key = lambda m: [[[tuple(map(tuple, t)) for t in r] for r in of] for of in m.trees]
    one = B.boost(binned, [B.Config(4, 5, 1.0, 2, 0.3)], rounds=2)
    monkeypatch.setattr(B, "CELLS", 1)
    assert key(B.boost(binned, [B.Config(4, 5, 1.0, 2, 0.3)], rounds=2)) == key(one)


def test_one_row_an_id_and_soft_rows(spark):
    df = spark.createDataFrame([(1, "a", 0.5, 0.6), (1, "b", 0.5, 0.4), (2, "b", None, 1.0), (3, None, 1.0, 1.0)], "id long, label string, x double, w double")
    with pytest.raises(ValueError):
        B.bin_rows(df, ["x"], [np.array([0.2])])
    soft = B.bin_rows(df, ["x"], [np.array([0.2])], weight=F.col("w"), soft=True)
    assert soft.rows.count() == 3 and B.out_of_fold(soft, B.boost(soft, [B.Config(2, 1)], [None], 1)).count() == 4


def test_mask(spark):
    p = spark.createDataFrame([(i, c, v) for i in range(4) for c, v in (("D05", 0.5), ("M01", 0.25), ("D08", 0.25))] + [(9, "D05", 1.0)], "id int, label string, p double")
    f = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0, float("nan")), (3, 0.0, 0.0, 0.0, 0.0), (9, 0.0, 0.0, 0.0, 0.0)], "id int, a_has_recursion double, a_str_literal_compare double, a_array_name_compare double, a_char_array_param double")
    need = {k: v for k, v in B.C.MASK_PRECONDITIONS.items() if k in ("D05", "D08")}
    got = {(r["id"], r["label"]): round(r["p"], 9) for r in B.mask(p, f, need).collect()}
    assert [got[0, c] for c in ("D05", "M01", "D08")] == [0, 0.5, 0.5]
    assert [got[1, c] for c in ("D05", "M01", "D08")] == [round(2 / 3, 9), round(1 / 3, 9), 0]
    assert [got[2, c] for c in ("D05", "M01", "D08")] == [0.5, 0.25, 0.25]
    assert [got[3, c] for c in ("D05", "M01", "D08")] == [0, 1, 0]
    assert got[9, "D05"] == 1
