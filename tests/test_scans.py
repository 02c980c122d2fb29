"""Prefix scans, folds and places within keys, against plain loops; hot keys over many ranges."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cogspark.functions import constants as C
from cogspark.operators import curate as D
from cogspark.operators import exam as X
from cogspark.operators import knowledge as K
from cogspark.operators import shared as S


def events(n=6000, seed=1):
    rng = random.Random(seed)
    kinds = ["trap", "transfer_code", "belief_mcq", "ghost", "same_family_code", "intervention_done", "forgetting"]
    rows = []
    for i in range(n):
        hot = rng.random() < 0.7
        rows.append((7 if hot else rng.randint(1, 40), "M01" if hot else rng.choice(["M01", "M02"]), datetime(2024, 1, 1) + timedelta(minutes=rng.randint(0, n // 2)), i, rng.choice(kinds), rng.random() < 0.5, rng.random() < 0.2, rng.randint(0, 3)))
    return rows


def test_trajectory_of_hot_keys(spark):
    rows = events()
    df = spark.createDataFrame(rows, "learner_id long, class string, ts timestamp, seq long, kind string, correct boolean, hint boolean, levels int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = K.knowledge_trajectory(df)
        got = {(r.learner_id, r["class"], r.seq): (r.p_before, r.p_after) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    routed = {r.seq: r for r in K.route_events(df).filter("affects").collect()}
    p, want = {}, {}
    for lid, cls, ts, seq, kind, *_, levels in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        if seq not in routed:
            continue
        e, q = routed[seq], p.get((lid, cls), C.POPULATION_PRIOR)
        if kind == "intervention_done":
            after = q * (1 - C.LEARN_RATE)
        elif kind == "forgetting":
            after = 1 - (1 - q) * (1 - C.FORGET_RATE) ** max(levels, 0)
        else:
            after = q * e.if_active / (q * e.if_active + (1 - q) * e.if_not)
        want[lid, cls, seq], p[lid, cls] = (q, after), after
    assert got.keys() == want.keys()
    assert max(abs(a - b) for k in want for a, b in zip(got[k], want[k])) < 1e-9


def test_prefix_products_over_batches():
    rng = np.random.default_rng(3)
    m, new = rng.random((500, 4)) + 0.01, rng.random(500) < 0.02
    new[0] = True
    carry, out = K._UNIT, []
    for lo, hi in ((0, 1), (1, 120), (120, 121), (121, 500)):
        before, carry = K.prefix_products(m[lo:hi], new[lo:hi], carry)
        out.append(before)
    got, at = np.vstack(out), np.eye(2)
    for i in range(500):
        at = np.eye(2) if new[i] else at
        assert np.allclose(got[i] / got[i].sum(), at.ravel() / at.sum(), rtol=1e-9)
        at = m[i].reshape(2, 2) @ at
        at /= at.max()


def test_elo_of_long_exams_and_nulls(spark):
    rng = random.Random(2)
    rows = [(1, "a", i, rng.randint(1, 3), rng.random() < 0.5, i == 5) for i in range(3000)] + [(2, None, 1, 2, True, None), (2, "b", 2, None, True, False), (2, "b", 1, 1, False, False)]
    got = {(r.exam_id, r.sector, r.seq): r.theta for r in X.elo_trajectory(spark.createDataFrame(rows, "exam_id int, sector string, seq long, difficulty int, passed boolean, bonus boolean").repartition(5)).collect()}
    t = C.ELO_START + C.ELO_BONUS
    for e, s, i, d, p, _ in rows[:3000]:
        t += C.ELO_K * (p - 1 / (1 + 10 ** ((C.ELO_ITEM[d] - t) / 400)))
        assert abs(got[e, s, i] - t) < 1e-6
    assert got[2, "b", 2] is None and got[2, "b", 1] < C.ELO_START < got[2, None, 1]


@pytest.mark.parametrize("by", [("k",), ()])
def test_numbers_and_sums_by_ranges(spark, by):
    rng = random.Random(5)
    rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randint(0, 30), i, rng.randint(1, 5)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, x int, id int, n int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: (r.place, r.total) for r in S.running(S.numbered(df, by, ["x", "id"], "place"), "x", by, total="n").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, x, i, _ in rows:
        own = [r for r in rows if not by or r[0] == k]
        assert got[i] == (1 + sum((r[1], r[2]) < (x, i) for r in own), sum(r[3] for r in own if r[1] <= x))


def test_long_lists_by_label(spark, monkeypatch):
    rows = [(i, "M01" if i % 3 else "D01", f"p{i % 5}", f"o{i % 2}") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, label string, problem_id string, op_id string")
    take = lambda: sorted((r.id, r.turn, r["rank"]) for r in D.capped_round_robin(df, "label", ["problem_id", "op_id"], 90, 60, 9).collect())
    fill = lambda: sorted(r.id for r in D.backfill(df, df.filter("id % 7 = 0"), floor=70).collect())
    few = take(), fill()
    monkeypatch.setattr(D, "FEW", 0)
    assert (take(), fill()) == few and len(few[0]) == 180
    ids = {r.id: r.new_id for r in D.assign_ids(df.withColumn("source", F.col("op_id")), ["label", "id"]).collect()}
    for s in ("o0", "o1"):
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[1], r[0]))
        assert [ids[r[0]] for r in own] == [f"{s}-{i:06d}" for i in range(1, len(own) + 1)]
