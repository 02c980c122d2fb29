"""Cases by hand for rules that the queries' tables do not show."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from cogspark import streaming
from cogspark.functions import columns as L
from cogspark.functions import constants as C
from cogspark.operators import bayes as B
from cogspark.operators import boosting as G
from cogspark.operators import curate as D
from cogspark.operators import knowledge as K
from cogspark.operators import traces as R


def test_references_of_two_problems_are_told_apart(spark):
    runs = spark.createDataFrame([(1, "P", 0, "ok", 1), (1, "P", 1, "ok", 3), (1, "P", 2, "timeout", 1), (2, "Q", 0, "ok", 51)], "attempt_id int, problem_id string, test int, status string, iterations int")
    ref = spark.createDataFrame([("P", 0, 2), ("P", 1, 2), ("P", 2, 4), ("Q", 0, 50)], "problem_id string, test int, iterations int")
    got = {r["attempt_id"]: r for r in R.iteration_deltas(runs, ref).collect()}
    assert got[1]["mean_delta"] == pytest.approx((-1 + 1 - 3) / 3) and got[1]["early_share"] == pytest.approx(1 / 3)
    assert (got[2]["mean_delta"], got[2]["always_plus_one"], got[2]["early_share"]) == (1, 1, 0)


def test_base_return_and_arguments(spark):
    cols = "attempt_id int, test int, i long, depth int, args array<int>, fn string, returned boolean, ok boolean"
    rows = [(1, 0, 0, 1, [5, 1], "f", False, True), (1, 0, 1, 2, [5, 2], "f", False, True), (1, 0, 2, 3, [4, 3], "f", False, True)]  # void, ran ok
    rows += [(2, 0, 0, 1, [5, 1], "f", False, False), (2, 0, 1, 2, [5, 1], "g", False, False)]  # another function is no caller
    rows += [(3, 0, 0, 1, [2, 2], "f", True, True), (3, 0, 1, 2, [2, 2], "f", False, True)]
    got = {r["attempt_id"]: tuple(r)[3:] for r in R.recursion_features(spark.createDataFrame(rows, cols), spark.createDataFrame([(0, 1)], "test int, depth int")).collect()}
    assert got == {1: (False, True, True), 2: (False, False, False), 3: (True, False, False)}


def test_sorted_share_leaves_short_arrays_out(spark):
    rows = [(1, 0, [1], [1]), (1, 1, [1, 2, 3], [3, 1, 2]), (2, 0, [], [])]
    got = {r["attempt_id"]: r["sorted_fraction"] for r in R.sorted_share(spark.createDataFrame(rows, "attempt_id int, id int, before array<int>, after array<int>")).collect()}
    assert got == {1: 0.5, 2: None}


def test_branches_name_the_first_recorded_line(spark):
    b = spark.createDataFrame([(1, 9, 2, 0, 1), (1, 5, 2, 0, 2), (2, None, None, None, None)], "attempt_id int, line int, t int, f int, ord int")
    got = {r["attempt_id"]: tuple(r)[1:] for r in R.branch_features(b, spark.createDataFrame([(9, 1, 1)], "line int, t int, f int")).collect()}
    assert got == {1: (1, 0, 9, None), 2: (0, 0, None, None)}


def test_priors_cues_and_no_candidates(spark):
    c = spark.createDataFrame([(1, "M01", 0.5), (1, "M02", None), (1, "M03", 0.2), (2, "M01", None), (2, "M02", None)], "key int, label string, prior double")
    a = spark.createDataFrame([(k, None, 1 if k == 3 else 0, False, False) for k in (1, 2, 3)], "key int, found string, hedges int, is_correct boolean, needs_probe boolean")
    cues = spark.createDataFrame([(2, "M02", 0.0)], "key int, label string, strength double")
    got = {(r["key"], r["label"]): r for r in B.fuse_multimodal(c, a, cues).collect()}
    assert got[1, "M01"]["rank"] == 1 and got[1, "M02"]["p"] == pytest.approx((1 / 3) / (0.5 + 1 / 3 + 0.2))
    assert got[2, "M02"]["p"] == pytest.approx(1.35 / 2.35)
    other = got[3, "OTHER"]
    assert (other["p"], other["status"]) == (0.5, "confident") and other["top_p"] == pytest.approx(max(0.4, 0.5 - C.HEDGE_PENALTY))


STEP = "attempt_id int, test int, i int, line int, pass int, vars map<string,string>, effects array<string>, events array<string>, loop_vars array<string>"


def runs(spark, passes, attempt=1, loop_vars=("i",), outside=()):
    """Steps of a run: a list of passes, each a list of (vars, effects, events)."""
    rows, n = [(attempt, 0, i, 1, None, v, e, x, list(loop_vars)) for i, (v, e, x) in enumerate(outside)], len(outside)
    for k, steps in enumerate(passes):
        for v, e, x in steps:
            rows.append((attempt, 0, n, 10 + n, k, v, e, x, list(loop_vars)))
            n += 1
    return spark.createDataFrame(rows, STEP)


def line(spark, learner, reference):
    ref = None if reference is None else reference.drop("attempt_id")
    return [(r["step"], r["flag"], r["effect"]) for r in R.timeline(learner, ref).orderBy("k").collect()]


def test_timeline_against_the_reference(spark):
    v = lambda **k: {n: None if x is None else str(x) for n, x in k.items()}
    climbs = [[(v(s=0, i=0), [], []), (v(s=1, i=0), [], [])], [(v(s=1, i=1), [], []), (v(s=3, i=1), [], [])], [(v(s=6, i=2), [], [])]]
    back = [[(v(s=0, i=0), [], []), (v(s=1, i=0), ["compare:a", "read_cell:0"], [])], [(v(s=0, i=1), ["call:f:1"], []), (v(s=2, i=1), [], [])], [(v(s=2, i=2), [], [])]]
    assert line(spark, runs(spark, back), runs(spark, climbs, 9)) == [(1, None, "compare:a"), (2, "reset", "call:f:1"), (4, None, None)]
    assert [f for _, f, _ in line(spark, runs(spark, back), runs(spark, back, 9))] == [None, None, None]  # the reference resets it too
    assert [f for _, f, _ in line(spark, runs(spark, back, loop_vars=("s",)), runs(spark, climbs, 9))] == [None] * 3  # named by the header
    early = [climbs[0], [(v(s=1, i=1), ["ret:1"], [])]]
    assert line(spark, runs(spark, early), runs(spark, climbs, 9)) == [(1, None, None), (2, "early_return", "ret:1"), (3, "missing", None)]
    assert [f for _, f, _ in line(spark, runs(spark, climbs + [[(v(s=9, i=3), [], [])]]), runs(spark, climbs, 9))][-1] == "extra"
    flagged = [[(v(s=0), [], ["assign_in_cond"]), (v(s=1), ["write_cell:0"], ["uninit_read"])], [(v(s=1), ["read_void:p"], ["empty_body"])]]
    assert line(spark, runs(spark, flagged), None) == [(0, "static", "write_cell:0"), (2, "void_read", "read_void:p")]
    many = [[(v(s=k), [], [])] for k in range(20)]
    assert [s for s, _, _ in line(spark, runs(spark, many), None)] == [*range(10), 18, 19]
    assert [f for _, f, _ in line(spark, runs(spark, many[:2]), runs(spark, many, 9))] == [None] * 2 + ["missing"] * 10
    flat = [(v(s=0), [], []), (v(s=0), [], []), (v(s=1), [], []), (v(s=1), ["ret:1"], []), (v(s=1), [], ["oob_read"]), (v(s=1), [], []), (v(s=1), [], [])]
    assert line(spark, runs(spark, [], outside=flat), None) == [(0, None, None), (2, None, None), (3, None, "ret:1"), (4, "void_read", None), (6, None, None)]


def test_stream_states_with_exams_equal_the_fold(spark):
    from cogspark.plans import model_queries as Z

    rng, rows = random.Random(6), []
    kinds = ["signature_failure", "latent_pass", "exam_code", "exam_trace", "ghost", "trap", "transfer_code", "intervention_done"]
    for k in range(25):
        for i in range(40):
            kind = rng.choice(kinds if i > 4 else ["signature_failure"])
            rows.append((k, "M01", k * 100 + i, i, kind, rng.random() < 0.75, False, rng.randint(0, 2), rng.choice(["count_loop", "array_accumulate"]), f"I{i}", rng.choice([None, 0.3, 0.6, 0.8]), kind in ("signature_failure", "latent_pass") and rng.random() < 0.6))
    df = spark.createDataFrame(rows, "learner_id long, class string, seq long, t int, kind string, correct boolean, hint boolean, levels int, family string, item_id string, exposure double, exam boolean").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))).drop("t")
    log = Z._drain(streaming.stream_states(Z._as_stream(df)), "append")
    last = {r["learner_id"]: (r["x"]["state_after"], round(r["x"]["p_after"], 9)) for r in log.groupBy("learner_id").agg(F.max_by(F.struct("state_after", "p_after"), "seq").alias("x")).collect()}
    want = {r["learner_id"]: (r["state"], round(r["p_active"], 9)) for r in K.mastery_fold(df).collect()}
    assert last == want and len({s for s, _ in want.values()}) > 2


def test_matching_ratio_and_bank(spark):
    rng, parts = random.Random(3), ["for (i = 0; i < n; i++)", "s += a[i];", "return s;", "int s = 0;", "while (lo < hi)", "if (x == y)", "printf(x);"]
    rows = []
    for i in range(160):
        code = " ".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))
        rows.append((i, rng.choice(["M01", "M02"]), rng.choice(list(C.WANTED)[:3]), code, i % 9 == 0, i % 4 != 0, i % 13 == 0))
    df = spark.createDataFrame(rows, "item_id int, class string, type string, code string, collision boolean, has_options boolean, in_problem boolean")
    pairs = df.select("code", F.lead("code").over(D.W.orderBy("item_id")).alias("other")).filter("other is not null")
    for r in pairs.select("*", L.matching_ratio(F.col("code"), F.col("other")).alias("r"), L.is_close(F.col("code"), F.col("other")).alias("c")).collect():
        want = difflib.SequenceMatcher(None, r["code"], r["other"]).ratio()
        assert r["r"] == pytest.approx(want) and r["c"] == (want > 0.8)
    taken = spark.createDataFrame([(rows[5][3] + "  ",)], "code string")
    got = sorted((r["class"], r["slot"], r["item_id"], r["kind"]) for r in D.choose_bank(df, taken=taken).collect())
    used, pool, want = {" ".join(rows[5][3].split())}, [], []
    for r in rows:
        if not r[6] and " ".join(r[3].split()) not in used:
            used.add(" ".join(r[3].split()))
            pool.append(r)
    want += [(r[1], 0, r[0], r[2]) for r in pool if r[4] and r[2] in ("predict_output", "mcq")]
    for cls in ("M01", "M02"):
        chosen, gone, slot = [], set(), 0
        for kind, n in C.WANTED.items():
            for k in range(n):
                slot += 1
                for r in pool:
                    fits = r[1] == cls and not r[4] and r[0] not in gone and r[2] == ("predict_output" if kind == "reasoning" else kind) and (kind == "reasoning" or r[5])
                    if fits and not any(difflib.SequenceMatcher(None, r[3], o).ratio() > 0.8 for o in chosen):
                        chosen.append(r[3])
                        gone.add(r[0])
                        want.append((cls, slot, r[0], kind))
                        break
    assert got == sorted(want)
    gaps = {(r["class"], r["kind"]): r["got"] for r in D.bank_gaps(D.choose_bank(df, taken=taken), ["M01", "M02", "M03"]).collect()}
    assert gaps["M03", "mcq"] == 0 and all((c, k) in gaps or sum(x[0] == c and x[3] == k and x[1] > 0 for x in want) == C.WANTED[k] for c in ("M01", "M02") for k in C.WANTED)


def test_shift_report(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, f"g{i % 30}", (i % 2) * 0.8 + rng.random(), rng.random()) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, side int, g string, x double, y double")
    got = {r["key"]: r for r in G.check_shift(df, ["x", "y"], "side", "g", folds=3, rounds=4, config=G.Config(4, 5, 1.0, 2, 0.5)).collect()}
    assert got["auroc"]["status"] == "FAIL" and got["lo"]["value"] < got["auroc"]["value"] < got["hi"]["value"]
    assert got["gain:x"]["value"] > 0.7 and sum(r["value"] for k, r in got.items() if k.startswith("gain")) == pytest.approx(1)
    noise = {r["key"]: r for r in G.check_shift(df, ["y"], "side", "g", folds=3, rounds=2, config=G.Config(4, 5, 1.0, 2, 0.5)).collect()}
    assert noise["auroc"]["status"] == "PASS"
    assert G.check_shift(df.filter("side = 1"), ["x"], "side", "g").first()["status"] == "SKIP"
