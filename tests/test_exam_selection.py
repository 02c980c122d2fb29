"""The next item of open exams against a plain loop over sessions and items."""

import hashlib
import math
import random

import pytest

from cogspark.functions import constants as C
from cogspark.operators import exam as X

SESSION = "exam_id long, learner_id long, p map<string,double>, theta map<string,double>, covered array<string>, tested array<string>, states map<string,string>, used array<string>, left map<string,int>, by_sector map<string,int>, last_sector string, sectors array<string>, slots int, stable_since map<string,string>, extra string"
POOL = "item_id string, kind string, difficulty int, sector string, exposure map<string,double>, name string, score double"


def entropy(p):
    return 0.0 if p <= 0 or p >= 1 else -p * math.log2(p) - (1 - p) * math.log2(1 - p)


def bits(p, x):
    fail = p * x + (1 - p) * C.FAIL_IF_NOT
    return max(0.0, entropy(p) - fail * entropy(p * x / fail) - (1 - fail) * entropy(p * (1 - x) / (1 - fail)))


def key(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:16]


def counted(session, item):
    return {c: bits(session["p"].get(c, 0.0), x) for c, x in item["exposure"].items() if c in C.MISCONCEPTIONS and x >= C.EXAM_MIN_EXPOSURE}


def rechecked(session, item):
    return {c for c, x in item["exposure"].items() if x > 0 and session["states"].get(c) == "STABLE" and c not in session["tested"]}


def plain(session, pool, per_sector=2):
    def score(item):
        rating = C.ELO_ITEM[item["difficulty"]]
        off = abs(1 / (1 + 10 ** ((rating - session["theta"].get(item["sector"], C.ELO_START)) / 400)) - C.EXAM_TARGET_PASS)
        new = item["sector"] not in session["covered"]
        ghost = sum(item["exposure"][c] for c in rechecked(session, item))
        return sum(counted(session, item).values()) / C.EXAM_COST[item["kind"]] + C.EXAM_W_COVERAGE * new - C.EXAM_W_DIFFICULTY * off + C.EXAM_W_GHOST * ghost

    who = (session["learner_id"], session["exam_id"])
    if not session["used"]:
        fit = [i for i in pool if i["kind"] == "coding" and i["difficulty"] == 1 and i["sector"] in session["sectors"]]
        most = {}
        for i in fit:
            most[i["sector"]] = max(most.get(i["sector"], 0.0), sum(counted(session, i).values()))
        sector = min(most, key=lambda s: (-round(most[s], 9), key(*who, s)), default=None)
        fit = [i for i in fit if i["sector"] == sector]
    else:
        after = sum(session["left"].values()) - 1
        fit = [
            i for i in pool
            if i["item_id"] not in session["used"] and i["sector"] in session["sectors"] and i["sector"] != session["last_sector"] and session["left"].get(i["kind"], 0) > 0
            and (i["kind"] != "coding" or session["by_sector"].get(i["sector"], 0) < per_sector)
            and (session["slots"] < len(session["sectors"]) or len(set(session["sectors"]) - set(session["covered"]) - {i["sector"]}) <= after)
        ]
    best = min(fit, key=lambda i: (-round(score(i), 9), key(*who, i["item_id"])), default=None)
    return best and (best["item_id"], pytest.approx(score(best), abs=1e-9), pytest.approx(sum(counted(session, best).values()), abs=1e-9))


def cases():
    rng = random.Random(4)
    sectors, classes = ["s1", "s2", "s3", "s4"], ["M01", "M02", "D01", "D05", "CORRECT"]
    pool = [{"item_id": f"I{i}", "kind": rng.choice(["coding", "trace"]), "difficulty": rng.choice([1, 2, 3]), "sector": rng.choice(sectors), "exposure": {c: rng.choice([0.0, 0.1, 0.4, 0.7]) for c in rng.sample(classes, rng.randint(0, 3))}, "name": rng.choice([None, "a name"]), "score": 1.0} for i in range(90)]
    pool += [{**pool[3], "item_id": f"copy{i}"} for i in range(8)]  # ties
    out = []
    for e in range(60):
        plan = rng.sample([*sectors, "none"], rng.randint(1, 4))
        begun = e % 3 > 0
        covered = rng.sample(plan, rng.randint(0, len(plan))) if begun else []
        out.append({
            "exam_id": e, "learner_id": e % 7, "p": {c: rng.choice([0.0, 0.15, 0.5, 1.0]) for c in rng.sample(classes, 3)}, "theta": {s: rng.choice([1100.0, 1400.0]) for s in plan[1:]}, "covered": covered, "tested": rng.sample(classes, 1),
            "states": {c: rng.choice(["STABLE", "ACTIVE"]) for c in rng.sample(classes, 3)}, "used": [i["item_id"] for i in rng.sample(pool, rng.randint(1, 60))] if begun else [], "left": {"coding": rng.randint(0, 2), "trace": rng.randint(0, 2)},
            "by_sector": {s: rng.randint(0, 2) for s in covered}, "last_sector": covered[-1] if covered else None, "sectors": plan, "slots": rng.randint(1, 6), "stable_since": {"M01": "May"}, "extra": "x"})
    out.append({**out[1], "exam_id": 900, "used": [i["item_id"] for i in pool]})  # nothing left
    return out, pool


@pytest.mark.parametrize("tile", [2, 256])
def test_next_item_equals_plain_loop(spark, monkeypatch, tile):
    monkeypatch.setattr(X, "TILE", tile)
    sessions, pool = cases()
    frame = lambda rows, schema: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    rows = X.recommend_next(frame(sessions, SESSION), frame(pool, POOL)).collect()
    got = {r["exam_id"]: (r["item_id"], r["score"], r["eig"]) for r in rows}
    want = {s["exam_id"]: w for s in sessions if (w := plain(s, pool))}
    assert got == want and len(got) > 25 and 900 not in got and len(rows) == len(got)
    by, items = {s["exam_id"]: s for s in sessions}, {i["item_id"]: i for i in pool}
    for r in rows:
        s, i = by[r["exam_id"]], items[r["item_id"]]
        two = sorted(counted(s, i).items(), key=lambda c: (-round(c[1], 9), c[0]))[:2]
        for c, _ in two:
            again = c in rechecked(s, i)
            assert (f"{c} (stable since May → recheck)" in r["reason"]) == (again and c == "M01")
            assert (f"{c} (stable → recheck)" in r["reason"]) == (again and c != "M01")
        assert ("no class above" in r["reason"]) == (not two)
        assert (f"covers {i['sector']}" in r["reason"]) == (i["sector"] not in s["covered"])
        assert r["reason"].startswith(f"{i['item_id']} a name —" if i["kind"] == "coding" and i["name"] else f"{i['item_id']} —")


def test_next_item_of_empty_tables(spark):
    sessions, pool = cases()
    s = spark.createDataFrame([tuple(r.values()) for r in sessions], SESSION)
    p = spark.createDataFrame([tuple(r.values()) for r in pool], POOL)
    assert X.recommend_next(s.limit(0), p).count() == 0 and X.recommend_next(s, p.limit(0)).count() == 0
