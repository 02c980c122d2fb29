import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cogspark.llm import mixing, topk, url_filters

from .fixtures import documents, frame

RULES = url_filters.RULES


def brute_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_urls_match_brute_force(spark):
    rng = random.Random(3)
    hosts = ["net", "A.net", "example.net", "x.example.net", "example.com", "y.Example.COM", "org", "z.org", "spam.biz", "ok.biz", "knet"]
    urls = [None, "", "no scheme", "http://", "http://net", "https://a.net?q", "x://y://net/"] + [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/de/x', '/fr/', '/q'])}{rng.randint(0, 60)}{rng.choice(['', '?a/b', '#c'])}" for _ in range(900)]
    pages = spark.createDataFrame([(i % 800, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    keys = {brute_rule(u)[0] + brute_rule(u)[1] for u in urls}
    listed = set(rng.sample(sorted(keys), 60)) | {"elsewhere/x"}
    got = url_filters.filter_urls(pages, spark.createDataFrame([(k,) for k in listed] + [(None,)], "key string")).collect()
    want = Counter()
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_rule(u)
        want[(i % 800, host, path, rule, verdict or ("block" if host + path in listed else "allow"))] += 1
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == want
    # levels too large to travel are probed by joins and say the same
    wide = url_filters.filter_urls(pages, spark.createDataFrame([(k,) for k in listed], "key string"), most_bits=0).collect()
    assert sorted(map(str, wide)) == sorted(map(str, got))


def test_urls_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.filter_urls(none, spark.createDataFrame([], "key string")).count() == 0


def brute_top(vectors, queries, k):
    rows = [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in set(rows):
        if i in queries:
            s = sorted(((sum(a * b for a, b in zip(q, c)), j) for j, c in rows if j != i), key=lambda x: (-x[0], x[1]))[:k]
            out |= {(i, r + 1, j, v) for r, (v, j) in enumerate(s)}
    return out


def test_top_k_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(40)], 1) for i in range(700)]
    rows += [(800 + i, rows[7][1], 1) for i in range(30)]  # ties
    rows += [(1, rows[1][1], 1), (900, None, 1), (901, [1.0, None] * 20, 1), (902, [float("nan")] * 40, 1), (903, [float("inf")] * 40, 1), (904, [0.5, -2.0], 1), (905, [], 1), (906, [1e20] * 3, 1), (None, [1.0] * 40, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    for block in (2048, 5):
        got = topk.top_k(df.drop("rank") if block == 5 else df, F.col("vec_id") % 50 == 0, k=10, block=block).collect()
        got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got}
        want = {(q, r, j, max(-(2**63), min(2**63 - 1, s))) for q, r, j, s in brute_top([x[:2] for x in rows], {i for i in range(1000) if i % 50 == 0}, 10)}
        assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_counts_repeated_rows(spark):
    rng = random.Random(6)
    rows = [(1, [9.0, 9.0])] * 30 + [(i, [rng.random(), rng.random()]) for i in range(2, 60)] + [(100, [1.0, 1.0])] * 3
    for parts, block, group in ((1, 2048, 1 << 18), (6, 1, 7)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
        got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k=40, block=block, group=group).collect()]
        q = [1024, 1024]
        every = sorted((-sum(a * math.floor(1024 * b) for a, b in zip(q, np.array(v, np.float32).tolist())), i) for i, v in rows if i != 100)
        assert sorted(got) == [(r + 1, i, -s) for r, (s, i) in enumerate(every[:40])]


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    target, budget, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        unit = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        open_ -= full
    return target


def test_mix(spark):
    df = frame(spark)
    rows = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    docs = documents()
    assert len(rows) == len(docs)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for d in docs:
        sizes[d[3]] += size(d[1])
    target, by_size = brute_targets(sizes), Counter(size(d[1]) for d in docs)
    assert Counter(r["size"] for r in rows) == by_size
    assert all(0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in rows)
    taken, seen = Counter(), {}
    source_of = {(d[0], size(d[1])): d[3] for d in docs}
    for r in rows:
        s = source_of[(r["doc_id"], r["size"])]
        taken[s] += r["taken"]
        seen[s] = (r["source_size"], r["target"])
    for s, (own, t) in seen.items():
        assert own == sizes[s] and abs(t - target[s]) < 1e-6 * max(1, t)
        largest = max(size(d[1]) for d in docs if d[3] == s)
        assert abs(taken[s] - t) <= largest
    full = mixing.mixed_rows(df)
    assert full.columns == df.columns and full.count() == sum(r["copies"] for r in rows)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    nothing = mixing.mix_sources(frame(spark, [(1, None, "en", None, 0, 0.0, "", 0, 0, 0, 0, "", 0, 0.0, "")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0)]


def test_mix_takes_the_first_by_rank(spark):
    """The set taken against sorting each source whole; the hashes are Spark's."""
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.choice([1, 3, 9, 30, 120]))), f"s{i % 3}") for i in range(400)] + [(1000, None, "s0"), (1001, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(df)
    ranked = mix._ranked(mix.narrow).collect()
    got = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(df).collect()}
    for source in ("s0", "s1", "s2"):
        own = [r for r in ranked if r["source"] == source]
        want = {r["id"]: (r["__whole"] if r["size"] else 0) for r in own}
        left, taken = sum(r["size"] * r["__p"] for r in own if r["__rank"] is not None), 0
        for r in sorted((r for r in own if r["__rank"] is not None), key=lambda r: (r["__rank"], r["__order"])):
            if taken + r["size"] / 2 <= left:  # the one on the border, if that comes nearer
                want[r["id"]] += 1
            taken += r["size"]
        assert {i: got[i] for i in want} == want


def test_mix_splits_repeated_rows_at_the_border(spark):
    """Rows with one id and text are tied; the border takes as many of them as the target needs."""
    hot = spark.range(1200).select(F.lit(7).cast("long").alias("doc_id"), F.lit("w " * 50).alias("text"), F.lit("z").alias("source"))
    rest = spark.range(1200).select((F.col("id") + 100).alias("doc_id"), F.lit("v " * 130).alias("text"), F.when(F.col("id") % 2 == 0, "b").alias("source"))
    df = hot.unionByName(rest)
    got = mixing.mix_sources(df)
    by = {r["target"]: r for r in got.groupBy("target").agg(F.sum("taken").alias("taken"), F.max("size").alias("size")).collect()}
    assert sorted(by) == [56000.0, 112000.0, 156000.0] and by[112000.0]["taken"] == 112000
    assert all(abs(r["taken"] - t) <= r["size"] / 2 for t, r in by.items())
    assert all(0 <= r["copies"] <= 2 for r in got.select("copies").distinct().collect())
    again = mixing.mix_sources(df.repartition(3))
    count = lambda d: Counter(map(tuple, d.collect()))
    assert count(got) == count(again)
    full = count(mixing.mixed_rows(df).groupBy("source").count())
    assert full == count(got.join(df.distinct(), "doc_id").groupBy("source").agg(F.sum("copies")))


def test_mix_targets_random(spark):
    rng = random.Random(2)
    for n in (1, 4, 9):
        sizes = {None if i == 0 else f"s{i}": rng.choice([0, 1, 50, 1000, 90000]) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)
