import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np

from cogspark.llm import components, ngram_join, suffix_dedup

from .fixtures import documents, frame


def brute_repeats(texts, n=200):
    raw, count = [(t or "").encode() for t in texts], Counter()
    for b in raw:
        count.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        hit = [False] * len(b)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                hit[i : i + n] = [True] * n
        kept = bytes(x for x, h in zip(b, hit) if not h)
        spans = sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit))
        out.append((len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_repeats_match_brute_force(spark, monkeypatch):
    df, docs = frame(spark), documents()
    want = brute_repeats([d[1] for d in docs])
    for block, segment in ((3 << 20, (1 << 18) - 4096), (6000, 700)):  # one block, many small ones
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
        got = suffix_dedup.repeat_digest(df).collect()
        assert Counter(map(tuple, got)) == Counter((d[0], *w[:4]) for d, w in zip(docs, want))
    kept = suffix_dedup.remove_repeats(df)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((d[0], None if d[1] is None else w[4].decode("utf-8", "ignore")) for d, w in zip(docs, want))
    assert suffix_dedup.repeat_digest(df.limit(0)).count() == 0


def test_repeats_inside_a_text_and_across_segments(spark, monkeypatch):
    rng = random.Random(4)
    a, b = ("".join(rng.choice("abcd ") for _ in range(400)) for _ in range(2))
    texts = [a + b + a, b[50:330] + "?" + a[100:299], a[100:300], "z" * 450, None]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 150)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeat_digest(df).collect()}
    assert [got[i] for i in range(len(texts))] == [w[:4] for w in brute_repeats(texts)]


def test_multikey_order():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 4, 3000).astype(np.uint64) for _ in range(4)]
    order = suffix_dedup.multikey_order(words)
    keys = list(zip(*(w[order].tolist() for w in words)))
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(3000))


def brute_join(docs):
    sets = []
    for d in docs:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    link = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and (a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9):
                link[i].add(j)
    out = []
    for i, a in enumerate(sets):
        seen, open_ = {i}, [i]
        while open_:
            for j in link[open_.pop()] - seen:
                seen.add(j)
                open_.append(j)
        ids = [docs[j][0] for j in seen if docs[j][0] is not None]
        out.append((docs[i][0], (min(ids) if ids else None) if a else docs[i][0], len(link[i]), len({sets[j] for j in link[i]} - {a})))
    return out


def test_join_matches_brute_force(spark, monkeypatch):
    df, docs = frame(spark), documents()
    want = Counter(brute_join(docs))
    assert Counter(map(tuple, ngram_join.ngram_join(df).collect())) == want
    assert any(w[2] >= 5 for w in want)
    monkeypatch.setattr(ngram_join, "CHUNK", 2)  # a component over several chunks
    monkeypatch.setattr(ngram_join, "HOT", 2)  # copies joined apart
    assert Counter(map(tuple, ngram_join.ngram_join(df).collect())) == want
    assert ngram_join.ngram_join(df.limit(0)).count() == 0
    firsts = ngram_join.ngram_join(df, firsts=True).collect()
    groups = Counter(w[1] for w in brute_join(docs) if w[1] is not None)
    assert len({(r["doc_id"], r["tie"]) for r in firsts if r["first"] and r["grouped"]}) <= len(groups) + 2


def test_prefix_depth_keeps_recall():
    d = ngram_join.prefix_depth()
    assert 1 - (1 - 0.8**d) ** ngram_join.TREES >= ngram_join.RECALL
    assert 1 - (1 - 0.8 ** (d + 1)) ** ngram_join.TREES < ngram_join.RECALL


def test_shared_values():
    a = np.zeros((3, 2), np.uint64)
    a[1] = (0, 1 << 48)
    a[2] = (1, 0)
    assert ngram_join.shared_values(a[:, 0], a[:, 1]).tolist() == [0, 4, 3]


def test_forest_ties_are_the_runs_of_each_prefix(spark):
    """For each depth the ties' components are the groups of equal prefixes, over batches and ranges."""
    rng = random.Random(11)
    keys = [[(t << 59) | rng.choice([0, 1 << 48, 1 << 32]) | rng.choice([0, 1, 2]) if i % 2 == 0 else rng.choice([0, 1 << 48, 1 << 32, 1]) for t in range(3) for i in range(2)] for _ in range(150)]
    classes = spark.createDataFrame([(bytes([k]) * 16, x) for k, x in enumerate(keys)], "set binary, keys array<long>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    ties = ngram_join.forest_ties(classes, 2, 3, 8).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    values = lambda hi, lo, d: [(x % 2**64 >> (48 - 16 * i)) & 0xFFFF for x in (hi, lo) for i in range(4)][:d]
    for d in range(2, 9):
        for t in range(3):
            groups = defaultdict(set)
            for k, x in enumerate(keys):
                groups[tuple(values(x[2 * t], x[2 * t + 1], d))].add(k)
            of = {k: k for k in range(150)}
            find = lambda x: x if of[x] == x else find(of[x])
            for r in ties:
                if (r["hi"] >> 59) % 32 == t and r["level"] >= d:
                    x, y = find(r["a"][0]), find(r["b"][0])
                    of[max(x, y)] = min(x, y)
            got = defaultdict(set)
            for k in range(150):
                got[find(k)].add(k)
            assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_shortening_follows_what_was_found(spark):
    rows = lambda per: spark.createDataFrame([(t << 59, bytes([k]), 8) for k in range(100) for t in range(per)], "hi long, a binary, own int")
    assert ngram_join.shortened(rows(12), 5, 8, 0.99) == 8  # every text met in many trees
    assert ngram_join.shortened(rows(1), 5, 8, 0.99) == 5  # every text met in one: many are missing
    assert ngram_join.shortened(rows(12).limit(0), 5, 8, 0.99) == 5


def test_recall_of_pairs_near_the_threshold(spark):
    """Planted pairs of a similarity from 0.8 to 0.85: nearly all of them are found, at any depth that is chosen."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, pairs = [], 0
    for p in range(300):
        w = [word() for _ in range(100)]
        v = list(w)
        for k in rng.sample(range(8), 2):  # 2 words changed far apart: 10 of 96 n-grams each differ
            v[6 + 11 * k] = word()
        a, b = ({tuple(x[i : i + 5]) for i in range(96)} for x in (w, v))
        assert 0.8 <= len(a & b) / len(a | b) <= 0.85
        rows += [(2 * p, " ".join(w)), (2 * p + 1, " ".join(v))]
        pairs += 1
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_texts = 1").count() / 2
    assert got >= 0.99 * pairs


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    sizes = Counter(find(x) for x in list(parent))
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent) if sizes[find(x)] > 1}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
