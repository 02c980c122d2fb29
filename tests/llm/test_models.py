import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from cogspark.llm import language_id, pitman_yor, toxicity

from .fixtures import documents, frame


def held(i, mod, value):
    return i is not None and zlib.crc32(str(i).encode()) % mod == value


def languages(n=240, seed=1):
    rng = random.Random(seed)
    parts = {"en": "th ing er on and re", "de": "sch ung en keit ber ü", "fr": "eau tion é oi elle ment", "es": "ción ado ñ ez que ll"}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        text = " ".join("".join(rng.choice(parts[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60)))
        rows.append((i, text, lang))
    return rows


def test_language_id(spark):
    rows = languages()
    odd = [(1000, None, "en"), (1001, "", "fr"), (1002, "12 34 !?", "de"), (1003, "the", None), (None, "sch ung keit", "de"), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd], "doc_id long, text string, lang string, lang_pred string")
    got = language_id.language_id(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) for r in got)
    test = [r for r in rows if held(r[0], 4, 2)]
    assert len(test) > 30 and sum(by[r[0]]["lang_pred"] == r[2] for r in test) >= 0.97 * len(test)
    one = spark.createDataFrame([(i, "abc", "xx") for i in range(8)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language_id.language_id(one).collect()} == {("xx", 1.0)}
    nothing = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.language_id(nothing).collect()[0]["lang_pred"] == "und"
    assert language_id.language_id(df.limit(0)).count() == 0


def test_svm_separates():
    rng = np.random.default_rng(0)
    rows, y = [], np.repeat([1.0, -1.0], 40)
    for label in y:
        at = np.unique(rng.integers(0, 30, 8) + (0 if label > 0 else 20)).astype(np.int32)
        rows.append((at, np.ones(len(at), np.float32)))
    w = language_id.train_svm(rows, y, 6)
    assert np.mean([np.sign(w[i] @ v + w[-1]) == t for (i, v), t in zip(rows, y)]) > 0.95


def test_toxicity(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, labels = [], []
    for i in range(900):
        w, bad = [word() for _ in range(rng.randint(5, 60))], i % 5 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randint(0, len(w)), rng.choice(["nasty", "Vile.", "rotten"]))
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, int(bad), 1))
    rows += [(2000, None), (2001, ""), (2002, "nasty " * 3000), (7, rows[7][1]), (None, "vile")]
    labels += [(7, None, 1), (99999, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*r, 9.0, "p") for r in rows], "doc_id long, text string, score double, predicted string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) for r in got)
    test = [i for i in range(900) if held(i, 5, 0)]
    assert sum(by[i]["predicted"] == int(i % 5 == 0) for i in test) >= 0.95 * len(test)
    assert by[2000]["predicted"] == by[2001]["predicted"] == 0 and by[2002]["predicted"] == 1
    again = toxicity.toxicity(df.repartition(5), lab).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    one_kind = toxicity.toxicity(df, lab.filter("toxic = 0")).collect()
    assert all(r["predicted"] == 0 for r in one_kind)
    assert all(r["predicted"] == 0 for r in toxicity.toxicity(df, lab.limit(0)).collect())
    assert toxicity.toxicity(df.limit(0), lab).count() == 0


def test_ftrl_matches_the_plain_rule():
    """The vectorised update against one coordinate at a time."""
    rng = random.Random(3)
    rows = [np.array(sorted(rng.sample(range(1, 40), 6)), np.int32) for _ in range(60)]
    labels = np.array([float(3 in r) for r in rows])
    z, n = Counter(), Counter()
    alpha, beta, l1, l2 = 0.5, 1.0, 0.2, 0.1

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for x, y in zip(rows, labels):
        at = [0, *x.tolist()]
        g = 1 / (1 + math.exp(-sum(weight(i) for i in at))) - y
        for i in at:
            w, sigma = weight(i), (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    got = toxicity.weights(*toxicity.ftrl(rows, labels, 6, 1, alpha, beta, l1, l2), alpha, beta, l1, l2)
    assert np.allclose(got, [weight(i) for i in range(64)])


def test_toxicity_ignores_held_out_labels(spark):
    df = spark.createDataFrame([(i, f"word{i % 7} other{i % 5}") for i in range(200)], "doc_id long, text string")
    lab = lambda flip: spark.createDataFrame([(i, (int(i % 7 == 0) ^ (flip and held(i, 5, 0)))) for i in range(200)], "doc_id long, toxic int")
    scores = lambda labels: sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(df, labels).collect())
    want = scores(lab(False))
    assert scores(lab(True)) == want
    only = spark.createDataFrame([(i, 1) for i in range(200) if held(i, 5, 0)], "doc_id long, toxic int")
    assert {s for _, s in scores(only)} == {s for _, s in scores(only.limit(0))}


def plain_features(text, bits=20):
    """Coordinates as sets, by text spans instead of arrays."""
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [int(toxicity.SpanHash(np.frombuffer(x.encode(), np.uint8)).of(np.array([0]), np.array([len(x.encode())]))[0]) for x in w]
    out = {x >> (64 - bits) for x in h}
    for gap in (1, 2):
        for a, b in zip(h, h[gap:]):
            out.add(int(toxicity.mix(np.array([(a * (2 * gap + 1) + b) % 2**64], np.uint64))[0]) >> (64 - bits))
    return {max(1, x) for x in out}


def test_toxicity_end_to_end_matches_the_plain_rule(spark):
    """Parts, pooling and scores against dictionaries; the order and the parts are taken from Spark's own hashes."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab cd ef gh ij kl mn op vile".split()) for _ in range(rng.randint(0, 12))) + ("!é" if i % 3 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    label = {i: int("vile" in t) for i, t in rows}
    lab = spark.createDataFrame(list(label.items()), "doc_id long, toxic int")
    at, weight = toxicity.fit(df, lab, F.col("doc_id") >= 100, part_rows=100)
    keyed = df.filter("doc_id >= 100").select("doc_id", "text", F.pmod(F.xxhash64(F.lit(88), "doc_id", "text"), F.lit(3)).alias("p"), F.xxhash64(F.lit(8), "doc_id", "text").alias("o")).collect()
    z_all, n_all, w_all, seen = Counter(), Counter(), Counter(), Counter()
    for p in range(3):
        part = sorted((r for r in keyed if r["p"] == p), key=lambda r: r["o"])
        z, n = Counter(), Counter()
        step = lambda z, n: 0.0 if abs(z) <= toxicity.L1 else -(z - math.copysign(toxicity.L1, z)) / ((toxicity.BETA + math.sqrt(n)) / toxicity.ALPHA + toxicity.L2)
        for _ in range(toxicity.EPOCHS):
            for r in part:
                x = {0} | plain_features(r["text"])
                g = 1 / (1 + math.exp(-sum(step(z[i], n[i]) for i in x))) - label[r["doc_id"]]
                for i in x:
                    w = step(z[i], n[i])
                    z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w
                    n[i] += g * g
        for i in n:
            z_all[i] += z[i]
            n_all[i] += n[i]
            w_all[i] += step(z[i], n[i]) * len(part)
            seen[i] += len(part)
    want = {i: w_all[i] / seen[i] or step(z_all[i], n_all[i]) for i in n_all}
    want = {i: w for i, w in want.items() if w}
    assert sorted(want) == at.tolist() and np.allclose([want[i] for i in at.tolist()], weight)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, (at, weight)).collect()}
    for i, t in rows:
        assert abs(got[i] - 1 / (1 + math.exp(-sum(want.get(x, 0) for x in {0} | plain_features(t))))) < 1e-9


def test_toxicity_ranks_held_out_rows_after_many_parts(spark):
    """Sums of 8 parts' gradients pass the threshold by chance; marks are stems under endings of which most are seen once."""
    rng = random.Random(11)
    common = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(5000):
        w, bad = [rng.choice(common) for _ in range(rng.randint(20, 120))], i % 10 == 0
        for _ in range(rng.randint(2, 4) if bad else 0):
            w.insert(rng.randint(0, len(w)), rng.choice(["zorku", "chón"]) + "".join(rng.choice("ijklmn") for _ in range(6)))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), part_rows=500).collect()
    ones, zeros = ([r["score"] for r in got if r["held_out"] and (r["doc_id"] % 10 == 0) == k] for k in (True, False))
    assert np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros]) > 0.99
    assert np.mean([s >= 0.5 for s in ones]) > 0.95 and np.mean([s < 0.5 for s in zeros]) > 0.99


def brute_counts(docs):
    tokens = [[re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")] + [None] for d in docs]
    c = Counter()
    for d, t in zip(docs, tokens):
        if not held(d[0], 5, 1):
            c.update(t)
    n, v = sum(c.values()), len(c)
    return [(d[0], held(d[0], 5, 1), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for d, t in zip(docs, tokens)]


def test_language_model(spark, monkeypatch):
    df, docs = frame(spark), documents()
    want = Counter(brute_counts(docs))
    seen = []
    for block in (6 << 20, 3000):
        monkeypatch.setattr(pitman_yor, "BLOCK", block)
        rows = pitman_yor.language_model(df).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
        assert all(r["score"] < 0 for r in rows)
        seen.append(sum(r["score"] for r in rows))
    assert abs(seen[0] - seen[1]) < 0.02 * abs(seen[0])
    assert pitman_yor.language_model(df.limit(0)).count() == 0
    only_held = next(i for i in range(100) if held(i, 5, 1))
    alone = pitman_yor.language_model(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).collect()[0]
    assert (alone["n_known"], alone["train_tokens"]) == (0, 0) and math.isfinite(alone["score"])


def brute_scores(docs):
    """log10 of the model's probability of each text with the least seating: one table a cell on every level."""
    tokens = [[re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")] + [None] for d in docs]
    contexts = [[(("start" if i < 2 else (t[i - 2],)), ("start" if i < 1 else (t[i - 1],))) for i in range(len(t))] for t in tokens]
    c = [Counter(), Counter(), Counter()]
    for d, t, x in zip(docs, tokens, contexts):
        if not held(d[0], 5, 1):
            c[0].update(zip(x, t))
    c[1].update((x[1], w) for x, w in c[0])
    c[2].update((None, w) for _, w in c[1])
    rooms = [Counter(), Counter(), Counter()]  # customers and tables of each restaurant
    tables = [Counter(), Counter(), Counter()]
    for level in range(3):
        for (x, _), n in c[level].items():
            rooms[level][x] += n
            tables[level][x] += 1
    many = lambda level, k: sum(n == k for n in c[level].values())
    d = [min(0.95, max(0.05, many(k, 1) / max(1, many(k, 1) + 2 * many(k, 2)))) for k in range(3)]
    p = lambda level, x, w, below: (max(c[level][x, w] - d[level] * (c[level][x, w] > 0), 0) + (1 + d[level] * tables[level][x]) * below) / (1 + rooms[level][x])
    word = lambda x, w: p(0, x, w, p(1, x[1], w, p(2, None, w, 1 / (len(c[2]) + 1))))
    return [sum(math.log10(word(x, w)) for x, w in zip(xs, t)) for xs, t in zip(contexts, tokens)]


def test_scores_match_brute_force(spark):
    df, docs = frame(spark), documents()
    got = pitman_yor.score_corpus(df, pitman_yor.fold("doc_id", 5) == 1, sweeps=0).collect()
    want = sorted(zip([(-1 if d[0] is None else d[0]) for d in docs], brute_scores(docs)))
    for (i, s), (j, w) in zip(sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["score"]) for r in got), want):
        assert i == j and abs(s - w) < 1e-4 * max(1, abs(w))


def test_scores_do_not_depend_on_the_cluster(spark, monkeypatch):
    """Other partitions, blocks and shuffles: the same draws."""
    monkeypatch.setattr(pitman_yor, "RANGE", 8000)  # several ranges and slices of the root
    df = frame(spark)
    one = sorted((str(r["doc_id"]), r["score"]) for r in pitman_yor.language_model(df.coalesce(1)).collect())
    monkeypatch.setattr(pitman_yor, "BLOCK", 5000)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    two = sorted((str(r["doc_id"]), r["score"]) for r in pitman_yor.language_model(df.repartition(5)).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [i for i, _ in one] == [i for i, _ in two] and max(abs(a - b) for (_, a), (_, b) in zip(one, two)) < 1e-3


def test_model_beats_the_base_on_held_out_text(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    weight = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(x for w in rng.choices(vocabulary, weight, k=60) for x in ((w, "after" + w[1:2]) if rng.random() < 0.5 else (w,)))) for i in range(300)]
    got = [r for r in pitman_yor.language_model(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_probabilities_sum_to_one():
    """Over all words of the vocabulary and the unknown slot, in every context."""
    rng = np.random.default_rng(5)
    words_, contexts = 30, pitman_yor.PARENTS * pitman_yor.LEAVES
    of, context = (x.ravel() for x in np.meshgrid(np.arange(words_), np.arange(contexts), indexing="ij"))
    seen = rng.poisson(0.3, len(of)).astype(np.uint32)
    names = np.arange(words_, dtype=np.uint64)
    state = pitman_yor.sample_words(names, of, context.astype(np.int64), seen, None, 0)
    totals = pitman_yor.Totals([np.bincount(context, state[0], minlength=contexts), np.bincount(state[7], state[2], minlength=pitman_yor.PARENTS), np.array([state[4].sum()])], [np.bincount(context, state[1], minlength=contexts), np.bincount(state[7], state[3], minlength=pitman_yor.PARENTS), np.array([state[5].sum()])], (0.5, 0.6, 0.7), int((state[4] > 0).sum()))
    p = pitman_yor.predictive(state, context, totals).reshape(words_, contexts).sum(0)
    unknown = totals.mass(2)[0] / (totals.n_words + 1) * totals.mass(1)[np.arange(contexts) // pitman_yor.LEAVES] * totals.mass(0)
    # words never seen have the unknown slot's probability each, of which only one counts
    never = words_ - totals.n_words
    assert np.allclose(p - never * unknown + unknown, 1, atol=1e-9)


def test_seating():
    rng = np.random.default_rng(6)
    t = pitman_yor.seat(rng, np.array([0, 1, 2, 50, 100_000]), np.full(5, 0.1), np.full(5, 10), 0.5, 1.0)
    assert t[0] == 0 and t[1] == 1 and 1 <= t[2] <= 2 and all(t <= [0, 1, 2, 50, 100_000]) and t[4] > t[3] >= 1
    # one customer at a time, the chain of a single cell has a known mean
    many = pitman_yor.seat(np.random.default_rng(7), np.full(20_000, 3), np.full(20_000, 0.2), np.full(20_000, 4), 0.5, 1.0)
    p2 = (1 + 0.5 * 5) * 0.2 / ((1 + 0.5 * 5) * 0.2 + 1 - 0.5)
    stay = lambda t, i: (1 + 0.5 * (4 + t)) * 0.2 / ((1 + 0.5 * (4 + t)) * 0.2 + i - 0.5 * t)
    mean = 1 + p2 + p2 * stay(2, 2) + (1 - p2) * stay(1, 2)
    assert many.mean() == pytest.approx(mean, abs=0.02)


def test_words_of_odd_texts():
    word, before, count = pitman_yor.tokens(pa.array(["Ab  ab\n", None, "", "\t", "é"]))
    assert count.tolist() == [3, 1, 1, 1, 2] and word[0] == word[1] and word[2] == word[3] == pitman_yor.END and before[0] == before[3] == 0


def test_contexts_are_the_two_words_before(spark):
    """Words before that end alike are told apart, and so are the words before those."""
    train = [i for i in range(600) if not held(i, 5, 1)]
    asked = [i for i in range(600) if held(i, 5, 1)][:4]
    kinds = ["1same last one", "2same last two", "a first1same three", "a first2same four"]
    rows = [(i, kinds[k % 4]) for k, i in enumerate(train)]
    rows += list(zip(asked, ["1same last one", "1same last two", "a first1same three", "a first1same four"]))
    got = {r["doc_id"]: r["score"] for r in pitman_yor.language_model(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[asked[0]] > got[asked[1]] + 1 and got[asked[2]] > got[asked[3]] + 1


def test_probabilities_sum_to_one_after_a_sweep():
    """With contexts of their own parents, by the sweep's own tables and totals."""
    rng = np.random.default_rng(8)
    words_, above = 40, rng.integers(0, 9, 50)
    above = np.unique(above, return_inverse=True)[1]
    of, context = (x.ravel() for x in np.meshgrid(np.arange(words_), np.arange(50), indexing="ij"))
    seen = rng.poisson(1.5, len(of)).astype(np.uint32)
    names = np.arange(words_, dtype=np.uint64)
    state = pitman_yor.sample_words(names, of, context, seen, None, 0, above)
    for sweep in (1, 2):
        root = (int(state[4].sum()), int(state[5].sum()))
        totals = pitman_yor.totals_of(state, context, root, (0.5, 0.6, 0.7), int((state[4] > 0).sum()))
        state = pitman_yor.sample_words(names, of, context, seen, totals, sweep, above, (state[1], state[3], state[4], state[5]))
        c2 = np.bincount(state[6], state[3], minlength=words_).astype(int)
        state = (*state[:4], c2, np.minimum(c2, 2), *state[6:])
    own = pitman_yor.totals_of(state, context, (c2.sum(), np.minimum(c2, 2).sum()), (0.5, 0.6, 0.7), words_)
    p = pitman_yor.predictive(state, context, own).reshape(words_, 50).sum(0)
    assert all(c2 > 0) and np.allclose(p + own.mass(2)[0] / (words_ + 1) * own.mass(1)[above] * own.mass(0), 1, atol=1e-9)
    assert (state[1] <= seen).all() and (state[1][seen > 0] >= 1).all()


def peak_of(run):
    """What run gives, and the most bytes it held at once beyond those before it."""
    tracemalloc.start()
    try:
        got = run()
        return got, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_range_with_a_frequent_word():
    """One word is before most others: its range is larger than the rest, so a cell may take few bytes on the way."""
    rng = np.random.default_rng(9)
    words_, n, pieces = 40_000, 200_000, []
    names = np.arange(words_, dtype=np.uint64)
    for block in range(3):
        one = np.where(np.arange(n) < n // 20, rng.integers(1, 500, n), 0)
        cells = np.unique(np.stack([one, rng.integers(0, words_, n), rng.integers(0, words_, n)]), axis=1).astype(np.uint32)
        x = (names, *cells, rng.choice([0, 1, 1, 1, 1, 1, 1, 1, 2, 5], cells.shape[1]).astype(np.uint32))
        pieces.append((block, 0, pitman_yor._size(x), pitman_yor._arrays(*x)))
    asked = pd.DataFrame(pieces, columns=["block", "range", "size", "payload"])
    cells = 3 * n
    merged, peak = peak_of(lambda: pitman_yor._merge(1)(asked))
    assert peak < 90 * cells
    row, totals, got = merged.to_dict("records")[0], None, []
    for sweep in range(3):
        batch = pa.RecordBatch.from_pylist([row | {"got": got}])
        sent, peak = peak_of(lambda: [r for b in pitman_yor._sweep(1, sweep, totals)(iter([batch])) for r in b.to_pylist()])
        assert peak < 80 * cells
        root = pitman_yor._root(sweep, totals)(pd.DataFrame([r for r in sent if r["slice"] >= 0])).to_dict("records")
        top = next(pitman_yor._unpack(r["payload"], r["size"], np.int64)[0] for r in root if r["slice"] == pitman_yor._STATS)
        totals = pitman_yor.Totals([None, None, np.array([top[2]])], [None, None, np.array([top[3]])], (0.5, 0.6, 0.7), words_)
        got = [r for r in sent if r["slice"] == pitman_yor._STATE] + [r for r in root if r["range"] >= 0]
    batch = pa.RecordBatch.from_pylist([row | {"got": got}])
    answers, peak = peak_of(lambda: [r for b in pitman_yor._answer([(2, totals)])(iter([batch])) for r in b.to_pylist()])
    assert peak < 65 * cells
    logs = [pitman_yor._unpack(a["payload"], a["size"], np.float32)[0] for a in answers]
    assert [a["block"] for a in answers] == [0, 1, 2] and all(np.isfinite(x).all() and (x < 0).all() for x in logs) and sum(map(len, logs)) > 0.99 * cells


def test_groups_of_many_words():
    """Columns too wide for one 64-bit key are grouped as narrow ones are."""
    rng = np.random.default_rng(10)
    columns = tuple(rng.integers(0, 7, 3000).astype(np.uint32) for _ in range(3))
    narrow, wide = (pitman_yor._groups(columns, (n, n, n)) for n in (7, 1 << 30))
    for order, new in (narrow, wide):
        rows = list(zip(*(c[order].tolist() for c in columns)))
        assert rows == sorted(rows) and new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(len(rows))]


def test_sums_by_parts(monkeypatch):
    monkeypatch.setattr(pitman_yor, "CELLS", 8)
    rng = np.random.default_rng(11)
    for of in (rng.integers(0, 40, 1000), np.sort(rng.integers(3, 40, 1000)).astype(np.uint32), np.zeros(0, np.uint32)):
        what = rng.integers(0, 9, len(of)).astype(np.uint32)
        assert pitman_yor._sums(of, what, 50).tolist() == np.bincount(of, what, 50).astype(int).tolist()
