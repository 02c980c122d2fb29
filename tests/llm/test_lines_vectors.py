"""Line dedup, whitening and hard negatives against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from cogspark.llm import hard_negatives as H
from cogspark.llm import line_dedup as L
from cogspark.llm import whitening as Wh

from .fixtures import documents, frame

SPACE = " \t\n\x0b\x0c\r"


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute_lines(rows, least_chars=40, least=5):
    """[(doc_id, n_lines, n_dropped, kept)] of (doc_id, text) rows."""
    low = -(1 << 63)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= least_chars:
                held[line_key(line)].add(low if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(held.get(line_key(x), ())) < least or max(held[line_key(x)]) == (low if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def line_rows(seed=3, n=120):
    rng = random.Random(seed)
    common = ["The one line that nearly all of the documents hold: %d." % k for k in range(3)] + ["ÄÖÜ " * 12, "日本語" * 14, "x" * 39, "y" * 40]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 90)):
            pick = rng.random()
            line = rng.choice(common) if pick < 0.4 else f"a line of its own, long enough to be looked at {i} {rng.random()}" if pick < 0.7 else rng.choice(["", "  ", "short", "\t"])
            lines.append(rng.choice(["", " ", "\t\r"]) + (line.upper() if rng.random() < 0.2 else line) + rng.choice(["", "  ", "\x0b"]))
        rows.append((i, "\n".join(lines)))
    few = "a line that is held by four documents and no others, so it stays"
    rows += [(500 + k, few) for k in range(4)] + [(600, f"{few}s\n" * 3)] + [(601 + k, f"{few}s") for k in range(4)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (700, None), (701, ""), (702, "\n\n"), (None, common[0] + "\n" + few), (None, common[0]), (703, (common[0] + "\n") * 3000 + "end")]
    return rows


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("hot", [False, True])
def test_line_digest(spark, monkeypatch, hot):
    monkeypatch.setattr(L, "SAMPLED", 1 << 40)
    if hot:  # every line that a sample of all lines has eight times is cut into ways
        monkeypatch.setattr(L, "SAMPLE", 1)
        monkeypatch.setattr(L, "SAMPLED", 8)
        monkeypatch.setattr(L, "parts_for", lambda *a: 40)
    rows = line_rows()
    keyed = L._keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert (L.hot_keys(L.long_lines(keyed, 40))[0].count() > 0) == hot
    df = frame(spark, [(i, t, "en", "s", 1, 0.5, "x", 1, 2, 3, 4, "l", 5, 0.25, "r") for i, t in rows]).withColumnsRenamed({"set": "pos", "block": "h1", "id": "doc", "__id": "words"}).repartition(7)
    want = [(i, n, k, hashlib.sha256(x.encode()).hexdigest()) for i, n, k, x in brute_lines(rows)]
    assert as_rows(L.line_digest(df)) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    out = L.remove_lines(df)
    assert out.columns == df.columns
    texts = [(i, None if t is None else x) for (i, t), (_, _, _, x) in zip(rows, brute_lines(rows))]
    assert as_rows(out.select("doc_id", "text")) == sorted(texts, key=lambda r: tuple((x is not None, x) for x in r))
    assert out.select("tie", "row", "pos").distinct().count() == 1


def test_line_bitmaps(spark):
    rows = [(i, "\n".join(["own %d" % i] * 130 + ["a line that is long enough and is held by six documents"])) for i in range(6)]
    found = L.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_dropped, r.words, [x & (1 << 64) - 1 for x in r.keeps]) for r in found] == [(i, 1, [2], [(1 << 64) - 1 - 4]) for i in range(5)]


def test_line_digest_of_fixture_and_empty(spark):
    rows = [(r[0], r[1]) for r in documents()]
    want = [(i, n, k, hashlib.sha256(x.encode()).hexdigest()) for i, n, k, x in brute_lines(rows)]
    assert as_rows(L.line_digest(frame(spark))) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert L.line_digest(frame(spark, [])).count() == 0


def vectors(spark, rows, columns="vec_id long, embedding array<float>, label int, v string, k int, n long"):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], columns)


AWKWARD = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 8, 2), (903, [float("inf")] * 8, 2)]


def dense(x, k=4):
    """(eigenvalues, components, trace) of the different rows of x."""
    u = np.unique(x, axis=0)
    c = u - u.mean(0)
    e, q = np.linalg.eigh(c.T @ c / len(u))
    return u, e[::-1][:k], q[:, ::-1][:, :k], e.sum()


def check_whitening(spark, rows, k=4):
    out = Wh.whitening(vectors(spark, rows)).toPandas()
    good = [(i, v) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max(len(v) for _, v in good)
    x = np.array([np.floor(256 * np.float32(v + [0.0] * (d - len(v))).astype(float)) for _, v in good])
    u, e, q, trace = dense(x, k)
    n, sums = len(u), u.sum(0)
    assert len(out) == len(good) * k and (out.n == n).all() and (out.identity_error < 1e-9).all()
    assert sorted(out[out.component == 1].deviation) == sorted(int(((n * r - sums) ** 2).sum()) for r in x)
    for c in range(1, k + 1):
        part = out[out.component == c]
        assert np.allclose(part.explained, e[c - 1] / trace, rtol=1e-9)
        if all(abs(e[c - 1] - o) > 1e-6 * e[0] for j, o in enumerate(e) if j != c - 1):
            y = (x - sums / n) @ q[:, c - 1] / np.sqrt(e[c - 1])
            got = np.array(sorted(part.whitened))
            assert min(np.abs(got - np.sort(y)).max(), np.abs(got - np.sort(-y)).max()) < 1e-9
    return out


def test_whitening_against_dense_solution(spark):
    rng = np.random.default_rng(5)
    basis = rng.standard_normal((8, 8)) * np.array([4, 3, 2.5, 2, 1, 0.5, 0.2, 0.1])
    rows = [(i, [float(c) for c in rng.standard_normal(8) @ basis.T], i % 3) for i in range(300)]
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (0, rows[0][1], 0), (None, rows[7][1], 1), (402, rows[5][1][:3], 1), *AWKWARD]
    check_whitening(spark, rows)


def test_whitening_of_equal_deviations_and_low_rank(spark):
    corners = [[float(a), float(b), float(c), 0.0] for a in (0, 1) for b in (0, 1) for c in (0, 1)]  # three equal deviations
    out = check_whitening(spark, [(i, v, 0) for i, v in enumerate(corners)], k=3)
    assert np.allclose(out.explained, 1 / 3)
    assert set(Wh.whitening(vectors(spark, [(i, [float(i), 2.0 * i, 0.0], 0) for i in range(9)])).toPandas().component) == {1}
    for rows in ([], AWKWARD, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, [], 0)]):
        assert Wh.whitening(vectors(spark, rows)).count() == 0


def test_whitening_of_wide_scales(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.standard_normal(5) * [1e6, 1e3, 1, 1, 1]], 0) for i in range(40)]
    out = Wh.whitening(vectors(spark, rows)).toPandas()
    assert (out.identity_error < 1e-4).all() and (out[out.component == 1].deviation > 0).all()


def brute_negatives(rows, scale=256, positives=5, k=5):
    good = [(i, lab, tuple(int(np.floor(scale * float(np.float32(c)))) for c in v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors = {}
    for i, lab, v in good:
        if i % 10 == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        every = [(max(-(2**63) + 1, min(2**63 - 1, dot(v, w))), i, other) for i, other, w in good if i != a]
        for s, i, _ in sorted((x for x in every if x[2] == lab), key=lambda x: (-x[0], x[1]))[:positives]:
            inside = sorted((x for x in every if x[2] != lab and 80 * s <= 100 * x[0] <= 100 * s), key=lambda x: (-x[0], x[1]))[:k]
            out += [(a, i, r, j, s, t) for r, (t, j, _) in enumerate(inside, 1)]
    return sorted(out)


def clustered(seed=8, n=700, d=8, clusters=9):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((clusters, d)) * 3
    return [(i, [float(c) for c in np.round(middle[i % clusters] + rng.standard_normal(d) * 0.3, 1)], int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("leaf_rows", [20, 100_000])
def test_hard_negatives(spark, monkeypatch, leaf_rows):
    monkeypatch.setattr(H, "CHUNK_ROWS", 64)
    rows = clustered()
    rows += [(2000 + i, rows[4][1], i % 2) for i in range(150)]  # a hot vector, ties
    rows += [(10, rows[10][1], rows[10][2]), (20, rows[33][1], 3), (None, rows[1][1], 1), (3000, rows[1][1], None), (3010, rows[2][1][:3], 2), *AWKWARD]
    df = vectors(spark, rows).repartition(5)
    got = H.hard_negatives(df, df.vec_id % 10 == 0, leaf_rows=leaf_rows)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_hard_negatives_of_few_and_large(spark):
    df = vectors(spark, [])
    assert H.hard_negatives(df, df.vec_id % 10 == 0).count() == 0
    rows = [(10 * i, [3e7 * (i + 1), 1.0 * i], i % 2) for i in range(6)] + [(7, [1e18, -1e18], 0), (11, [1e18, 1.0], 1), (12, [1e18, 1.0], 0)]
    df = vectors(spark, rows)
    assert sorted(map(tuple, H.hard_negatives(df, df.vec_id % 10 == 0).collect())) == brute_negatives(rows)


def test_tree_eliminates_only_what_no_window_needs():
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.standard_normal((40, 6))[rng.integers(0, 40, 4000)] * 3 + rng.standard_normal((4000, 6)) * 0.1))
    tree = H.Tree(x[:800], 60, 8)
    leaf = tree.leaf_of(x)
    tree.widen(tree.ranges, x, leaf)
    a = x[rng.integers(0, 4000, 50)]
    s = a @ x.T
    best = np.sort(s, 1)[:, -20]
    low, high = np.stack([best, best * 0.9], 1), np.stack([np.full(50, np.inf), best * 0.95], 1)
    alive = tree.alive(a, low, high)
    for i in range(50):
        for w in range(2):
            need = (s[i] >= low[i, w]) & (s[i] <= high[i, w])
            assert alive[i][leaf[need]].all()
    assert tree.n_leaves > 20 and alive.mean() < 0.6
