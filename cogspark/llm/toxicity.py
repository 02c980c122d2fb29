"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words of a text (A-Z lower-cased, ASCII punctuation taken for white space), pairs of neighbours,
pairs with one word between them, and the beginnings of longer words, so that a stem tells under endings that no
labelled text has; they are hashed to 2^BITS coordinates and counted once a text. Labelled rows are dealt over
parts of a bounded number of rows; each part is trained on its own, row by row, with a learning rate for each
coordinate and L1 regularisation. All labelled rows are used, and their evidence is pooled: a coordinate that some part
has learned gets the mean of the weights of the parts that saw it; for one whose gradients stay under the L1 threshold
in every part, the sums of all parts' gradients are put to the threshold once, so that rare words tell too. Sums of many
parts pass that threshold by chance as well, so they also have to be some multiple of their noise (the root of the summed
squares); the multiple is the one of OVER with the least log loss over all labelled rows. The weights are few enough to
go with the tasks that score (at most 2^BITS, in practice hundreds).

Defined cases: a null or empty text has the score of no features; only labels of documents that may be learned from are
looked at; without labelled rows of both kinds every score is the share of label 1 (0 without any); of several labels of
one document the highest counts, null labels none; repeated rows are dealt over the parts and scored alike; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, blocks, broadcast_if_small, fold, mix, text_bytes, tidy, words

BITS, BLOCK = 20, 1 << 20
#: Code points of the beginnings of words, and of the shortest words that give them.
STEMS, LEAST_WORD = (3, 4, 5, 6, 7), 5
ALPHA, BETA, L1, L2, EPOCHS = 3.0, 1.0, 4.0, 0.1, 2
#: Rows in a part of the training set, and coordinates that are handed on at once.
PART_ROWS, SENT = 16_000, 1 << 16
#: Multiples of their noise that pooled sums may have to exceed; the last one lets none through.
OVER = (4.0, 6.0, 8.0, 12.0, 16.0, 32.0, float("inf"))
BIAS = 0  # coordinate


def features(texts: pa.Array | pa.ChunkedArray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all features and the text of each; a feature that a text has twice comes twice."""
    body, offsets = text_bytes(texts)
    letter = (body >= 128) | ((body >= 48) & (body <= 57)) | ((body >= 65) & (body <= 90)) | ((body >= 97) & (body <= 122))
    body, start, end, of = words(np.where(letter, body, 32).astype(np.uint8), offsets)
    spans = SpanHash(body)
    word = spans.of(start, end)
    shift, found = np.uint64(64 - bits), [(word, of)]
    for gap in (1, 2):
        same = of[gap:] == of[:-gap]
        found.append((mix(word[:-gap] * np.uint64(2 * gap + 1) + word[gap:])[same], of[gap:][same]))
    point = np.flatnonzero((body & 0xC0) != 0x80)  # where code points start
    first, last = np.searchsorted(point, start), np.searchsorted(point, end)
    for n in STEMS:
        some = np.flatnonzero(last - first > max(n, LEAST_WORD - 1))
        found.append((mix(spans.of(start[some], point[first[some] + n]) + np.uint64(n)), of[some]))
    at = np.concatenate([(x >> shift).astype(np.int64) for x, _ in found])
    return np.maximum(at, 1), np.concatenate([x for _, x in found])


def _distinct(x: np.ndarray) -> np.ndarray:
    """What np.unique gives, by sorting, which is many times as fast for whole numbers."""
    x = np.sort(x)
    return x[np.diff(x, prepend=x[:1] - 1) != 0]


def weights(z, n, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
    """The proximal step: weights of sums of gradients z and of squared gradients n."""
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2) -> tuple[np.ndarray, np.ndarray]:
    """z and n after going through the rows (coordinates of each, each once) in their order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    for _ in range(epochs):
        for x, y in zip(rows, labels):
            x = np.r_[BIAS, x]
            zx, root = z[x], np.sqrt(n[x])
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + root) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            new = np.sqrt(n[x] + g * g)
            z[x] = zx + g - (new - root) / alpha * w
            n[x] += g * g
    return z, n


def _train(bits: int, epochs: int):
    """Parts to (at, w, seen, z, n) of each coordinate that a part saw: w is its weight by the part's rows, seen those rows."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, part = [], [], None

        def close():
            z, n = ftrl(rows, np.array(labels, float), bits, epochs)
            every, size = np.flatnonzero(n), float(len(rows))
            rows.clear()
            labels.clear()
            for lo in range(0, len(every), SENT):
                at = every[lo : lo + SENT]
                made = [pa.array(x) for x in (at, weights(z[at], n[at]) * size, np.full(len(at), size), z[at], n[at])]
                yield pa.RecordBatch.from_arrays(made, ["at", "w", "seen", "z", "n"])

        for table in blocks(batches, "text", BLOCK):
            at, of = features(table.column("text"), bits)
            pair = _distinct(of << bits | at)
            at, cut = (pair & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(pair >> bits, np.arange(table.num_rows + 1))
            for i, (label, p) in enumerate(zip(table.column("label").to_pylist(), table.column("part").to_pylist())):
                if part is not None and p != part:
                    yield from close()
                part = p
                rows.append(at[cut[i] : cut[i + 1]].copy())
                labels.append(label)
        if rows:
            yield from close()

    return run


def _losses(models: list[tuple[np.ndarray, np.ndarray]], bits: int):
    """Log loss of each model over labelled rows, in millionths: whole numbers add up alike in any order."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost, known = np.zeros(len(models), np.int64), np.zeros(1 << bits, bool)
        known[models[0][0]] = True
        for table in blocks(batches, "text", BLOCK):
            (x, of), label = features(table.column("text"), bits), table.column("label").to_numpy()
            some = known[x]  # the first model has all coordinates of the others
            found = x[some], of[some]
            for k, model in enumerate(models):
                total = _totals(*found, table.num_rows, *model, bits)
                lost[k] += np.rint(1e6 * np.logaddexp(0, np.where(label > 0, -total, total))).astype(np.int64).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int32()), pa.array(lost)], ["model", "lost"])

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", label: str = "toxic", bits: int = BITS, epochs: int = EPOCHS, part_rows: int = PART_ROWS, over: tuple[float, ...] = (0.0,)) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) learned from the labelled rows that `learn` (of id) marks.

    over: multiples of its noise that a pooled sum has to exceed, of which the one with the least loss is taken.
    """
    marks = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull()).filter(learn).groupBy(F.col(id).alias("__id")).agg(F.max(label).cast("int").alias("label"))
    rows = docs.filter(learn).select(F.col(id).alias("__id"), F.col(text).alias("text")).join(broadcast_if_small(marks), "__id")
    found, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not ones or ones == found:
        share = ones / found if found else 0.0
        return np.array([BIAS]), np.array([np.log(max(share, 1e-9) / max(1 - share, 1e-9))])
    parts = max(1, -(-found // part_rows))
    order = F.xxhash64(F.lit(8), "__id", "text")
    # salted by the partition a row comes from, so that repeated rows are spread
    part = F.pmod(F.xxhash64(F.lit(88), "__id", "text") + F.spark_partition_id(), F.lit(parts)).cast("int")
    dealt = rows.select("text", "label", part.alias("part"), order.alias("order")).repartitionById(parts, "part")
    made = dealt.sortWithinPartitions("part", "order").select("text", "label", "part").mapInArrow(_train(bits, epochs), "at long, w double, seen double, z double, n double")
    pooled = made.groupBy("at").agg((F.sum("w") / F.sum("seen")).alias("w"), F.sum("z").alias("z"), F.sum("n").alias("n"))
    step = -(F.col("z") - F.signum("z") * L1) / ((F.lit(BETA) + F.sqrt("n")) / ALPHA + L2)
    ratio = F.abs("z") / F.sqrt("n")
    learned = F.col("w") != 0
    kept = pooled.filter(learned | ((F.abs("z") > L1) & (ratio > min(over))))
    got = kept.select("at", F.when(learned, F.col("w")).otherwise(step).alias("w"), F.when(learned, float("inf")).otherwise(ratio).alias("ratio")).orderBy("at").toArrow()
    at, w, ratio = (got.column(c).to_numpy() for c in ("at", "w", "ratio"))
    models = [(at[held], w[held]) for held in (np.isinf(ratio) | (ratio > c) for c in sorted(over))]
    if len({len(m[0]) for m in models}) == 1:
        return models[0]
    lost = rows.select("text", "label").mapInArrow(_losses(models, bits), "model int, lost long").groupBy("model").agg(F.sum("lost").alias("lost"))
    # of equal ones the strictest
    return models[max(lost.collect(), key=lambda r: (-r["lost"], r["model"]))["model"]]


def _totals(x: np.ndarray, of: np.ndarray, n: int, at: np.ndarray, weight: np.ndarray, bits: int) -> np.ndarray:
    """Sum of the weights of each of n texts; x and of are their features."""
    table = np.zeros(1 << bits)
    table[at] = weight
    bias, table[BIAS] = table[BIAS], 0.0
    told = np.flatnonzero((table != 0)[x])
    pair = _distinct(of[told] << bits | x[told])
    return bias + np.bincount(pair >> bits, table[pair & ((1 << bits) - 1)], minlength=n)


def scores(texts: pa.Array | pa.ChunkedArray, at: np.ndarray, weight: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Probability of label 1 for each text."""
    total = _totals(*features(texts, bits), len(texts), at, weight, bits)
    return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", out: str = "score", bits: int = BITS) -> DataFrame:
    """Adds the score; all other columns stay."""
    names = [c for c in docs.columns if c != out]
    at, weight = model

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, text, BLOCK):
            s = scores(table.column(text), at, weight, bits)
            yield from pa.Table.from_arrays([*(table.column(c) for c in names), pa.chunked_array([s])], [*names, out]).combine_chunks().to_batches()

    return docs.mapInArrow(run, docs.select(names).schema.add(out, "double"))


def toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", mod: int = 5, held: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    narrow = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = fit(narrow, labels.select(F.col(id).cast("long").alias("doc_id"), F.col(label).alias("toxic")), fold("doc_id", mod) != held, part_rows=part_rows, over=OVER)
    out = score(narrow, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", mod) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
