"""Language identification in two steps: the family first, then the language within it.

A text's features are the relative frequencies of its byte 3-grams and 2-grams (A-Z lower-cased, ASCII digits and
punctuation taken for white space), hashed to 2^BITS coordinates; each is divided by the square root of its root mean
square over the training sample, so that frequent n-grams do not drown the others. One linear support vector machine
for each pair of families votes for the family; one for each pair of languages of that family votes for the language.
The machines are trained by dual coordinate descent on a sample of at most SAMPLE different texts a language, taken by a
hash of id and text among all that may be learned from, whole texts being used; a model is a table of 2^BITS by the
number of pairs.

Languages outside FAMILIES are families of their own.

Defined cases: texts that are null or without letters are `und` with score 0; without anything to learn from every
text with letters is `und` too; one learned language is given to every text with letters, with score 1; ties between
votes go to the larger sum of margins, then to the smaller name; repeated rows are judged alike; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks, fold, free_name, mix, text_bytes, tidy

#: Families of common languages by their codes.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
    "sinitic": "yue zh",
}
BITS, BLOCK, SAMPLE = 14, 1 << 20, 1500
C, ROUNDS = 10.0, 12
UND = "und"


def family_of(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang in v.split()), lang)


def coordinates(texts: pa.Array | pa.ChunkedArray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates of all n-grams of texts that lie one after another, and where each text's begin."""
    body, offsets = text_bytes(texts)
    letter = (body >= 128) | ((body >= 97) & (body <= 122))
    upper = (body >= 65) & (body <= 90)
    x = np.where(letter, body, np.where(upper, body + 32, 32)).astype(np.uint32)
    size = np.diff(offsets)
    # each text between two spaces, n-grams of one space more do not tell anything
    at = np.full(len(x) + 2 * len(size), 32, np.uint32)
    at[np.arange(len(x)) + np.repeat(2 * np.arange(len(size)) + 1, size)] = x
    three = ((at[:-2] << np.uint32(16)) | (at[1:-1] << np.uint32(8)) | at[2:]).astype(np.uint64)
    two = ((at[:-2] << np.uint32(8)) | at[1:-1]).astype(np.uint64) | np.uint64(1 << 24)
    shift = np.uint64(64 - bits)
    starts = offsets + 2 * np.arange(len(offsets))
    return np.stack([(mix(three) >> shift).astype(np.int32), (mix(two) >> shift).astype(np.int32)]), starts


def _frequencies(texts: pa.Array, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coordinates, relative frequencies) of each text."""
    x, starts = coordinates(texts, bits)
    out = []
    for lo, hi in zip(starts[:-1], starts[1:]):
        at, count = np.unique(x[:, lo : max(lo, hi - 2)], return_counts=True)
        out.append((at.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)))
    return out


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int, c: float = C, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (the last one is the bias) of a linear machine with squared hinge loss, y of -1 and 1."""
    w, a = np.zeros((1 << bits) + 1), np.zeros(len(rows))
    full = [(np.r_[i, 1 << bits], np.r_[v, 1.0]) for i, v in rows]
    norm = np.array([float(v @ v) for _, v in full]) + 1 / (2 * c)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for k in order.permutation(len(rows)):
            i, v = full[k]
            g = y[k] * float(w[i] @ v) - 1 + a[k] / (2 * c)
            new = max(0.0, a[k] - g / norm[k])
            if new != a[k]:
                w[i] += (new - a[k]) * y[k] * v
                a[k] = new
    return w


def _sample_rows(bits: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "text", BLOCK):
            got = _frequencies(table.column("text"), bits)
            yield pa.RecordBatch.from_arrays([table.column("lang").combine_chunks(), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], ["lang", "at", "value"])

    return run


class Model:
    """Pairs of classes and their weights: families, and the languages of each family."""

    def __init__(self, bits: int = BITS):
        self.bits, self.groups, self.pairs, self.table = bits, [], [], np.zeros(((1 << bits) + 1, 0), np.float32)

    def learn(self, langs: list[str], rows: list) -> None:
        families = sorted({family_of(x) for x in langs})
        square = np.zeros(1 << self.bits)
        for i, v in rows:
            square[i] += v.astype(np.float64) ** 2
        scale = np.where(square > 0, 1 / np.sqrt(square / max(1, len(rows)) + 1e-12), 0.0) ** 0.5
        rows = [(i, v * scale[i]) for i, v in rows]
        norm = [np.sqrt(float(v @ v)) or 1.0 for _, v in rows]
        unit = float(np.mean(norm)) if norm else 1.0
        rows = [(i, v / unit) for i, v in rows]
        columns = []
        self.groups = [families, *(sorted({x for x in langs if family_of(x) == f}) for f in families)]
        for g, names in enumerate(self.groups):
            label = [family_of(x) for x in langs] if g == 0 else langs
            for a, b in combinations(range(len(names)), 2):
                own = [k for k, x in enumerate(label) if x in (names[a], names[b])]
                w = train_svm([rows[k] for k in own], np.array([1.0 if label[k] == names[a] else -1.0 for k in own]), self.bits)
                self.pairs.append((g, a, b))
                columns.append(np.r_[w[:-1] * scale / unit, w[-1]])
        self.table = np.stack(columns, 1).astype(np.float32) if columns else self.table

    def margins(self, texts) -> np.ndarray:
        """(texts, pairs): bias and the mean weight of the n-grams."""
        x, starts = coordinates(texts, self.bits)
        n = len(starts) - 1
        out = np.zeros((n, len(self.pairs)))
        last = np.maximum(starts[:-1], starts[1:] - 2)
        for p in range(len(self.pairs)):
            w = np.ascontiguousarray(self.table[:-1, p])
            total = np.zeros(x.shape[1] + 1)
            np.cumsum(w[x[0]] + w[x[1]], dtype=np.float64, out=total[1:])
            out[:, p] = (total[last] - total[starts[:-1]]) / np.maximum(1, 2 * (last - starts[:-1])) + self.table[-1, p]
        return out

    def _vote(self, g: int, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = self.groups[g]
        votes, total = np.zeros((len(margin), len(names))), np.zeros((len(margin), len(names)))
        sure = np.ones((len(margin), len(names)))
        for p, (h, a, b) in enumerate(self.pairs):
            if h == g:
                m = margin[:, p]
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                total[:, a] += m
                total[:, b] -= m
                chance = 1 / (1 + np.exp(-np.clip(4 * m, -50, 50)))
                sure[:, a] = np.minimum(sure[:, a], chance)
                sure[:, b] = np.minimum(sure[:, b], 1 - chance)
        best = np.argmax(votes * 1e6 + total, 1) if len(names) > 1 else np.zeros(len(margin), int)
        return best, sure[np.arange(len(margin)), best]

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        """Language and score of each text, whether or not it has letters."""
        margin = self.margins(texts)
        family, sure = self._vote(0, margin)
        names, score = np.empty(len(margin), object), sure.copy()
        for f in range(len(self.groups[0])):
            own = np.flatnonzero(family == f)
            lang, of = self._vote(f + 1, margin[own])
            names[own] = [self.groups[f + 1][i] for i in lang]
            score[own] *= of
        return names.tolist(), score


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", per_language: int = SAMPLE, bits: int = BITS, id: str = "doc_id") -> Model:
    """docs: (id, text, lang). The sample is bounded by per_language times the languages, of which there are few."""
    from_ = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["n"] for r in from_.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(float(1.5 * per_language / n))) for k, n in counts.items()]) if counts else F.lit(0.0)
    draw = F.pmod(F.xxhash64(F.lit(3), "id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # copies of a text are drawn apart and then stand for one; of those drawn the first by hash, up to the bound
    drawn = from_.filter(draw < share).groupBy("lang", F.xxhash64(F.lit(4), "text").alias("h")).agg(F.first("text").alias("text"))
    first = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    drawn = drawn.withColumn("n", first).filter(F.col("n") <= per_language).select("text", "lang")
    got = drawn.mapInArrow(_sample_rows(bits), "lang string, at binary, value binary").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got.column("lang")[i].as_py(), got.column("at")[i].as_py(), got.column("value")[i].as_py()))
    got = got.take(pa.array(order, pa.int64()))
    model = Model(bits)
    if got.num_rows:
        model.learn(got.column("lang").to_pylist(), [(np.frombuffer(a.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32)) for a, v in zip(got.column("at"), got.column("value"))])
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds language and score; other columns stay."""
    names = [c for c in docs.columns if c not in (lang, score)]
    schema = docs.select(names).schema.add(lang, "string").add(score, "double")
    flag = free_name(docs, "letters")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, text, BLOCK):
            ok = np.array(table.column(flag).to_pylist(), bool)
            if model.groups:
                found, sure = model.predict(table.column(text))
            else:
                found, sure = [UND] * table.num_rows, np.zeros(table.num_rows)
            found, sure = [x if y else UND for x, y in zip(found, ok)], np.where(ok, np.clip(sure, 0, 1), 0.0)
            yield from pa.Table.from_arrays([*(table.column(c) for c in names), pa.chunked_array([pa.array(found, pa.string())]), pa.chunked_array([sure])], [*names, lang, score]).combine_chunks().to_batches()

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(flag)
    return docs.select(*names, letters).mapInArrow(run, schema)


def language_id(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", mod: int = 4, held: int = 2, per_language: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    narrow = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    is_held = F.coalesce(fold("doc_id", mod) == held, F.lit(False))
    model = fit(narrow, ~is_held, per_language=per_language)
    return identify(narrow.select("doc_id", "text"), model).select("doc_id", is_held.alias("held_out"), "lang_pred", "score")
