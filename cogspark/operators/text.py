"""Text: filters and near-duplicates of sentences, features and a classifier, reader decisions, grounding of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.columns import let, flat, jaccard, token_set
from .shared import broadcast_if_small, written


def sentence_filter(df: DataFrame, banned: list[str], descriptions: DataFrame | None = None, limit: float = 0.8) -> DataFrame:
    """Adds drop_reason: short (under 3 words), long (over 60), banned, or copy (of its label's description); null to keep."""
    words = F.size(F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != ""))
    bad = F.lit(False)
    for b in banned:
        bad = bad | F.contains(F.lower("text"), F.lit(b))
    if descriptions is not None:
        df = df.join(broadcast_if_small(descriptions.select("label", "description")), "label", "left")
        copy = F.coalesce(jaccard(token_set(F.col("text")), token_set(F.col("description"))) >= limit, F.lit(False))
    else:
        copy = F.lit(False)
    out = df.withColumn("drop_reason", F.when(words < 3, "short").when(words > 60, "long").when(bad, "banned").when(copy, "copy"))
    return out.drop("description")


def _marks(tokens, words: int = 8) -> Column:
    """A set's tokens as bits of so many longs: two sets' marks differ in at most as many bits as the sets in tokens."""
    at = F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(64 * words)).cast("int"))
    one = lambda bits, i: F.aggregate(F.filter(bits, lambda x: F.floor(x / 64) == i), F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x % 64)))
    return let(at, lambda bits: F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: one(bits, i)))


def near_dups(df: DataFrame, by: str = "label", threshold: float = 0.85, order: str = "id") -> DataFrame:
    """Adds keep: a sentence goes if an earlier kept one of its label is at least so similar (Jaccard of token sets).

    Candidates meet on the rarest tokens of each sentence, as many as a similar one must share one of; what is compared
    is exact. Greedy decisions run within connected groups of similar sentences, which are small.
    """
    t = df.select(F.col(order).alias("id"), F.col(by).alias("by"), token_set(F.col("text")).alias("t")).filter(F.size("t") > 0)
    df_ = written(t.select("by", F.explode("t").alias("w")).groupBy("by", "w").agg(F.count(F.lit(1)).alias("n")), "vocabulary")
    # sentences are dealt once, whole: their tokens meet a vocabulary that is broadcast while it is small
    dealt = t.repartition("by", "id").select("id", "by", F.size("t").alias("m"), F.explode("t").alias("w"))
    each = dealt.join(broadcast_if_small(df_.hint("merge")), ["by", "w"])
    place = F.row_number().over(W.partitionBy("by", "id").orderBy("n", "w"))
    # sets with Jaccard >= s share one of each other's first m - ceil(s m) + 1 tokens in one global order
    prefix = each.withColumn("k", place).filter(F.col("k") <= F.col("m") - F.ceil(threshold * F.col("m")) + 1).select("by", "w", "id", "m")
    a, b = prefix.withColumnsRenamed({"id": "a", "m": "ma"}), prefix.withColumnsRenamed({"id": "b", "m": "mb"})
    pairs = a.join(b, ["by", "w"]).filter((F.col("a") < F.col("b")) & (F.least("ma", "mb") >= threshold * F.greatest("ma", "mb"))).select("by", "a", "b", "ma", "mb").distinct()
    # whole sets travel only for pairs whose marks differ in no more bits than sets with Jaccard >= s differ in tokens
    marks = written(t.select("id", _marks(F.col("t")).alias("s")), "marks")
    pairs = pairs.join(marks.withColumnsRenamed({"id": "a", "s": "sa"}).hint("merge"), "a").join(marks.withColumnsRenamed({"id": "b", "s": "sb"}).hint("merge"), "b")
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = pairs.filter(apart <= (F.col("ma") + F.col("mb")) * (1 - threshold) / (1 + threshold) + 1e-6).select("a", "b")
    s = t.select("id", "t")
    pairs = pairs.join(s.withColumnsRenamed({"id": "a", "t": "ta"}), "a").join(s.withColumnsRenamed({"id": "b", "t": "tb"}), "b").filter(jaccard(F.col("ta"), F.col("tb")) >= threshold).select("a", "b")
    left = written(pairs, "pairs")
    gone = None
    while not left.isEmpty():
        # sentences without an earlier similar one left are kept; those similar to them go
        later = left.select(F.col("b").alias("a")).distinct()
        kept = left.select("a").distinct().join(later, "a", "left_anti")
        out = written(left.join(kept, "a").select(F.col("b").alias("id")).distinct(), "gone")
        gone = out if gone is None else gone.unionByName(out)
        left = written(left.join(out.withColumnRenamed("id", "a"), "a", "left_anti").join(out.withColumnRenamed("id", "b"), "b", "left_anti").join(kept, "a", "left_anti"), "pairs")
    if gone is None:
        return df.withColumn("keep", F.lit(True))
    return df.join(gone.withColumn("__gone", F.lit(True)).withColumnRenamed("id", order), order, "left").withColumn("keep", F.col("__gone").isNull()).drop("__gone")


def split_by_context(df: DataFrame, context: str = "context_id") -> DataFrame:
    """Adds split from the number of the context: 1 to 4 train, 5 val, 6 test; null without one."""
    n = F.regexp_extract(context, r"(\d+)$", 1).try_cast("int")
    return df.withColumn("split", F.when(n.between(1, 4), "train").when(n == 5, "val").when(n == 6, "test"))


def drop_counts(df: DataFrame, by: str = "label") -> DataFrame:
    """(label, kept, short, long, banned, copy)."""
    return df.groupBy(by).agg(F.count_if(F.col("drop_reason").isNull()).alias("kept"), *[F.count_if(F.col("drop_reason") == r).alias(r) for r in ("short", "long", "banned", "copy")])


def _word_terms(text: Column) -> Column:
    """Words and pairs of neighbours."""
    w = F.regexp_extract_all(text, F.lit(r"([a-z0-9']+)"))
    return let(w, lambda w: F.concat(w, F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))))


def _char_terms(text: Column, least: int = 3, most: int = 5) -> Column:
    """Runs of 3 to 5 characters inside words that have a blank on either side; words shorter than a run are one term."""
    grams = lambda w: F.flatten(F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.greatest(F.lit(least), F.length(w)))), lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.length(w) - n, F.lit(0))), lambda i: F.substring(w, i + 1, n))))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: grams(F.concat(F.lit(" "), w, F.lit(" ")))))


def tfidf(df: DataFrame, id: str = "id", text: str = "text", min_docs: int = 2, analyzer: str = "word") -> DataFrame:
    """(id, term, weight): (1 + ln tf) * (1 + ln((1 + N) / (1 + df))), each text at unit length.

    analyzer: word for words and word pairs, char_wb for runs of 3 to 5 characters inside words.
    """
    lower = F.lower(F.coalesce(text, F.lit("")))
    terms = _word_terms(F.col("lower")) if analyzer == "word" else _char_terms(F.col("lower"))
    # texts are dealt by id, so that neither their terms nor their weights are; the vocabulary is what is sent
    tf = df.select(F.col(id).alias("id"), lower.alias("lower")).repartition("id").select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    d = written(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_docs), "vocabulary")
    # a vocabulary beyond the bound is not broadcast, however small its files are
    w = tf.join(broadcast_if_small(d.hint("merge")), "term").withColumn("weight", (1 + F.log("tf")) * (1 + F.log((1 + n.scalar()) / (1 + F.col("df")))))
    return w.withColumn("weight", F.col("weight") / F.sqrt(F.sum(F.col("weight") ** 2).over(W.partitionBy("id")))).select("id", "term", "weight")


def fit_text_classifier(df: DataFrame, label: str = "label", features: int = 1 << 14, c: float = 10.0):
    """A multinomial logistic regression over hashed words and word pairs. Returns the pipeline's model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, StringIndexer, VectorAssembler

    stages = [
        RegexTokenizer(inputCol="text", outputCol="w1", pattern=r"[a-z0-9']+", gaps=False),
        NGram(n=2, inputCol="w1", outputCol="w2"),
        HashingTF(inputCol="w1", outputCol="t1", numFeatures=features),
        HashingTF(inputCol="w2", outputCol="t2", numFeatures=features),
        VectorAssembler(inputCols=["t1", "t2"], outputCol="tf"),
        IDF(inputCol="tf", outputCol="features"),
        StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc"),
        LogisticRegression(featuresCol="features", labelCol="y", regParam=1 / (c * 100), maxIter=30, family="multinomial"),
    ]
    return Pipeline(stages=stages).fit(df.select(label, F.coalesce("text", F.lit("")).alias("text")))


def reader_status(df: DataFrame, tau: float = 0.6) -> DataFrame:
    """Adds status to (id, label, p) rows' best label: unsure under tau, correct_reasoning, or matched.

    Masked labels do not count, unless they are kept (a quiz item's own classes): masked and keep, where present.
    """
    masked = F.coalesce("masked", F.lit(False)) if "masked" in df.columns else F.lit(False)
    if "keep" in df.columns:
        masked = masked & ~F.coalesce("keep", F.lit(False))
    best = df.filter(~masked).groupBy("id").agg(F.max_by(F.struct("label", "p"), F.struct(F.round("p", 12), F.translate("label", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ZYXWVUTSRQPONMLKJIHGFEDCBA9876543210"))).alias("b"))
    return best.select("id", "b.label", "b.p", F.when(F.col("b.p") < tau, "unsure").when(F.col("b.label") == "CORRECT_REASON", "correct_reasoning").otherwise("matched").alias("status"))


def quote_grounding(cues: DataFrame, texts: DataFrame) -> DataFrame:
    """Cues whose quote stands in the learner's text, case and white space aside. cues: (id, quote), texts: (id, text)."""
    q, t = flat(F.lower("quote")), flat(F.lower("text"))
    return cues.join(texts, "id").filter((F.length(q) > 0) & F.contains(t, q)).select(*cues.columns)


def claim_grounding(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds class and verdict to claims about a run: an iteration count off by one is M01, "never ends" against a run that ends is M02.

    claims: (id, iterations, never_ends, text), runs: (id, iterations_run, ended).
    """
    rows = claims.join(runs, "id")
    off = F.col("iterations") - F.col("iterations_run")
    says = F.coalesce("never_ends", F.lit(False)) | F.coalesce(F.lower("text").rlike("infinite|never (ends|stops)|forever"), F.lit(False))
    cls = F.when(says & F.col("ended"), "M02").when(F.abs(off) == 1, "M01")
    return rows.withColumn("class", cls).withColumn("verdict", F.when(cls.isNotNull(), "misread").when((off == 0) | (says & ~F.col("ended")), "grounded").otherwise("open"))


def path_grounding(paths: DataFrame, by: str = "id") -> DataFrame:
    """Adds index and node of the first step at which a path leaves the right one, and the known wrong path it equals.

    paths: (id, path ARRAY, correct_path ARRAY, buggy ARRAY<STRUCT<path, misconception>>). A path that ends early leaves at its end.
    """
    zipped = F.arrays_zip(F.col("path").alias("a"), F.col("correct_path").alias("b"), F.sequence(F.lit(0), F.greatest(F.size("path"), F.size("correct_path"), F.lit(1)) - 1).alias("i"))
    off = F.filter(zipped, lambda z: ~z["a"].eqNullSafe(z["b"]))
    known = F.array_min(F.transform(F.filter("buggy", lambda x: x["path"] == F.col("path")), lambda x: x["misconception"]))
    first = F.get(off, 0)
    return paths.withColumn("divergence_index", first["i"]).withColumn("divergence_node", F.when(first["i"] > 0, F.get("correct_path", first["i"] - 1))).withColumn("misconception", known)


def prediction_of(events: DataFrame) -> DataFrame:
    """(id, prediction): the first event of a known kind with an answer, a value or a prediction. events: (id, ord, type, payload JSON)."""
    v = F.coalesce(*[F.get_json_object("payload", f"$.{k}") for k in ("answer", "value", "prediction")])
    return events.withColumn("v", v).filter("v is not null").groupBy("id").agg(F.min_by("v", "ord").alias("prediction"))


def code_item_outcome(df: DataFrame) -> DataFrame:
    """Adds outcome of fix_bug, debug and complete items from (type, tests_pass, line_right, planted)."""
    out = F.when(F.col("type") == "fix_bug", F.when(F.col("tests_pass"), "fixed").otherwise("still_broken")).when(F.col("type") == "debug", F.when(F.col("line_right"), "found").otherwise("missed")).when(F.col("type") == "complete", F.when(F.col("tests_pass"), "completed").otherwise("incomplete"))
    return df.withColumn("outcome", out).withColumn("updates", F.when(F.col("type") == "debug", F.col("planted").isNotNull()).when(F.col("type") == "complete", F.col("tests_pass")).otherwise(F.lit(True)))


def debug_answers(df: DataFrame, items: DataFrame) -> DataFrame:
    """Adds correct: without a planted bug the answer must be null, else one of its lines; only planted ones update."""
    rows = df.join(items.select("item_id", "planted", "bug_lines"), "item_id")
    return rows.withColumn("correct", F.when(F.col("planted").isNull(), F.col("line").isNull()).otherwise(F.coalesce(F.array_contains("bug_lines", F.col("line")), F.lit(False)))).withColumn("updates", F.col("planted").isNotNull())


def cross_bank_leaks(banks: DataFrame) -> DataFrame:
    """(key, bank_a, bank_b): texts that two banks hold, or one holds twice (bank_a = bank_b). banks: (bank, id, text)."""
    key = F.substring(F.sha2(F.regexp_replace(F.lower("text"), r"\s+", ""), 256), 1, 16)
    n = banks.groupBy(key.alias("key"), "bank").agg(F.count(F.lit(1)).alias("n"))
    inner = n.filter("n > 1").select("key", F.col("bank").alias("bank_a"), F.col("bank").alias("bank_b"))
    sets = n.groupBy("key").agg(F.array_sort(F.collect_set("bank")).alias("b")).filter(F.size("b") > 1)
    pair = F.flatten(F.transform("b", lambda x: F.transform(F.filter("b", lambda y: y > x), lambda y: F.struct(x.alias("bank_a"), y.alias("bank_b")))))
    return inner.unionByName(sets.select("key", F.inline(pair)))
