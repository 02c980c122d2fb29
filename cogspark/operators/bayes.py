"""Label posteriors, the value of items, and decisions. Long form: a row for each (key, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.columns import class_eig, let, tie_key, twin_of
from .shared import broadcast_if_small, chunked, written


def label_order() -> Column:
    return F.array_position(F.lit(C.LABELS), F.col("label"))


def labels(df: DataFrame) -> DataFrame:
    """Each row with each label and its place in the order of labels."""
    return df.select("*", F.posexplode(F.lit(C.LABELS)).alias("ord", "label"))


def likelihood_table(items: DataFrame) -> DataFrame:
    """items (item_id, options, correct, belief MAP) to (item_id, label, option, p): P(option | label).

    Without options the answers are the correct one, the beliefs and "other". A label is diagnostic if its belief is
    an option and not the correct one. Every p is floored, then each row of the table sums to 1.
    """
    free = F.array_distinct(F.concat(F.array("correct"), F.coalesce(F.map_values("belief"), F.array().cast("array<string>")), F.array(F.lit("other"))))
    options = F.when(F.size("options") > 0, F.array_distinct("options")).otherwise(free)
    rows = labels(items.withColumn("options", options)).select("item_id", "correct", "label", "options", F.element_at("belief", F.col("label")).alias("b"), F.explode("options").alias("option"))
    believes = F.coalesce((F.col("b") != F.col("correct")) & F.array_contains("options", F.col("b")), F.lit(False))
    n, right = F.size("options"), F.col("option") == F.col("correct")
    hit = F.when(F.col("label") == "OTHER", C.P_OTHER_CORRECT).otherwise(1 - C.SLIP)
    rest = lambda left, k: F.when(n > k, left / F.greatest(n - k, F.lit(1))).otherwise(0.0)
    on_right = (1 - C.P_BELIEF) * C.Q_CORRECT
    belief = F.when(F.col("option") == F.col("b"), C.P_BELIEF).when(right, on_right).otherwise(rest(F.lit(1 - C.P_BELIEF - on_right), 2))
    plain = F.when(right, hit).otherwise(rest(1 - hit, 1))
    raw = F.greatest(F.lit(C.PROB_FLOOR), F.when(believes & ~F.col("label").isin("CORRECT", "OTHER"), belief).otherwise(plain))
    return rows.withColumn("p", raw).withColumn("p", F.col("p") / F.sum("p").over(W.partitionBy("item_id", "label"))).select("item_id", "label", "option", "p")


def map_answer(answers: DataFrame, table: DataFrame) -> DataFrame:
    """Answers with those that are no option of their item turned to "other"."""
    known = table.select("item_id", "option").distinct().groupBy("item_id").agg(F.collect_set("option").alias("known"))
    return answers.join(known, "item_id").withColumn("answer", F.when(F.array_contains("known", F.col("answer")), F.col("answer")).otherwise("other")).drop("known")


def normalise(df: DataFrame, by, weight: Column, out: str = "p") -> DataFrame:
    """weight as shares of each key; keys without mass keep 0 and are marked no_mass."""
    total = F.sum("__w").over(W.partitionBy(*by))
    return df.withColumn("__w", weight).withColumn("__t", total).withColumn(out, F.when(F.col("__t") > 0, F.col("__w") / F.col("__t")).otherwise(0.0)).withColumn("no_mass", F.col("__t") <= 0).drop("__w", "__t")


def posterior_prior(p0: DataFrame, learner: DataFrame, by=("key",)) -> DataFrame:
    """p0 (key…, label, p, masked), learner (key…, label, active) to (key…, label, p, no_mass).

    Both sides meet as one row a key; a join of rows by label would be planned by the size of the keys alone.
    """
    prior = sums_by_label(p0, F.when(F.col("masked"), 0.0).otherwise(F.greatest("p", F.lit(0.0))), by).withColumnRenamed("values", "__p")
    known = sums_by_label(learner, F.col("active"), by).withColumnRenamed("values", "__k")
    floor = lambda k: F.pow(F.greatest(F.coalesce(k, F.lit(C.POPULATION_PRIOR)), F.lit(C.PRIOR_FLOOR)), F.lit(C.PRIOR_GAMMA))
    pi = lambda i, k: F.when(F.get(F.lit(C.LABELS), i).isin("CORRECT", "OTHER"), 1.0).otherwise(floor(k))
    rows = prior.join(known.hint("merge"), [*by], "left")
    weight = F.transform("__p", lambda p, i: p * pi(i, F.get("__k", i)))
    rows = rows.select(*by, weight.alias("w")).withColumn("t", F.aggregate("w", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))))
    out = F.transform("w", lambda x, i: F.struct(F.get(F.lit(C.LABELS), i).alias("label"), F.when(F.col("t") > 0, x / F.col("t")).when(x.isNotNull(), 0.0).alias("p")))
    return rows.select(*by, (F.col("t") <= 0).alias("no_mass"), F.inline(F.filter(out, lambda x: x["p"].isNotNull()))).select(*by, "label", "p", "no_mass")


def sums_by_label(rows: DataFrame, value: Column, by=("key",)) -> DataFrame:
    """(key…, label, …) to (key…, values ARRAY): the sums of value for each label in the order of labels, null for those without one."""
    at = label_order()
    sums = [F.sum(F.when(F.col("__at") == i + 1, F.col("__v"))).alias(f"__{i}") for i in range(len(C.LABELS))]
    wide = rows.select(*by, at.alias("__at"), value.alias("__v")).groupBy(*by).agg(*sums)
    return wide.select(*by, F.array(*[F.col(f"__{i}") for i in range(len(C.LABELS))]).alias("values"))


def by_label(rows: DataFrame, value: Column, by=("key",)) -> DataFrame:
    """(key…, label, …) to (key…, values ARRAY): the sums of value for each label in the order of labels. One row a key."""
    return sums_by_label(rows, value, by).select(*by, F.transform("values", lambda x: F.coalesce(x, F.lit(0.0))).alias("values"))


def _of_option(table: DataFrame) -> DataFrame:
    """The likelihood table with one row an option: (item_id, option, q ARRAY) in the order of labels. Items are few."""
    return by_label(table, F.col("p"), ("item_id", "option")).withColumnRenamed("values", "q")


def posterior_update(prior: DataFrame, answers: DataFrame, table: DataFrame, by=("key",)) -> DataFrame:
    """prior (key…, label, p), answers (key…, item_id, answer) to the posterior. The order of answers does not matter.

    Sums of logarithms are taken label by label in one row a key, before and after the one shuffle by key.
    """
    logs = broadcast_if_small(_of_option(table).select("item_id", F.col("option").alias("answer"), F.transform("q", lambda x: F.log(x)).alias("l")))
    told = answers.join(logs, ["item_id", "answer"]).groupBy(*by).agg(*[F.sum(F.get("l", F.lit(i))).alias(f"__{i}") for i in range(len(C.LABELS))])
    told = told.select(*by, F.array(*[F.col(f"__{i}") for i in range(len(C.LABELS))]).alias("l"))
    rows = by_label(prior, F.greatest("p", F.lit(0.0)), by).join(told, [*by], "left")
    # the largest logarithm of a key is taken away first
    top = F.array_max("l")
    w = F.when(F.col("l").isNull(), F.col("values")).otherwise(F.zip_with("values", "l", lambda p, l: p * F.exp(l - top)))
    rows = rows.select(*by, w.alias("w")).withColumn("t", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
    out = F.transform("w", lambda x, i: F.struct(F.get(F.lit(C.LABELS), i).alias("label"), F.when(F.col("t") > 0, x / F.col("t")).otherwise(0.0).alias("p")))
    return rows.select(*by, (F.col("t") <= 0).alias("no_mass"), F.inline(out)).select(*by, "label", "p", "no_mass")


def option_posterior(answers: DataFrame, knowledge: DataFrame, items: DataFrame, by=("learner_id", "item_id")) -> DataFrame:
    """What one choice alone tells: all labels alike, then the learner's knowledge as a prior, then the answer: (by…, label, p).

    answers: (by…, answer), an answer that is no option counting as "other"; knowledge: (learner_id, class, p_active).
    """
    table = likelihood_table(items)
    p0 = labels(answers.select(*by)).select(*by, "label", F.lit(1 / len(C.LABELS)).alias("p"), F.lit(False).alias("masked"))
    known = answers.select(*by).join(knowledge.select("learner_id", F.col("class").alias("label"), F.col("p_active").alias("active")), "learner_id")
    prior = posterior_prior(p0, known, by).select(*by, "label", "p")
    told = map_answer(answers.select(*by, "answer", *(["item_id"] if "item_id" not in by else [])), table)
    return posterior_update(prior, told, table, by).select(*by, "label", "p")


def apply_text(posterior: DataFrame, by=("key",)) -> DataFrame:
    """posterior (key…, label, p, p_text, unsure): p times (epsilon + p_text)^beta, unless the reader is unsure."""
    weight = F.when(F.col("unsure"), F.col("p")).otherwise(F.col("p") * F.pow(F.greatest(F.coalesce("p_text", F.lit(0.0)), F.lit(0.0)) + C.TEXT_EPSILON, F.lit(C.TEXT_BETA)))
    return normalise(posterior, by, weight).withColumn("p", F.when(F.col("unsure"), F.col("p")).otherwise(F.col("p")))


def ranked(posterior: DataFrame, by=("key",)) -> DataFrame:
    """Adds rank: by falling p, ties (to 12 digits) in the order of labels."""
    return posterior.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.round("p", 12)), label_order())))


def entropy(p: Column) -> Column:
    """A term of an entropy in bits."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def item_eig(posterior: DataFrame, asks: DataFrame, table: DataFrame, by=("key",)) -> DataFrame:
    """Bits that each item is expected to give. asks: (key…, item_id) candidates.

    A key's posterior is one row, an item's likelihoods are another; the bits are sums within their pair.
    """
    items = broadcast_if_small(_of_option(table).groupBy("item_id").agg(F.collect_list("q").alias("qs")))
    pairs = asks.join(by_label(posterior, F.col("p"), by), [*by]).join(items, "item_id")
    log = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    # H(label) - sum over answers of p(a) H(label | a), with p(a) H(label | a) = p(a) log2 p(a) - sum j log2 j
    after = total(F.transform("qs", lambda q: let(F.zip_with("values", q, lambda p, x: p * x), lambda j: log(total(j)) - total(F.transform(j, log)))))
    return pairs.select(*by, "item_id", (-total(F.transform("values", log)) - after).alias("eig_bits"))


def select_probe(posterior: DataFrame, asked: DataFrame, probes: DataFrame, by=("key",)) -> DataFrame:
    """The next probe of each key, or no row. probes: (item_id, options, correct, belief); asked: (key…, item_id).

    None after two probes or with a label at the stop; candidates believe in one of the top three labels; only
    without candidates the probe of the top pair's set of look-alikes is tried.
    """
    table = likelihood_table(probes)
    top = ranked(posterior, by).filter("rank <= 3").groupBy(*by).agg(F.collect_list("label").alias("top"), F.max("p").alias("best"), F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("one"), F.max(F.when(F.col("rank") == 2, F.col("label"))).alias("two"))
    done = asked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_asked"), F.collect_set("item_id").alias("asked"))
    open_ = top.join(done, [*by], "left").filter((F.coalesce("n_asked", F.lit(0)) < C.MAX_PROBES) & (F.col("best") < C.POSTERIOR_STOP)).withColumn("asked", F.coalesce("asked", F.array().cast("array<string>")))
    beliefs = probes.select("item_id", F.explode(F.map_keys("belief")).alias("label")).distinct()
    own = open_.select(*by, "asked", F.explode("top").alias("label")).join(beliefs, "label").filter(~F.array_contains("asked", F.col("item_id"))).select(*by, "item_id").distinct()
    fallback = open_.join(own.select(*by).distinct(), [*by], "left_anti").withColumn("item_id", F.concat(F.lit("P_"), twin_of(F.col("one"), F.col("two")), F.lit("_a"))).filter(F.col("item_id").isNotNull() & ~F.array_contains("asked", F.col("item_id"))).select(*by, "item_id")
    fallback = fallback.join(probes.select("item_id"), "item_id", "left_semi").select(*by, "item_id")
    found = item_eig(posterior, own.unionByName(fallback), table, by)
    first = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("eig_bits"), "item_id"))
    return found.withColumn("rank", first).filter((F.col("rank") == 1) & (F.col("eig_bits") >= C.EIG_MIN_BITS)).drop("rank")


def decide(posterior: DataFrame, facts: DataFrame, by=("key",)) -> DataFrame:
    """facts (key…, gate, tests_passed, abstain, fixable, n_asked, probe_bits) to (key…, status, top1, p1, top2, p2, band, latent, twin_set)."""
    two = ranked(posterior, by).filter("rank <= 2").groupBy(*by).agg(*[F.max(F.when(F.col("rank") == i, F.col(c))).alias(n) for i, c, n in ((1, "label", "top1"), (1, "p", "p1"), (2, "label", "top2"), (2, "p", "p2"))])
    # cut to 12 digits, as the order is: a P on a threshold, or halfway between shown digits, is not left to the order of a sum
    rows = two.withColumns({c: F.round(c, 12) for c in ("p1", "p2")}).join(facts, [*by])
    close = (F.col("p1") < C.CONFIDENT_P) & (F.col("p1") - F.col("p2") < C.CONFIDENT_MARGIN)
    both = F.col("top1").isin(C.MISCONCEPTIONS) & F.col("top2").isin(C.MISCONCEPTIONS) & (F.col("p2") >= C.TWO_BUG_P2) & F.coalesce("fixable", F.lit(False))
    probe = (F.col("n_asked") < C.MAX_PROBES) & (F.col("p1") < C.POSTERIOR_STOP) & (F.coalesce("probe_bits", F.lit(0.0)) >= C.EIG_MIN_BITS)
    status = F.when(F.col("gate") != "G0", "gate").when(F.col("tests_passed"), "correct").when(F.coalesce("abstain", F.lit(False)), "novel").when(both, "two_bug").when(close & probe, "ambiguous").otherwise("confident")
    rows = rows.withColumn("status", status)
    shown = F.when((F.col("status") == "confident") & close, "Possible").when(F.col("p1") >= C.LIKELY, "Likely").when(F.col("p1") >= C.POSSIBLE, "Possible").otherwise("Unsure")
    gate = F.col("status") == "gate"
    twin = F.when((close | (F.col("n_asked") > 0)) & (F.col("p2") >= C.TOP_MIN_P) & ~gate, twin_of(F.col("top1"), F.col("top2")))
    latent = F.when((F.col("status") == "correct") & (F.col("top1") != "CORRECT") & (F.col("p1") >= C.LATENT_MIN_P), F.col("top1"))
    hide = lambda c: F.when(~gate, F.col(c)).alias(c)
    return rows.select(*by, "status", hide("top1"), hide("p1"), F.when(~gate & (F.col("p2") >= C.TOP_MIN_P), F.col("top2")).alias("top2"), F.when(~gate & (F.col("p2") >= C.TOP_MIN_P), F.col("p2")).alias("p2"), F.when(~gate, shown).alias("band"), latent.alias("latent"), twin.alias("twin_set"))


def mask_posterior(posterior: DataFrame, features: DataFrame, preconditions: dict[str, list[str]], by=("key",)) -> DataFrame:
    """Labels whose preconditions are all 0 lose their mass; null is unknown and keeps it; a key left with none keeps all."""
    allowed = F.lit(True)
    for label, cols in preconditions.items():
        ok = F.lit(False)
        for c in cols:
            ok = ok | F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.col(c) != 0)
        allowed = F.when(F.col("label") == label, ok).otherwise(allowed)
    rows = posterior.join(features, [*by]).withColumn("__m", F.when(allowed, F.col("p")).otherwise(0.0))
    left = F.sum("__m").over(W.partitionBy(*by))
    rows = rows.withColumn("__m", F.when(left > 0, F.col("__m")).otherwise(F.col("p")))
    return normalise(rows.drop("p"), by, F.col("__m")).select(*by, "label", "p", allowed.alias("allowed"))


def belief_exposure(items: DataFrame) -> DataFrame:
    """(item_id, class, exposure): the chance that a class's believer gives its answer."""
    b = items.select("item_id", "correct", F.explode("belief").alias("label", "option")).filter(F.col("label").isin(C.MISCONCEPTIONS) & (F.col("option") != F.col("correct")))
    return b.join(likelihood_table(items), ["item_id", "label", "option"]).select("item_id", F.col("label").alias("class"), F.col("p").alias("exposure"))


def next_item(knowledge: DataFrame, exposures: DataFrame, asked: DataFrame, default: float = C.POPULATION_PRIOR, salt: str = "", by=("learner_id",), type: str | None = None, concept: str | None = None, group: str | None = None) -> DataFrame:
    """Each learner's item with the most expected bits, ties by hash. exposures: (item_id, class, exposure); asked: (by…, item_id).

    A class without a value has the default. type and concept keep the items of exposures' columns of those names.
    group: a column of exposures, one value an item; asked is (by…, group) then, and all items of such a group are asked.
    """
    cells = exposures.filter(F.col("exposure") >= C.EXAM_MIN_EXPOSURE)
    for column, wanted in (("type", type), ("concept", concept)):
        cells = cells.filter(F.col(column) == wanted) if wanted is not None else cells
    # items that expose alike are worth the same: learners meet the few different exposures, not the items
    of = cells.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("class", "exposure"))).alias("cells"), (F.first(group) if group else F.lit(None).cast("string")).alias("__group"))
    of = written(of.withColumn("kind", F.xxhash64("cells", "__group")), "exposed")
    kinds = of.groupBy("kind").agg(F.first("cells").alias("cells"), F.first("__group").alias("__group"), F.count(F.lit(1)).alias("n_items"))
    p = by_label(knowledge.select(*by, F.col("class").alias("label"), "p_active"), F.col("p_active") - F.lit(default), by)
    at = lambda x: F.get("values", (F.array_position(F.lit(C.LABELS), x["class"]) - 1).cast("int")) + default
    bits = F.aggregate("cells", F.lit(0.0), lambda a, x: a + let(at(x), lambda p: class_eig(p, x["exposure"], inside=True)))
    every = kinds.agg(F.collect_list(F.struct("kind", "__group", "n_items", "cells"))).scalar()  # as many as different exposures
    if group:
        p = p.join(asked.groupBy(*by).agg(F.collect_set(group).alias("__asked")), [*by], "left")
    gains = p.select("*", F.inline(every))
    if group:
        gains = gains.filter(~F.coalesce(F.array_contains("__asked", F.col("__group")), F.lit(False)))
    gains = gains.select(*by, "kind", "n_items", bits.alias("eig_bits"))
    if not group:
        used = asked.join(of.select("item_id", "kind"), "item_id").groupBy(*by, "kind").agg(F.collect_set("item_id").alias("__used"))
        gains = gains.join(used, [*by, "kind"], "left").filter(F.col("n_items") > F.coalesce(F.size("__used"), F.lit(0)))
    best = gains.withColumn("__top", F.max(F.round("eig_bits", 9)).over(W.partitionBy(*by))).filter(F.round("eig_bits", 9) == F.col("__top"))
    ids = F.col("ids") if group else F.when(F.col("__used").isNull(), F.col("ids")).otherwise(F.array_except("ids", "__used"))
    # of a chunk of a kind's items the first by hash goes on
    key = lambda i: tie_key(*[F.col(c).cast("string") for c in by], F.lit(salt), i.cast("string"))
    first = F.array_min(F.transform(ids, lambda i: F.struct(key(i).alias("key"), i.alias("item_id"))))
    tied = best.join(broadcast_if_small(chunked(of, "kind").drop("chunk")), "kind").select(*by, "eig_bits", first.alias("f")).filter("f is not null")
    return tied.groupBy(*by).agg(F.min(F.struct("f.key", "f.item_id", "eig_bits")).alias("b")).select(*by, "b.item_id", "b.eig_bits")


def score_quiz(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(learner_id, item_id, class, if_active, if_not, ask_reason) for each class that an answered item exposes."""
    table = likelihood_table(items)
    mapped = map_answer(answers, table)
    beliefs = items.select("item_id", F.explode("belief").alias("class", "believed"))
    like = table.select("item_id", F.col("option").alias("answer"), "label", "p")
    shared = F.count(F.when(F.col("believed") == F.col("answer"), 1)).over(W.partitionBy("learner_id", "item_id"))
    rows = mapped.join(beliefs, "item_id").withColumn("ask_reason", shared >= 2)
    rows = rows.join(like.select("item_id", "answer", F.col("label").alias("class"), F.col("p").alias("if_active")), ["item_id", "answer", "class"])
    return rows.join(like.filter("label = 'CORRECT'").select("item_id", "answer", F.col("p").alias("if_not")), ["item_id", "answer"]).select("learner_id", "item_id", "class", "if_active", "if_not", "ask_reason")


def fuse_multimodal(candidates: DataFrame, answers: DataFrame, cues: DataFrame, by=("key",)) -> DataFrame:
    """(key…, label, p, rank, status, top_p, shown_p, twin_set): an answer's shares of its candidate labels.

    candidates: (key…, label, prior), prior null where there is none; answers: (key…, found, hedges, is_correct,
    needs_probe), found being the label of a deterministic finding or null; cues: (key…, label, strength).

    A candidate without a prior weighs 1 where its answer has none at all, else 1 / number of candidates. A cue without a
    strength, or with 0, counts as .7. An answer without candidates is OTHER with .5.

    A finding triples its label and takes the others down to a fifth; one outside the candidates enters with 2. Each cue
    multiplies its label by 1 + strength / 2. Hedging lowers top_p, the top share, for the whole answer, not below .40.
    Two labels closer than .15, or a probe that is needed, make the answer ambiguous: shown_p is .48 then, and the
    candidate sets of two look-alikes name their twin set. A correct answer is CORRECT with .95, whatever else is there.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    open_ = answers.filter(~flag("is_correct"))
    listed = candidates.select(*by, "label", "prior").join(open_.select(*by, "found"), list(by))
    sets = listed.groupBy(*by).agg(F.array_sort(F.collect_set("label")).alias("__set"), F.count("prior").alias("__priors"))  # labels are few
    sure = F.when(F.col("found").isNull(), 1.0).when(F.col("found") == F.col("label"), C.FOUND_FACTOR).otherwise(C.NOT_FOUND_FACTOR)
    known = F.exists(F.col("__set"), lambda x: x == F.col("found"))
    # a finding that is no candidate comes in beside them, and leaves their weights alone
    own = listed.join(sets, list(by)).select(*by, "label", (F.coalesce("prior", F.when(F.col("__priors") > 0, 1 / F.size("__set")).otherwise(1.0)) * F.when(known, sure).otherwise(1.0)).alias("w"))
    beside = open_.filter("found is not null").join(sets, list(by), "left").filter(~F.coalesce(known, F.lit(False))).select(*by, F.col("found").alias("label"), F.lit(C.FOUND_OUTSIDE).alias("w"))
    cue = cues.groupBy(*by, "label").agg(F.product(1 + C.CUE_FACTOR * F.coalesce(F.nullif(F.col("strength"), F.lit(0.0)), F.lit(C.CUE_STRENGTH))).alias("__cue"))
    other = open_.join(own.unionByName(beside).select(*by).distinct(), list(by), "left_anti").select(*by, F.lit("OTHER").alias("label"), F.lit(-1.0).alias("w"))
    own = own.unionByName(other)
    rows = normalise(own.unionByName(beside).join(cue, [*by, "label"], "left"), by, F.col("w") * F.coalesce("__cue", F.lit(1.0))).withColumn("p", F.when(F.col("w") < 0, 0.5).otherwise(F.col("p")))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.round("p", 12)), "label"))).join(open_.select(*by, "hedges", "needs_probe"), list(by)).join(sets, list(by), "left")
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("p"))).over(W.partitionBy(*by))
    ambiguous = flag("needs_probe") | F.coalesce(F.round(at(1) - at(2), 12) < C.FUSE_MARGIN, F.lit(False))
    rows = rows.withColumn("status", F.when(ambiguous, "ambiguous").otherwise("confident")).withColumn("top_p", F.greatest(F.lit(C.HEDGE_FLOOR), at(1) - F.least(F.lit(C.HEDGE_MOST), F.coalesce("hedges", F.lit(0)) * C.HEDGE_PENALTY)))
    shown = F.when(F.col("status") == "ambiguous", F.when(F.col("rank") <= 2, C.AMBIGUOUS_P)).otherwise(F.when(F.col("rank") == 1, F.round("p", 2)))
    pair = F.array_join("__set", "|")
    twin = F.when(F.col("status") == "ambiguous", F.when(pair == "M01|M08", "T1").when(pair == "M06|M07", "T3"))
    out = rows.select(*by, "label", "p", "rank", "status", "top_p", shown.alias("shown_p"), twin.alias("twin_set"))
    right = answers.filter(flag("is_correct")).select(*by, F.lit("CORRECT").alias("label"), F.lit(C.CORRECT_P).alias("p"), F.lit(1).alias("rank"), F.lit("correct").alias("status"), F.lit(C.CORRECT_P).alias("top_p"), F.lit(C.CORRECT_P).alias("shown_p"), F.lit(None).cast("string").alias("twin_set"))
    return out.unionByName(right)


def rank_contributions(contributions: DataFrame, k: int = 3, by=("key", "label")) -> DataFrame:
    """The k largest positive contributions of each (key, label) and their shares of all positive ones."""
    pos = contributions.filter("value > 0").withColumn("share", F.col("value") / F.sum("value").over(W.partitionBy(*by)))
    return pos.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("value"), "feature"))).filter(F.col("rank") <= k)
