"""Curation of a labelled corpus: clashes, duplicates, caps, splits, weights, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.columns import bucket, components_of, fingerprint, flat, is_close
from .shared import broadcast_if_small, numbered, written


#: Up to so many rows of a key Spark's window keeps the first ones of each task (spark.sql.optimizer.windowGroupLimitThreshold).
FEW = 1000


def training_rows(rows: DataFrame) -> DataFrame:
    """Without the holdout split, rows that pass by luck, and sources other than A, E and AMB."""
    return rows.filter((F.coalesce("split", F.lit("")) != "holdout") & ~F.coalesce("passes_by_luck", F.lit(False)) & F.col("source").isin("A", "E", "AMB"))


def slice_masks(rows: DataFrame) -> DataFrame:
    """Adds bank_train, holdout and realistic."""
    return rows.withColumns({"bank_train": (F.col("split") == "train") & F.col("source").isin("A", "E", "AMB"), "holdout": F.col("split") == "holdout", "realistic": F.col("source") == "R-llm"})


def with_fingerprint(rows: DataFrame, code: str = "code") -> DataFrame:
    return rows.withColumn("hash", fingerprint(F.coalesce(F.col(code), F.lit(""))))


def resolve_clashes(rows: DataFrame, allowed=("M01", "M08")) -> DataFrame:
    """Labels of one hash: one stays; just the allowed pair becomes soft, half and half; else the majority label is kept.

    Adds labels_all, kept and soft; rows of other labels than the kept one go. Ties go to the larger label.
    """
    per = rows.groupBy("hash", "label").agg(F.count(F.lit(1)).alias("n"))
    by = per.groupBy("hash").agg(F.array_sort(F.collect_list("label")).alias("labels_all"), F.max(F.struct("n", "label"))["label"].alias("major"))
    soft = F.col("labels_all") == F.array(*[F.lit(x) for x in sorted(allowed)])
    by = by.withColumn("soft", soft).withColumn("kept", F.when(~soft, F.col("major"))).drop("major")
    return rows.join(by, "hash").filter(F.col("soft") | (F.col("label") == F.col("kept")))


def clashes(rows: DataFrame, allowed=("M01", "M08")) -> DataFrame:
    """(hash, labels, kept) of hashes with several labels other than the allowed pair."""
    per = rows.groupBy("hash", "label").agg(F.count(F.lit(1)).alias("n"))
    by = per.groupBy("hash").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"), F.max(F.struct("n", "label"))["label"].alias("kept"), F.count(F.lit(1)).alias("k"))
    return by.filter((F.col("k") > 1) & (F.col("labels") != ",".join(sorted(allowed)))).drop("k")


def expand_ambiguous(rows: DataFrame, labels=("M01", "M08")) -> DataFrame:
    """For AMB rows the (code hash, label) pairs that are missing, as clones."""
    amb = rows.filter("source = 'AMB'").filter(F.col("label").isin(*labels))
    want = amb.dropDuplicates(["hash"]).withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    return want.join(amb.select("hash", "label").distinct(), ["hash", "label"], "left_anti")


def dedupe_by_priority(rows: DataFrame, key=("label", "code"), priority=("AMB", "E", "A"), order: str = "id") -> DataFrame:
    """One row for each key: the source that comes first in the priority, then the least order."""
    rank = F.coalesce(F.array_position(F.lit(list(priority)), F.col("source")), F.lit(0))
    rank = F.when(rank == 0, 99).otherwise(rank)
    hashed = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in key]), 256)
    # wide rows are not sorted: only the place of the winner is aggregated
    best = rows.groupBy(hashed.alias("__k")).agg(F.min(F.struct(rank.alias("r"), F.col(order).alias("o")))["o"].alias("__best"))
    return rows.withColumn("__k", hashed).join(best, "__k").filter(F.col(order) == F.col("__best")).drop("__k", "__best")


def capped_round_robin(rows: DataFrame, label: str, bucket_cols: list[str], high: int, aim: int, cap: int = 15, loose: int | None = None, order: str = "id") -> DataFrame:
    """At most `high` rows of each label, one from each bucket a turn, at most `cap` of a bucket.

    Where capped buckets hold fewer than `aim` rows of a label, its cap is `loose` (none by default).
    """
    rows = numbered(rows, (label, *bucket_cols), [order], "turn")
    # every bucket has as many rows up to its cap as turns up to it: countable before any global order
    held = rows.groupBy(label).agg(F.sum((F.col("turn") <= cap).cast("int")).alias("held"))
    rows = rows.join(broadcast_if_small(held), label)
    limit = F.when(F.col("held") < aim, F.lit(loose) if loose else F.col("turn")).otherwise(F.lit(cap))
    rows = rows.filter(F.col("turn") <= limit)
    turns = ["turn", *bucket_cols, order]
    # Spark keeps the first rows of each label in every task before it shuffles them, if they are few enough
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(label).orderBy(*turns))) if high <= FEW else numbered(rows, (label,), turns)
    return ranked.filter(F.col("rank") <= high).drop("held")


def backfill(rows: DataFrame, picked: DataFrame, label: str = "label", floor: int = 80, order: str = "id") -> DataFrame:
    """Rows not picked that bring labels up to the floor, in order."""
    have = picked.groupBy(label).agg(F.count(F.lit(1)).alias("have"))
    rest = rows.join(picked.select(order), order, "left_anti").join(broadcast_if_small(have), label, "left")
    ranked = rest.withColumn("rank", F.row_number().over(W.partitionBy(label).orderBy(order))) if floor <= FEW else numbered(rest, (label,), [order])
    # first by the floor itself: with a fixed number Spark keeps so many rows of each label in every task before it shuffles
    return ranked.filter(F.col("rank") <= floor).filter(F.col("rank") <= floor - F.coalesce("have", F.lit(0))).drop("have", "rank")


def fill_total(rows: DataFrame, picked: DataFrame, total: int = C.LABEL_TOTAL, order: str = "id") -> DataFrame:
    """Rows not picked that bring all picked ones up to the total, in order: a fixed number, whatever the data."""
    need = max(0, total - picked.limit(total).count())
    return rows.join(picked.select(order), order, "left_anti").orderBy(order).limit(need)


def balance_share(rows: DataFrame, special: Column, share: float = 0.3, order: str = "id") -> DataFrame:
    """Drops the tail of the plain rows so that the special ones are at least `share` of what stays."""
    n = rows.filter(special).count()
    limit = int(n * (1 - share) / share)
    plain = rows.filter(~special)
    cut = plain.select(order).orderBy(order).limit(limit)  # distributed top-k
    return rows.filter(special).unionByName(plain.join(cut, order, "left_semi"))


def judge(candidates: DataFrame) -> DataFrame:
    """The decision on each candidate from its run and the predicates that fired.

    (tests_failed, tests_total, fired ARRAY, label), and where present status, mode (correct, other or bug) and odd_ok: a
    run that did not parse is parse; a correct program is kept only if all pass; all passed is luck otherwise; a program
    of no class in which another class's predicate fires is other_class; an unreachable base without an odd input is
    odd_n; no predicate of its own is predicate; else keep.
    """
    has = set(candidates.columns)
    status = F.coalesce("status", F.lit("ok")) if "status" in has else F.lit("ok")
    mode = F.coalesce("mode", F.lit("bug")) if "mode" in has else F.lit("bug")
    odd = F.coalesce("odd_ok", F.lit(True)) if "odd_ok" in has else F.lit(True)
    own, other = F.array_contains("fired", F.col("label")), F.size(F.array_except("fired", F.array("label"))) > 0
    whole = F.when((F.col("tests_failed") == 0) & (status == "ok"), "keep").otherwise("fail_tests")
    out = F.when(status.isin("parse_error", "unsupported"), "parse").when(mode == "correct", whole).when(F.col("tests_total") == 0, "fail_tests").when(F.col("tests_failed") == 0, "luck")
    out = out.when(mode == "other", F.when(F.size("fired") > 0, "other_class").otherwise("keep")).when(other & ~own, "other_class").when(~odd, "odd_n").when(~own, "predicate").otherwise("keep")
    return candidates.withColumn("decision", out)


def two_bug_pairs(singles: DataFrame) -> DataFrame:
    """(problem_id, op_a, op_b, common) of single-bug rows of one problem whose failed tests overlap. fails: ARRAY of tests.

    Pairs meet on a failed test, so that rows without a common one never meet.
    """
    each = singles.select("problem_id", "op_id", F.explode("fails").alias("test"))
    a, b = each.withColumnRenamed("op_id", "op_a"), each.withColumnRenamed("op_id", "op_b")
    return a.join(b, ["problem_id", "test"]).filter("op_a < op_b").groupBy("problem_id", "op_a", "op_b").agg(F.countDistinct("test").alias("common"))


def drop_report(attempts: DataFrame, kept: DataFrame, luck: DataFrame, by=("op_id",)) -> DataFrame:
    """(op_id, attempts, kept, luck, drop_low, drop_high, inconsistent): bounds of the share that an operator loses."""
    n = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    rows = n(attempts, "attempts").join(n(kept, "kept"), [*by], "full_outer").join(n(luck, "luck"), [*by], "full_outer").fillna(0, ["attempts", "kept", "luck"])
    a = F.col("attempts")
    return rows.withColumns({"drop_low": F.when(a > 0, F.col("luck") / a), "drop_high": F.when(a > 0, (a - F.col("kept")) / a), "inconsistent": F.col("kept") + F.col("luck") > a})


def soft_expand(rows: DataFrame) -> DataFrame:
    """soft_label MAP to one row for each label with mass: (…, soft, p)."""
    return rows.select("*", F.explode("soft_label").alias("soft", "p")).filter("p > 0")


def class_weights(rows: DataFrame) -> DataFrame:
    """soft rows (soft, p) to (label, mass, weight): N over the number of present labels times a label's mass."""
    mass = rows.groupBy(F.col("soft").alias("label")).agg(F.sum("p").alias("mass"))
    total = mass.agg(F.sum("mass").alias("n"), F.count(F.lit(1)).alias("k"))
    return mass.withColumns({"n": total.select("n").scalar(), "k": total.select("k").scalar()}).select("label", "mass", (F.col("n") / (F.col("k") * F.col("mass"))).alias("weight"))


def grouped_folds(rows: DataFrame, group: str, stratum: str, k: int = 5) -> DataFrame:
    """(group, stratum, n, fold): whole groups, dealt within each stratum from the largest to the fold in turn, back and forth."""
    n = rows.groupBy(group, stratum).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy(stratum).orderBy(F.desc("n"), group)) - 1
    turn, at = F.floor(place / k), place % k
    return n.withColumn("fold", F.when(turn % 2 == 0, at).otherwise(k - 1 - at).cast("int"))


def leak_free(train: DataFrame, test: DataFrame, key: str = "hash", held: str | None = None) -> DataFrame:
    """Training rows that share no key with the test rows, and do not use the held operator; empty keys are no leak."""
    rows = train.join(test.filter(F.col(key) != "").select(key).distinct(), key, "left_anti")
    return rows if held is None else rows.filter(~F.coalesce(F.array_contains(components_of(F.col("op_id")), held), F.lit(False)))


def operator_holdout(rows: DataFrame, least: int = 8) -> DataFrame:
    """(label, held, n): of each label with two operators or more, the last by name with enough rows."""
    per = rows.select("label", F.explode(components_of(F.col("op_id"))).alias("op")).groupBy("label", "op").agg(F.count(F.lit(1)).alias("n"))
    two = per.groupBy("label").agg(F.count(F.lit(1)).alias("ops"), F.max(F.when(F.col("n") >= least, F.struct("op", "n"))).alias("m")).filter("ops >= 2 and m is not null")
    return two.select("label", F.col("m.op").alias("held"), F.col("m.n").alias("n"))


def holdout_split(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds part: test for a label's held operator, drop for other rows with it, train for the rest."""
    held = plan.select(F.col("label").alias("__l"), F.col("held").alias("__h"))
    rows = rows.join(broadcast_if_small(held), F.col("label") == F.col("__l"), "left")
    has = F.array_contains(components_of(F.col("op_id")), F.col("__h"))
    return rows.withColumn("part", F.when(F.coalesce(has, F.lit(False)), F.when(F.col("op_id") == F.col("__h"), "test").otherwise("drop")).otherwise("train")).drop("__l", "__h")


def leave_one_class_out(rows: DataFrame, label: str) -> DataFrame:
    return rows.withColumn("part", F.when(F.col("label") == label, "test").otherwise("train"))


def pick_diverse(rows: DataFrame, n: int = 3, by: str = "label") -> DataFrame:
    """n rows of each label: first one for each new operator in each new problem, then new operators, then any; short diffs first."""
    order = [F.col("diff"), F.col("id")]
    rows = rows.withColumn("a", F.row_number().over(W.partitionBy(by, "problem_id").orderBy(*order))).withColumn("b", F.row_number().over(W.partitionBy(by, "op_id").orderBy(*order)))
    rule = F.when((F.col("a") == 1) & (F.col("b") == 1), 1).when(F.col("b") == 1, 2).otherwise(3)
    rank = F.row_number().over(W.partitionBy(by).orderBy("rule", *order))
    return rows.withColumn("rule", rule).withColumn("rank", rank).filter(F.col("rank") <= n).drop("a", "b")


def compose_bank(candidates: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """All collision items, and of the others up to a type's quota for each class, ties by id."""
    quota = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in quotas.items()], F.lit(0))
    rank = F.row_number().over(W.partitionBy("class", "type", "collision").orderBy("item_id"))
    return candidates.withColumn("rank", rank).filter(F.col("collision") | (F.col("rank") <= quota)).drop("rank")


def choose_bank(candidates: DataFrame, wanted: dict[str, int] = C.WANTED, taken: DataFrame | None = None, limit: float = C.TOO_CLOSE) -> DataFrame:
    """(item_id, class, kind, slot): the items of a bank, no two of a class too close to each other.

    candidates: (item_id, class, type, code, collision, has_options, in_problem); taken: (code) used before. Programs
    that equal an earlier one but for white space, or a taken one, and those of problems are left out. All collision
    items of the first two kinds are in (slot 0). Then each class fills its kinds in order, in order of item_id, leaving
    out what is more than `limit` alike to one of its own items; reasoning items are predict_output items without
    need of options. The slots are few; each is one pass over what is left, in which all classes choose at once.
    """
    rows = candidates.filter(~F.coalesce("in_problem", F.lit(False))).withColumn("__flat", flat(F.col("code")))
    rows = rows.join(rows.groupBy("__flat").agg(F.min("item_id").alias("__first")), "__flat").filter(F.col("item_id") == F.col("__first")).drop("__first")
    if taken is not None:
        rows = rows.join(taken.select(flat(F.col("code")).alias("__flat")).distinct(), "__flat", "left_anti")
    rows = rows.select("item_id", "class", "type", F.col("__flat").alias("code"), F.coalesce("collision", F.lit(False)).alias("collision"), F.coalesce("has_options", F.lit(False)).alias("has_options"))
    picked = rows.filter(F.col("collision") & F.col("type").isin(*list(wanted)[:2])).select("item_id", "class", F.col("type").alias("kind"), F.lit(0).alias("slot"))
    left, slot = written(rows.filter(~F.col("collision")), "bank"), 0
    for kind, n in wanted.items():
        of = F.col("type") == ("predict_output" if kind == "reasoning" else kind)
        fits = of if kind == "reasoning" else of & F.col("has_options")
        for _ in range(n):
            slot += 1
            new = written(left.filter(fits).groupBy("class").agg(F.min_by(F.struct("item_id", "code"), "item_id").alias("n")).select("class", "n.item_id", "n.code"), "chosen")
            picked = picked.unionByName(new.select("item_id", "class", F.lit(kind).alias("kind"), F.lit(slot).alias("slot")))
            if slot == sum(wanted.values()):
                break
            beside = left.join(F.broadcast(new.select("class", F.col("item_id").alias("__id"), F.col("code").alias("__code"))), "class", "left")  # a row a class
            left = written(beside.filter(F.col("__id").isNull() | (F.col("item_id") != F.col("__id")) & ~is_close(F.col("code"), F.col("__code"), limit)).drop("__id", "__code"), "bank")
    return picked


def bank_gaps(picked: DataFrame, classes: list[str], wanted: dict[str, int] = C.WANTED) -> DataFrame:
    """(class, kind, got, wanted) of the kinds that a class has too few items of; collision items do not count."""
    want = picked.sparkSession.createDataFrame([(c, k, n) for c in classes for k, n in wanted.items()], "class string, kind string, wanted int")
    got = picked.filter("slot > 0").groupBy("class", "kind").agg(F.count(F.lit(1)).cast("int").alias("got"))
    return want.join(got, ["class", "kind"], "left").fillna(0, ["got"]).filter("got < wanted").select("class", "kind", "got", "wanted")


def adjudicate(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Labels overridden by hash; old_label and reason are kept. overrides: (hash, new_label, reason)."""
    out = rows.join(overrides, "hash", "left")
    return out.withColumn("old_label", F.when(F.col("new_label").isNotNull(), F.col("label"))).withColumn("label", F.coalesce("new_label", "label")).drop("new_label")


def rater_agreement(rows: DataFrame) -> DataFrame:
    """One row before any override: (n, agree, share). rows: (label, soft_label MAP, rater2); any label of a soft pair counts as M01."""
    second = F.when(F.coalesce(F.map_contains_key("soft_label", F.coalesce("rater2", F.lit(""))), F.lit(False)), "M01").otherwise(F.coalesce("rater2", F.lit("none")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == second).alias("agree")).withColumn("share", F.col("agree") / F.col("n"))


def effective_n(rows: DataFrame, approx: bool = False) -> DataFrame:
    """One row: rows, different hashes and (problem, operator) cells; with approx from sketches, in one pass of bounded state."""
    count = F.approx_count_distinct if approx else F.countDistinct
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), count("hash").alias("n_hashes"), (count(F.struct("problem_id", "op_id")) if approx else F.countDistinct("problem_id", "op_id")).alias("n_cells"))


def assign_ids(rows: DataFrame, order: list[str], source: str = "source") -> DataFrame:
    """SOURCE-000001 and on, by order within each source, which is cut into ranges."""
    out = numbered(rows, (source,), order, "__nth")
    return out.withColumn("new_id", F.format_string("%s-%06d", F.col(source), F.col("__nth"))).drop("__nth")


def feature_dropout(rows: DataFrame, id: str, columns: list[str], rate: float = 0.15, seed: int = 42) -> DataFrame:
    """The columns are nulled in the rows that a hash of id and seed picks."""
    hit = bucket(seed, F.col(id).cast("string")) < rate
    return rows.withColumns({c: F.when(~hit, F.col(c)) for c in columns})


def mask_groups(rows: DataFrame, keep: set[str], groups: dict[str, str]) -> DataFrame:
    """Columns of groups that are not kept become null; groups: column to group."""
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c, g in groups.items() if g not in keep})


def allowed_ops(ops: DataFrame, problems: DataFrame) -> DataFrame:
    """(problem_id, op_id) where one of the problem's globs fits the operator; a glob without a star is an equality."""
    globs = problems.select("problem_id", F.explode("allowed_ops").alias("glob")).distinct()
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("glob", r"([.+()\[\]{}|^$])", r"\\$1"), r"\*", ".*"), F.lit("$"))
    # operators and globs are small vocabularies that meet through the first letters, which a glob fixes
    head = F.substring_index("glob", "*", 1)
    left = globs.withColumn("k", F.substring(head, 1, 2)).withColumn("pattern", pattern)
    right = ops.select("op_id").distinct().withColumn("k", F.explode(F.array_distinct(F.array(F.substring("op_id", 1, 2), F.substring("op_id", 1, 1), F.lit("")))))
    return left.join(right, "k").filter(F.expr("op_id rlike pattern")).select("problem_id", "op_id").distinct()


def dataset_card(rows: DataFrame) -> DataFrame:
    """(section, key, n): counts by label, source, problem, label and source; distinct rows, hashes and (problem, op)."""
    sets = rows.groupingSets([["label"], ["source"], ["problem_id"], ["label", "source"], []], "label", "source", "problem_id").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "label").when(F.col("g") == 5, "source").when(F.col("g") == 6, "problem").when(F.col("g") == 1, "label_source").otherwise("rows")
    card = sets.select(name.alias("section"), F.concat_ws("|", "label", "source", "problem_id").alias("key"), "n")
    distinct = rows.agg(F.countDistinct("hash").alias("hash"), F.countDistinct("problem_id", "op_id").alias("cell"))
    return card.unionByName(distinct.select(F.lit("distinct_hash").alias("section"), F.lit("").alias("key"), F.col("hash").alias("n"))).unionByName(distinct.select(F.lit("distinct_cell").alias("section"), F.lit("").alias("key"), F.col("cell").alias("n")))
