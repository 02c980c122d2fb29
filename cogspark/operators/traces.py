"""Execution logs to features: tests, events, steps and frames of each attempt, compared with a reference run.

Inputs are logs: per_test (attempt_id, test, status, passed, returned, expected, iterations, max_depth), events
(attempt_id, test, ord, type, line), steps (attempt_id, test, i, line, depth, call, arg, cell, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from .shared import broadcast_if_small, written

RUN = ("attempt_id", "test")
EVENTS = ["step_cap", "uninit_read", "oob_eq_n", "oob_negative", "int_division", "empty_body", "assign_in_condition", "missing_return", "depth_cap", "discarded_result", "string_compare", "array_compare", "overflow"]


def pass_features(per_test: DataFrame) -> DataFrame:
    """(attempt_id, tests, pass_fraction, any_crash, any_timeout)."""
    on = lambda s: F.max((F.col("status") == s).cast("int"))
    return per_test.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("tests"), F.avg(F.col("passed").cast("double")).alias("pass_fraction"), on("crash").alias("any_crash"), on("timeout").alias("any_timeout"))


def event_flags(events: DataFrame, kinds: list[str]) -> DataFrame:
    """(attempt_id, flag_…, line_…) for each kind: whether it occurs, and the line of its first occurrence."""
    aggs = []
    for k in kinds:
        hit = F.col("type") == k
        aggs += [F.max(hit.cast("int")).alias(f"flag_{k}"), F.min_by(F.when(hit, F.col("line")), F.when(hit, F.struct("test", "ord"))).alias(f"line_{k}")]
    return events.groupBy("attempt_id").agg(*aggs)


def by_test(runs: DataFrame, reference: DataFrame) -> list[str]:
    """The columns on which a run meets its problem's reference: problem_id and test, or test alone in logs of one problem."""
    return ["problem_id", "test"] if "problem_id" in runs.columns and "problem_id" in reference.columns else ["test"]


def iteration_deltas(per_test: DataFrame, reference: DataFrame) -> DataFrame:
    """(attempt_id, mean_delta, always_plus_one, always_minus_one, early_share) against the reference's iterations of the same problem and test.

    early_share: of the tests in which the reference ran twice or more, those that came to their end (status ok) after
    exactly one iteration; 0 without such tests.
    """
    on = by_test(per_test, reference)
    rows = per_test.join(reference.select(*on, F.col("iterations").alias("r")), on).withColumn("d", F.col("iterations") - F.col("r"))
    early = F.coalesce((F.col("status") == "ok") & (F.col("iterations") == 1), F.lit(False)).cast("double")
    return rows.groupBy("attempt_id").agg(F.avg("d").alias("mean_delta"), F.min((F.col("d") == 1).cast("int")).alias("always_plus_one"), F.min((F.col("d") == -1).cast("int")).alias("always_minus_one"), F.coalesce(F.avg(F.when(F.col("r") >= 2, early)), F.lit(0.0)).alias("early_share"))


def branch_features(branches: DataFrame, reference: DataFrame) -> DataFrame:
    """(attempt_id, always, never, always_line, never_line): lines taken twice or more and only one way, where any line of the problem's reference goes both ways.

    branches: (attempt_id, line, t, f) and, where the logs are of several problems, problem_id in both; a null line is an
    attempt without recorded branches, which has neither. Of several such lines the first one recorded is named: by
    `ord` where branches has it, else by line.
    """
    several = "problem_id" in branches.columns and "problem_id" in reference.columns
    of = ["problem_id"] if several else []
    first = F.min("ord") if "ord" in branches.columns else F.min(F.col("line").cast("long"))
    sums = branches.groupBy("attempt_id", *of, "line").agg(F.sum("t").alias("t"), F.sum("f").alias("f"), first.alias("ord"))
    both = reference.groupBy(*of, "line").agg(F.sum("t").alias("rt"), F.sum("f").alias("rf")).groupBy(*of).agg(F.coalesce(F.bool_or((F.col("rt") > 0) & (F.col("rf") > 0)), F.lit(False)).alias("varies"))
    rows = sums.join(broadcast_if_small(both), of, "left") if several else sums.withColumn("varies", both.scalar())
    one = lambda a, b: F.coalesce(F.col("varies"), F.lit(False)) & F.col("line").isNotNull() & (F.col(a) >= 2) & (F.col(b) == 0)
    found = rows.groupBy("attempt_id").agg(F.min_by("line", F.when(one("t", "f"), F.struct("ord", "line"))).alias("always_line"), F.min_by("line", F.when(one("f", "t"), F.struct("ord", "line"))).alias("never_line"))
    return found.select("attempt_id", F.col("always_line").isNotNull().cast("int").alias("always"), F.col("never_line").isNotNull().cast("int").alias("never"), "always_line", "never_line")


def counters(per_test: DataFrame, maps: str) -> DataFrame:
    """(attempt_id, key, total) of a MAP column summed over tests."""
    return per_test.select("attempt_id", F.explode(maps).alias("key", "v")).groupBy("attempt_id", "key").agg(F.sum("v").alias("total"))


def is_garbage(x: Column) -> Column:
    """A value that was never written, or one computed from it by small steps."""
    return F.coalesce(F.abs(x - C.GARBAGE) <= C.GARBAGE_BAND, F.lit(False))


def relation_features(outputs: DataFrame) -> DataFrame:
    """Shares of an attempt's failed tests whose output stands in a known relation to the expected one.

    outputs: (attempt_id, test, got DOUBLE, want DOUBLE) and, where present, args ARRAY<DOUBLE> (whole numbers, if no
    sequence is passed), items, array and want_array ARRAY<DOUBLE> (a sequence that went in, came out, was expected).
    floored: got is the wanted fraction cut towards zero; top_frame: got is what the outermost call alone would give (an
    argument, the last digit of the only one, or the sequence's last item); unchanged: the array came back as it was,
    though another was wanted; shifted: its items moved by one and the end was not brought round.
    """
    has = set(outputs.columns)
    col = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind)
    got, want = F.col("got"), F.col("want")
    args, items, array, want_array = (col(c, "array<double>") for c in ("args", "items", "array", "want_array"))
    near = lambda a, b: F.coalesce(F.abs(a - b) <= 1e-9, F.lit(False))
    same = lambda a, b: F.coalesce((F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= 1e-9), lambda x: x), F.lit(False))
    whole = F.when(want >= 0, F.floor(want)).otherwise(F.ceil(want))
    digit = F.when((F.size(args) == 1) & (args[0] >= 10), args[0] % 10)
    own = F.coalesce(F.exists(args, lambda x: near(got, x)), F.lit(False)) | near(got, digit) | near(got, F.element_at(items, F.size(items)))
    moved = same(array, F.concat(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, F.size(items), 1))) | same(array, F.concat(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 2, 1)))
    share = lambda x: F.avg(F.coalesce(x, F.lit(False)).cast("double"))
    failed = F.when(want.isNull(), ~same(array, want_array)).otherwise(got.isNull() | (F.abs(got - want) > 1e-9))
    return outputs.filter(failed).groupBy("attempt_id").agg(
        F.count(F.lit(1)).alias("failed"),
        share(near(F.abs(got - want), F.lit(1.0))).alias("off_by_one"),
        share((got == 0) & (want != 0)).alias("zero"),
        share(near(got, whole) & ~near(want, whole)).alias("floored"),
        share(is_garbage(got) | F.exists(array, is_garbage)).alias("garbage"),
        share(own).alias("top_frame"),
        share(want_array.isNotNull() & same(array, items) & ~same(want_array, items)).alias("unchanged"),
        share(want_array.isNotNull() & (F.size(items) >= 2) & moved).alias("shifted"),
    )


def reference_relations(outputs: DataFrame, reference_outputs: DataFrame) -> DataFrame:
    """(attempt_id, transform, share): of failed tests, how often the output equals the reference's under a transform of the input."""
    bad = outputs.filter((F.abs(F.col("got") - F.col("want")) > 1e-9))
    n = bad.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("n"))
    hits = bad.join(reference_outputs, by_test(outputs, reference_outputs)).filter(F.abs(F.col("got") - F.col("out")) <= 1e-9).groupBy("attempt_id", "transform").agg(F.countDistinct("test").alias("k"))
    return hits.join(n, "attempt_id").select("attempt_id", "transform", (F.col("k") / F.col("n")).alias("share"))


def frozen_passes(passes: DataFrame, by=RUN) -> DataFrame:
    """Adds frozen: a pass whose variables equal those of the pass before. passes: (by…, pass, vars STRING)."""
    return passes.withColumn("frozen", F.coalesce(F.col("vars") == F.lag("vars").over(W.partitionBy(*by).orderBy("pass")), F.lit(False)))


def segment_passes(steps: DataFrame, header: Column, by=RUN) -> DataFrame:
    """Adds pass: the number of header lines met so far in a run."""
    return steps.withColumn("pass", F.sum(header.cast("int")).over(W.partitionBy(*by).orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)))


def islands(steps: DataFrame, value: str, by=RUN) -> DataFrame:
    """(by…, island, value, first, last, n): runs of equal values in order of i."""
    w = W.partitionBy(*by).orderBy("i")
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    rows = steps.withColumn("__new", new.cast("int")).withColumn("island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.groupBy(*by, "island", value).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("n"))


def call_stack(frames: DataFrame, by=RUN) -> DataFrame:
    """Adds parent, same_arg and growing_arg: the latest earlier frame one level up. frames: (by…, i, depth, arg).

    Each frame is put beside those of the level above; there the last one before it is its parent.
    """
    as_child = frames.select(*by, (F.col("depth") - 1).alias("level"), "i", "depth", "arg", F.lit(True).alias("child"))
    as_parent = frames.select(*by, F.col("depth").alias("level"), "i", "depth", "arg", F.lit(False).alias("child"))
    before = W.partitionBy(*by, "level").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    up = F.last(F.when(~F.col("child"), F.struct(F.col("i").cast("long").alias("i"), F.col("arg").cast("long").alias("arg"))), ignorenulls=True).over(before)
    rows = as_child.unionByName(as_parent).withColumn("up", up).filter("child")
    arg = F.col("arg").cast("long")
    return rows.select(*by, F.col("i").cast("long").alias("i"), F.col("depth").cast("int").alias("depth"), arg.alias("arg"), F.col("up.i").alias("parent"), F.coalesce(F.col("up.arg") == arg, F.lit(False)).alias("same_arg"), F.coalesce(arg > F.col("up.arg"), F.lit(False)).alias("growing_arg"))


def call_table(frames: DataFrame, most: int = 12, by=RUN) -> DataFrame:
    """(by…, rows, more): the first `most` calls with their flags, and "...+N" for what is left out.

    frames: (by…, i, depth, arg, returned, used): whether the call came to its end, and whether its value was taken.
    no_base: a call that went no deeper and never returned; dropped_value: a value that returned and was not taken.
    """
    stack = call_stack(frames, by)
    deeper = stack.filter("parent is not null").select(*by, F.col("parent").alias("i")).distinct().withColumn("deeper", F.lit(True))
    rows = stack.join(frames.select(*by, F.col("i").cast("long").alias("i"), "returned", "used"), [*by, "i"]).join(deeper, [*by, "i"], "left")
    row = F.struct("i", "depth", "arg", "same_arg", "growing_arg", (F.col("deeper").isNull() & ~F.col("returned")).alias("no_base"), (F.col("returned") & ~F.col("used")).alias("dropped_value"))
    ranked = rows.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("i")))
    g = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("n") <= most, row))).alias("rows"), F.count(F.lit(1)).alias("n"))
    return g.select(*by, "rows", F.when(F.col("n") > most, F.concat(F.lit("...+"), (F.col("n") - most).cast("string"))).alias("more"))


def recursion_features(frames: DataFrame, reference_depth: DataFrame, by=RUN) -> DataFrame:
    """(by…, depth_ratio, arg_constant, arg_growing, base_return): frames (by…, i, depth, arg, returned); reference_depth (test, depth).

    frames may have fn, the function (a call's caller is a call of the same function), args, all arguments in place of
    arg, ok, whether the run came to its end, and problem_id, if the reference has it too. arg_constant: a call has its
    caller's arguments. arg_growing: there are two such pairs or more, and one argument is larger than the caller's in
    all of them. base_return: a call that went no deeper returned, or the run came to its end and nothing ever returned
    a value.
    """
    has = set(frames.columns)
    on = by_test(frames, reference_depth)
    key = list(dict.fromkeys([*by, *on]))
    args = F.col("args") if "args" in has else F.array("arg")
    each = frames.select(*key, F.col("i").cast("long").alias("i"), "depth", args.alias("args"), (F.col("fn") if "fn" in has else F.lit("")).alias("fn"), "returned", (F.col("ok") if "ok" in has else F.lit(False)).alias("ok"))
    # each call beside those one level up: the last one before it is its caller, if of the same function
    before = W.partitionBy(*key, "level").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    child = each.select("*", (F.col("depth") - 1).alias("level"), F.lit(True).alias("child"))
    both = child.unionByName(each.select("*", F.col("depth").alias("level"), F.lit(False).alias("child")))
    up = F.last(F.when(~F.col("child"), F.struct("i", "args", "fn")), ignorenulls=True).over(before)
    stack = both.withColumn("up", up).filter("child").withColumn("up", F.when(F.col("up.fn") == F.col("fn"), F.col("up")))
    deeper = stack.filter("up is not null").select(*key, F.col("up.i").alias("i")).distinct().withColumn("deeper", F.lit(True))
    rows = stack.join(deeper, [*key, "i"], "left")
    inner = F.col("up").isNotNull()
    larger = F.when(inner, F.transform(F.arrays_zip(F.col("args").alias("a"), F.col("up.args").alias("b")), lambda x: F.coalesce(x["a"] > x["b"], F.lit(False))))
    width = F.min(F.when(inner, F.size("up.args")))
    n_args = 8  # arguments that are told apart
    g = rows.withColumn("larger", larger).groupBy(*key).agg(
        F.max("depth").alias("d"),
        F.bool_or(inner & F.col("args").eqNullSafe(F.col("up.args")) & ~F.exists("args", lambda x: x.isNull())).alias("arg_constant"),
        F.count_if(inner).alias("k"),
        width.alias("width"),
        F.array(*[F.coalesce(F.bool_and(F.when(inner, F.coalesce(F.get("larger", F.lit(i)), F.lit(False)))), F.lit(False)) for i in range(n_args)]).alias("all"),
        F.bool_or(F.col("deeper").isNull() & F.coalesce("returned", F.lit(False))).alias("leaf"),
        F.bool_or(F.coalesce("returned", F.lit(False))).alias("any"),
        F.bool_or(F.coalesce("ok", F.lit(False))).alias("ok"),
    )
    ref = broadcast_if_small(reference_depth.select(*on, F.greatest("depth", F.lit(1)).alias("__r")))
    growing = (F.col("k") >= 2) & F.exists(F.slice("all", 1, F.greatest(F.coalesce("width", F.lit(0)), F.lit(1))), lambda x: x)
    return g.join(ref, on).select(*by, (F.col("d") / F.col("__r")).alias("depth_ratio"), "arg_constant", growing.alias("arg_growing"), (F.col("leaf") | (F.col("ok") & ~F.col("any"))).alias("base_return"))


def body_once(steps: DataFrame, reference: DataFrame, by=RUN) -> DataFrame:
    """(by…, body_once): a run whose lines outside loop headers ran once at most, where the reference's main loop ran twice or more.

    steps: (by…, line, is_header), of the test that is shown; reference: (test, iterations); problem_id in both, where there are several.
    """
    on = by_test(steps, reference)
    key = list(dict.fromkeys([*by, *on]))
    lines = steps.filter(~F.col("is_header")).groupBy(*key, "line").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.max("n").alias("n"))
    return lines.join(broadcast_if_small(reference.select(*on, "iterations")), on).select(*by, ((F.col("n") <= 1) & (F.col("iterations") >= 2)).alias("body_once"))


def output_features(outputs: DataFrame) -> DataFrame:
    """(attempt_id, returned_garbage, printed_nonempty, printed_eq_return, wanted): what came back and what was printed.

    outputs: (attempt_id, test, returned DOUBLE, printed STRING, wanted DOUBLE). printed_eq_return: the share of tests with
    a wanted value where that was printed instead, 0 without such tests.
    """
    text = F.trim(F.coalesce("printed", F.lit("")))
    hit = F.coalesce(F.abs(text.try_cast("double") - F.col("wanted")) <= 1e-9, F.lit(False))
    return outputs.groupBy("attempt_id").agg(F.bool_or(is_garbage(F.col("returned"))).alias("returned_garbage"), F.bool_or(F.coalesce("printed", F.lit("")) != "").alias("printed_nonempty"), F.coalesce(F.avg(F.when(F.col("wanted").isNotNull(), hit.cast("double"))), F.lit(0.0)).alias("printed_eq_return"), F.count("wanted").alias("wanted"))


def outer_passes(loops: DataFrame, reference: DataFrame) -> DataFrame:
    """(attempt_id, ratio): passes of the outer loop over all tests by the reference's; a single loop is one pass for each test it ran in.

    loops: (attempt_id, test, outer, main), iterations or null where there is no such loop; reference: (outer) for each
    test; problem_id in both, where there are several.
    """
    several = "problem_id" in loops.columns and "problem_id" in reference.columns
    own = F.sum(F.when(F.col("outer").isNotNull(), F.col("outer")).when(F.col("main") >= 1, 1).otherwise(0))
    if several:
        total = broadcast_if_small(reference.groupBy("problem_id").agg(F.sum("outer").alias("__t")))
        rows = loops.groupBy("attempt_id", "problem_id").agg(own.alias("n")).join(total, "problem_id", "left")
    else:
        rows = loops.groupBy("attempt_id").agg(own.alias("n")).withColumn("__t", reference.agg(F.sum("outer")).scalar())
    return rows.select("attempt_id", F.when(F.col("__t") > 0, F.col("n") / F.col("__t")).alias("ratio"))


def memory_strip(writes: DataFrame, by=RUN) -> DataFrame:
    """Adds old and changed to writes (by…, i, cell, value): what the cell held before."""
    w = W.partitionBy(*by, "cell").orderBy("i")
    return writes.withColumn("old", F.lag("value").over(w)).withColumn("changed", ~F.col("value").eqNullSafe(F.col("old")))


def window_strip(passes: DataFrame, most: int = 12, by=RUN) -> DataFrame:
    """(by…, rows, more): passes of the main loop with their window, how mid compares with the target, and `frozen`.

    passes: (by…, pass, low, mid, high, mid_value, target); frozen: low and high as in the pass before.
    """
    w = W.partitionBy(*by).orderBy("pass")
    same = F.coalesce((F.lag("low").over(w) == F.col("low")) & (F.lag("high").over(w) == F.col("high")), F.lit(False))
    cmp = F.when(F.col("mid_value") == F.col("target"), "==").when(F.col("mid_value") < F.col("target"), "<").when(F.col("mid_value") > F.col("target"), ">")
    rows = passes.filter("mid is not null").withColumns({"n": F.row_number().over(w), "cmp": cmp}).withColumn("flag", F.when(same, "frozen"))
    row = F.struct("pass", "low", "mid", "high", "cmp", "mid_value", "flag")
    g = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("n") <= most, row))).alias("rows"), F.count(F.lit(1)).alias("n"))
    return g.select(*by, "rows", F.when(F.col("n") > most, F.concat(F.lit("...+"), (F.col("n") - most).cast("string"))).alias("more"))


def memory_flags(writes: DataFrame, initial: DataFrame, by=RUN) -> DataFrame:
    """Adds flag to writes (by…, i, cell, value): the last write over a value that the array has lost, the last of a value it has too often.

    initial: (by…, cell, value), the array before. lost comes before duplicate.
    """
    first = initial.select(*by, "cell", F.lit(-1).cast("long").alias("i"), "value")
    every = writes.select(*by, "cell", F.col("i").cast("long").alias("i"), "value").unionByName(first)
    old = memory_strip(every, by)
    end = every.groupBy(*by, "cell").agg(F.max_by("value", "i").alias("value")).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("after"))
    begin = initial.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("before"))
    both = begin.join(end, [*by, "value"], "full_outer").fillna(0, ["before", "after"])
    lost, twice = both.filter("after < before").select(*by, F.col("value").alias("old"), F.lit(True).alias("is_lost")), both.filter("after > before").select(*by, "value", F.lit(True).alias("is_twice"))
    rows = old.filter("i >= 0").join(lost, [*by, "old"], "left").join(twice, [*by, "value"], "left")
    last = lambda key, on: F.max(F.when(on, F.col("i"))).over(W.partitionBy(*by, key))
    rows = rows.withColumn("flag", F.when(F.col("is_lost") & (F.col("i") == last("old", F.col("is_lost"))), "lost"))
    free = F.col("is_twice") & F.col("flag").isNull()
    return rows.withColumn("flag", F.coalesce("flag", F.when(free & (F.col("i") == last("value", free)), "duplicate"))).select(*by, "i", "cell", "old", "value", "flag")


def final_memory(writes: DataFrame, by=RUN) -> DataFrame:
    """(by…, cell, value): the last value written to each cell."""
    return writes.groupBy(*by, "cell").agg(F.max_by("value", "i").alias("value"))


def array_features(arrays: DataFrame) -> DataFrame:
    """(id, same_multiset, sorted_fraction): before and after arrays compared; arrays shorter than 2 have no sorted_fraction."""
    pairs = F.zip_with(F.slice("after", 1, F.greatest(F.size("after") - 1, F.lit(0))), F.slice("after", 2, F.greatest(F.size("after") - 1, F.lit(0))), lambda a, b: F.coalesce(a <= b, F.lit(False)).cast("double"))
    share = F.when(F.size("after") > 1, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / (F.size("after") - 1))
    return arrays.select("id", (F.array_sort("before") == F.array_sort("after")).alias("same_multiset"), share.alias("sorted_fraction"))


def sorted_share(arrays: DataFrame) -> DataFrame:
    """(attempt_id, sorted_fraction): the mean over an attempt's tests, those with shorter arrays left out. arrays: (attempt_id, id, before, after)."""
    rows = array_features(arrays.withColumn("id", F.struct("attempt_id", "id")))
    return rows.groupBy(F.col("id.attempt_id").alias("attempt_id")).agg(F.avg("sorted_fraction").alias("sorted_fraction"))


def timeline_rows(steps: DataFrame, by=RUN) -> DataFrame:
    """Steps that go back a line, change the depth or, where steps has vars, the variables, and the first and last of a run."""
    w = W.partitionBy(*by).orderBy("i")
    end = F.lead("i").over(w).isNull()
    keep = F.lag("i").over(w).isNull() | end | (F.col("line") < F.lag("line").over(w)) | ~F.col("depth").eqNullSafe(F.lag("depth").over(w))
    if "vars" in steps.columns:
        shown = F.to_json("vars") if dict(steps.dtypes)["vars"].startswith("map") else F.col("vars")
        steps, now = steps.withColumn("__v", shown), F.col("__v")
        keep |= ~now.eqNullSafe(F.lag(now).over(w))
    return steps.withColumn("__k", keep).filter("__k").drop("__k", "__v")


def _kind(effect: Column) -> Column:
    """Place of an effect's kind in the order of telling; unknown kinds come last."""
    at = F.array_position(F.lit(C.EFFECT_ORDER), F.split(effect, ":")[0])
    return F.when(at == 0, len(C.EFFECT_ORDER) + 1).otherwise(at)


def _told(steps: DataFrame) -> DataFrame:
    """Adds best, a step's most telling effect as (kind, effect), and its own flags as booleans."""
    effects = F.coalesce("effects", F.array().cast("array<string>"))
    ranked = F.transform(effects, lambda e, k: F.struct(_kind(e).alias("kind"), k.alias("k"), e.alias("effect")))
    event = lambda t: F.array_contains(F.coalesce("events", F.array().cast("array<string>")), t)
    void = F.exists(effects, lambda e: e.startswith("read_void")) | event("oob_read")
    own = {"void_read": void, "static": event("uninit_read"), "overwrite": event("assign_in_cond"), "empty_body": event("empty_body")}
    return steps.withColumns({"best": F.array_min(ranked), **{f"is_{n}": c for n, c in own.items()}})


OWN = ["void_read", "static", "overwrite", "empty_body"]


def _passes(steps: DataFrame, key: list[str]) -> DataFrame:
    """(key…, k, n, prev, last, flagged, best, is_…): each pass of a run, numbered from 0, with its last and first flagged step and what the pass before ended with."""
    told = _told(steps.filter("pass is not null"))
    step = F.struct("i", "line", "vars", "best", "effects")
    flagged = F.greatest(*[F.col(f"is_{n}") for n in OWN])
    by = told.groupBy(*key, "pass").agg(
        F.max_by(step, "i").alias("last"),
        F.min_by(step, F.when(flagged, F.col("i"))).alias("flagged"),
        F.min(F.when(F.col("best").isNotNull(), F.struct(F.col("best.kind").alias("kind"), "i", F.col("best.effect").alias("effect")))).alias("best"),
        *[F.max(f"is_{n}").alias(f"is_{n}") for n in OWN],
    )
    w = W.partitionBy(*key).orderBy("pass")
    return by.withColumns({"k": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(W.partitionBy(*key)), "prev": F.lag("last.vars").over(w)})


def reset_hits(steps: DataFrame, passes: DataFrame, key: list[str]) -> DataFrame:
    """(key…, pass, var, step): the first step of a later pass in which a variable is back at the value it first took in pass 0.

    Only variables that change inside pass 0 and that the loop's header does not name (loop_vars, if steps has it), and
    only where the pass before ended with another value.
    """
    held = steps.filter("pass is not null").join(passes.select(*key, "pass", "k", "prev"), [*key, "pass"])
    skip = F.coalesce("loop_vars", F.array().cast("array<string>")) if "loop_vars" in steps.columns else F.array().cast("array<string>")
    each = held.filter("k = 0").select(*key, "i", skip.alias("skip"), F.posexplode_outer(F.map_entries("vars")).alias("at", "e")).select(*key, "i", "at", "skip", F.col("e.key").alias("var"), F.col("e.value").alias("x"))
    each = each.filter("x is not null").filter(~F.array_contains("skip", F.col("var")))
    init = each.groupBy(*key, "var").agg(F.min_by("x", "i").alias("init"), F.min(F.struct("i", "at")).alias("seen"), F.countDistinct("x").alias("d")).filter("d > 1")
    rows = held.filter("k > 0").join(init, key)
    now, before = F.try_element_at("vars", F.col("var")), F.try_element_at("prev", F.col("var"))
    hit = rows.filter((now == F.col("init")) & before.isNotNull() & (before != F.col("init")))
    step = F.struct("i", "line", "vars", F.col("effects"))
    return hit.groupBy(*key, "pass").agg(F.min_by(F.struct("var", step.alias("step")), F.struct("i", "seen")).alias("h")).select(*key, "pass", "h.var", "h.step")


def timeline(steps: DataFrame, reference: DataFrame | None = None, head: int = 10, tail: int = 2, by=RUN) -> DataFrame:
    """(by…, k, step, line, vars, effect, flag): a row for each pass of a run's main loop, beside the reference's passes.

    steps: (by…, i, line, pass, vars MAP, effects ARRAY<STRING>, events ARRAY<STRING>) and, where known, loop_vars, the
    names in the loop's header; pass is null outside. reference: the same for each problem and test; a run without
    reference rows is judged by itself. A pass shows its first flagged step, else the step in which a variable was
    reset, else its last one. Flags, the first that holds: void_read, static, overwrite, empty_body (of a step), reset
    (a variable goes back to its first value, which the reference's variables never do), early_return (the last pass
    ends with a return before the reference's passes do), extra (a pass that the reference does not have). Passes that
    only the reference has follow as `missing`, with its variables and the learner's numbering. Of more than head + tail
    rows the middle ones go. A run without passes has a row for each step with a flag, an effect or other variables than
    the step before, and for its first and last.
    """
    on = by_test(steps, reference) if reference is not None else []
    key = list(dict.fromkeys([*by, *on]))
    passes = written(_passes(steps, key), "passes")
    hits = reset_hits(steps, passes, key)
    if reference is not None:
        of_ref = written(_passes(reference, on), "reference_passes")
        names = reference.filter("pass is not null").select(*on, F.explode(F.map_keys("vars")).alias("v")).groupBy(*on).agg(F.collect_set("v").alias("ref_vars"))
        back = reset_hits(reference, of_ref, on).groupBy(*on).agg(F.collect_set("var").alias("ref_resets"))
        counts = of_ref.groupBy(*on).agg(F.max("n").alias("rn")).join(names, on, "left").join(back, on, "left")
        passes = passes.join(broadcast_if_small(counts), on, "left")
    else:
        nothing = F.lit(None).cast("array<string>")
        passes = passes.withColumns({"rn": F.lit(None).cast("long"), "ref_vars": nothing, "ref_resets": nothing})
    rows = passes.join(hits.withColumnRenamed("step", "hit"), [*key, "pass"], "left")
    within = lambda names: F.coalesce(F.array_contains(names, F.col("var")), F.lit(False))
    reset = F.col("var").isNotNull() & within("ref_vars") & ~within("ref_resets")
    returns = F.exists(F.coalesce("last.effects", F.array().cast("array<string>")), lambda e: e.startswith("ret:"))
    early = F.coalesce(returns & (F.col("k") + 1 == F.col("n")) & (F.col("n") < F.col("rn")), F.lit(False))
    flag = F.lit(None).cast("string")
    for name, holds in reversed([*[(n, F.col(f"is_{n}")) for n in OWN], ("reset", reset), ("early_return", early), ("extra", F.coalesce(F.col("k") >= F.col("rn"), F.lit(False)))]):
        flag = F.when(holds, name).otherwise(flag)
    plain = lambda s: F.struct(F.col(f"{s}.i").alias("i"), F.col(f"{s}.line").alias("line"), F.col(f"{s}.vars").alias("vars"), F.col(f"{s}.effects").alias("effects"))
    chosen = F.when(F.col("flagged").isNotNull(), plain("flagged")).when(reset, F.col("hit")).otherwise(plain("last"))
    first = lambda e: F.array_min(F.transform(F.coalesce(e, F.array().cast("array<string>")), lambda x, i: F.struct(_kind(x).alias("kind"), i.alias("k"), x.alias("effect"))))["effect"]
    rows = rows.withColumns({"flag": flag, "c": chosen})
    shown = written(rows.select(*key, F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"), F.col("c.i").cast("long").alias("step"), F.col("c.line").alias("line"), F.col("c.vars").alias("vars"), F.coalesce(first(F.col("c.effects")), F.col("best.effect")).alias("effect"), "flag"), "timeline")
    out = shown.drop("n")
    if reference is not None:
        ends = shown.groupBy(*key).agg(F.max_by("step", "k").alias("base"), F.max("n").alias("n"))
        late = of_ref.select(*on, F.col("k").cast("long").alias("k"), "last")
        # the rows of a run are few; a reference that goes on far longer is cut as the middle is
        more = ends.join(broadcast_if_small(late), on).filter("k >= n").filter((F.col("k") == F.col("n")) | (F.col("k") <= C.TIMELINE_MOST))
        out = out.unionByName(more.select(*key, "k", (F.col("base") + F.col("k") - F.col("n") + 1).alias("step"), F.col("last.line").alias("line"), F.col("last.vars").alias("vars"), F.col("last.best.effect").alias("effect"), F.lit("missing").alias("flag")))
    flat = _told(steps.join(passes.select(*key).distinct(), key, "left_anti"))
    w = W.partitionBy(*key).orderBy("i")
    text = F.to_json("vars")
    flat = flat.withColumns({"v": text, "at": F.row_number().over(w)}).withColumns({"was": F.lag("v").over(w), "end": F.lead("i").over(w).isNull()})
    flag = F.lit(None).cast("string")
    for name in reversed(OWN):
        flag = F.when(F.col(f"is_{name}"), name).otherwise(flag)
    flat = flat.filter(F.greatest(*[F.col(f"is_{n}") for n in OWN]) | (F.size(F.coalesce("effects", F.array().cast("array<string>"))) > 0) | ~F.col("v").eqNullSafe(F.col("was")) | (F.col("at") == 1) | F.col("end"))
    flat = flat.select(*key, (F.col("at") - 1).cast("long").alias("k"), F.col("i").cast("long").alias("step"), "line", "vars", F.col("best.effect").alias("effect"), flag.alias("flag"))
    out = out.unionByName(flat)
    w = W.partitionBy(*key).orderBy("k")
    out = out.withColumns({"r": F.row_number().over(w), "t": F.count(F.lit(1)).over(W.partitionBy(*key))})
    return out.filter((F.col("t") <= head + tail) | (F.col("r") <= head) | (F.col("r") > F.col("t") - tail)).select(*by, "k", "step", "line", "vars", "effect", "flag")


def trace_summary(events: DataFrame, per_test: DataFrame) -> DataFrame:
    """(attempt_id, status, events): the worst status, and event types in the order of their first occurrence."""
    first = events.groupBy("attempt_id", "type").agg(F.min(F.struct("test", "ord")).alias("at")).groupBy("attempt_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "type"))), lambda x: x["type"]), ",").alias("events"))
    bad = F.max_by("status", F.when(F.col("status") == "crash", 2).when(F.col("status") == "timeout", 1).otherwise(0))
    return per_test.groupBy("attempt_id").agg(bad.alias("status")).join(first, "attempt_id", "left")


def test_to_show(per_test: DataFrame, display: str = "display") -> DataFrame:
    """(attempt_id, test): the display test if it fails, else the first that fails, else the first that differs from the reference, else the display test."""
    rank = F.when(F.col(display) & ~F.col("passed"), 0).when(~F.col("passed"), 1).when(F.col("signature") != F.col("reference_signature"), 2).when(F.col(display), 3).otherwise(4)
    return per_test.groupBy("attempt_id").agg(F.min_by("test", F.struct(rank, "test")).alias("test"))


def main_loop(loops: DataFrame) -> DataFrame:
    """(attempt_id, line): most iterations, ties to the outermost, then the first."""
    return loops.groupBy("attempt_id").agg(F.max_by("line", F.struct("iterations", -F.col("depth"), -F.col("line"))).alias("line"))


def task_features(problems: DataFrame) -> DataFrame:
    """(problem_id, has_array, has_size, returns_void, n_params) from a signature."""
    inside = F.regexp_extract("signature", r"\((.*)\)", 1)
    return problems.select("problem_id", F.col("signature").rlike(r"\[\]|\*").alias("has_array"), inside.rlike(r"\bint (n|size|len)\b").alias("has_size"), F.col("signature").rlike(r"^\s*void\b").alias("returns_void"), F.when(F.trim(inside).isin("", "void"), 0).otherwise(F.size(F.split(inside, ","))).alias("n_params"))


def trace_features(per_test: DataFrame, events: DataFrame, reference: DataFrame, kinds: list[str]) -> DataFrame:
    """One row for each attempt with all the above that these logs allow."""
    return pass_features(per_test).join(event_flags(events, kinds), "attempt_id", "left").join(iteration_deltas(per_test, reference), "attempt_id", "left")
