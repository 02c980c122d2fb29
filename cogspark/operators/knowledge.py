"""Knowledge tracing: from answers to P(misconception active) and mastery states for each learner and class.

Every update is a 2x2 matrix on the pair (active, not active), so a history is an ordered product; likelihood ratios
alone are a sum of logarithms and need no order. The state machine depends on order and is folded over each key's
sorted history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.columns import forget, is_transfer_family, item_ratios, let, likelihood_ratio, two_digits
from .bayes import apply_text
from .shared import changes, written

KEY = ("learner_id", "class")


def route_events(events: DataFrame) -> DataFrame:
    """Adds if_active and if_not to each event, `affects`, whether it changes P at all, and the resolved kind.

    kind, correct, hint are read; where present also planted, top1, tests_pass, posterior, exposure, matched, unsure,
    p_text and in_belief (a predicted output that the class's belief names counts as a trap).
    """
    has = set(events.columns)
    col = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind)
    kind = F.when((F.col("kind") == "predict_output") & F.coalesce(col("in_belief", "boolean"), F.lit(False)), "predict_output_trap").otherwise(F.col("kind"))
    hint = F.coalesce(col("hint", "boolean"), F.lit(False))
    correct = F.coalesce(col("correct", "boolean"), F.lit(False))
    exposure = F.coalesce(col("exposure", "double"), F.lit(C.FAIL_IF_ACTIVE))
    planted, top1 = col("planted", "string"), col("top1", "string")
    active, not_ = item_ratios(kind, correct, hint)
    passed = F.coalesce(col("tests_pass", "boolean"), correct)
    fix_hit = F.when(passed, F.col("class") == planted).otherwise((top1 == planted) & (F.col("class") == planted))
    fix_other = ~passed & top1.isin(C.MISCONCEPTIONS) & (top1 != planted) & (col("posterior", "double") >= C.ACTIVE_P) & (F.col("class") == top1)
    text = ~F.coalesce(col("unsure", "boolean"), F.lit(False)) & F.coalesce(col("matched", "boolean"), F.lit(False)) & (col("p_text", "double") >= C.TEXT_MATCH_P)
    fail = F.lit(C.FAIL_IF_NOT)
    fix_active, fix_not = item_ratios(F.lit("fix_bug"), passed, hint)

    def pick(signature, latent, words, fix, own):
        return (
            F.when(kind == "signature_failure", signature)
            .when(kind == "latent_pass", latent)
            .when(kind.isin("why", "reasoning"), F.when(text, F.lit(words)))
            .when(kind == "debug_line", F.when(planted.isNotNull(), own))
            .when(kind == "complete_snippet", F.when(correct, own))
            .when(kind == "fix_bug", F.when(fix_hit, fix).when(fix_other, signature))
            .when(kind.isin(*C.KIND_ROW), own)
        )

    out = events.withColumns({"resolved": kind, "if_active": pick(exposure, exposure * C.LATENT_FACTOR, C.TEXT_IF_ACTIVE, fix_active, active), "if_not": pick(fail, fail, C.TEXT_IF_NOT, fix_not, not_)})
    return out.withColumn("affects", F.col("if_active").isNotNull() | F.col("kind").isin("intervention_done", "forgetting"))


def attempt_updates(attempts: DataFrame) -> DataFrame:
    """Attempts that change knowledge: (learner_id, class, ts, seq, kind, exposure)."""
    whole = (F.col("total") > 0) & (F.col("passed") == F.col("total"))
    failed = ~whole & F.col("top").isin(C.MISCONCEPTIONS) & F.col("status").isin("confident", "two_bug") & (F.col("top_p").isNull() | (F.col("top_p") >= C.ACTIVE_P))
    latent = whole & F.col("latent").isin(C.MISCONCEPTIONS)
    out = attempts.withColumn("kind", F.when(failed, "signature_failure").when(latent, "latent_pass")).filter("kind is not null")
    return out.select("learner_id", F.when(F.col("kind") == "signature_failure", F.col("top")).otherwise(F.col("latent")).alias("class"), "ts", F.col("attempt_id").alias("seq"), "kind", "exposure")


def knowledge_ratios(events: DataFrame, prior: float = C.POPULATION_PRIOR, by=KEY) -> DataFrame:
    """(by…, p_active, times_seen, last_tested) of histories with likelihood ratios only: one partial aggregation, no order."""
    rows = route_events(events).filter("if_active is not null")
    # a zero numerator or denominator is counted rather than summed
    logit = F.log(F.lit(prior / (1 - prior))) + F.sum(F.log(F.col("if_active") / F.col("if_not")))
    return rows.groupBy(*by).agg((1 / (1 + F.exp(-logit))).alias("p_active"), F.count(F.lit(1)).alias("times_seen"), F.max("ts").alias("last_tested"))


def _history(rows: DataFrame, by, *cols: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ts", "seq", *cols))).alias("history"))


def _step(p: Column, e: Column) -> Column:
    return F.when(e["kind"] == "intervention_done", p * (1 - C.LEARN_RATE)).when(e["kind"] == "forgetting", forget(p, e["levels"])).when(e["if_active"].isNotNull(), likelihood_ratio(p, e["if_active"], e["if_not"])).otherwise(p)


def knowledge_fold(events: DataFrame, prior: float = C.POPULATION_PRIOR, as_of: Column | None = None, by=KEY) -> DataFrame:
    """(by…, p_active, times_seen, last_tested) after each key's history, with interventions and forgetting in order."""
    rows = route_events(events if as_of is None else events.filter(F.col("ts") <= as_of))
    rows = rows.withColumn("levels", F.col("levels").cast("int")) if "levels" in rows.columns else rows.withColumn("levels", F.lit(0))
    past = _history(rows.filter("affects"), by, "kind", "levels", "if_active", "if_not")
    p = F.aggregate("history", F.lit(float(prior)), _step)
    answers = F.filter("history", lambda e: e["if_active"].isNotNull())
    return past.select(*by, p.alias("p_active"), F.size(answers).cast("long").alias("times_seen"), F.array_max(F.transform("history", lambda e: e["ts"])).alias("last_tested"))


def _matrix() -> dict[str, Column]:
    """a, b, c, d of an event's matrix on (active, not active), from kind, levels, if_active and if_not."""
    stay = F.pow(F.lit(1 - C.FORGET_RATE), F.greatest(F.col("levels"), F.lit(0)))
    zero, one = F.lit(0.0), F.lit(1.0)
    lose = F.col("kind") == "intervention_done"
    gain = F.col("kind") == "forgetting"
    none = (F.col("if_active") == 0) & (F.col("if_not") == 0)  # evidence that is impossible either way says nothing
    return {
        "a": F.when(lose, 1 - C.LEARN_RATE).when(gain, one).when(none, one).otherwise(F.col("if_active")),
        "b": F.when(gain, 1 - stay).otherwise(zero),
        "c": F.when(lose, C.LEARN_RATE).otherwise(zero),
        "d": F.when(lose, one).when(gain, stay).when(none, one).otherwise(F.col("if_not")),
    }


def belief_product(events: DataFrame, prior: float = C.POPULATION_PRIOR, chunk: int = 256, by=KEY) -> DataFrame:
    """The same p_active by matrix products of chunks of each history, so that a hot key's history is folded in parts."""
    rows = route_events(events).filter("affects")
    rows = rows.withColumn("levels", F.col("levels").cast("int")) if "levels" in rows.columns else rows.withColumn("levels", F.lit(0))
    rows = rows.withColumns(_matrix())
    order = W.partitionBy(*by, "slice").orderBy("ts", "seq")
    # slices of a key by time: one row each is shuffled on
    rows = rows.withColumn("slice", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400 / 30)).withColumn("chunk", F.floor((F.row_number().over(order) - 1) / chunk))
    zero, one = F.lit(0.0), F.lit(1.0)
    unit = F.struct(one.alias("a"), zero.alias("b"), zero.alias("c"), one.alias("d"))

    def times(s, e):  # e after s, scaled to keep the product in range
        cells = [e["a"] * s["a"] + e["b"] * s["c"], e["a"] * s["b"] + e["b"] * s["d"], e["c"] * s["a"] + e["d"] * s["c"], e["c"] * s["b"] + e["d"] * s["d"]]
        return let(F.array(*cells), lambda x: let(F.greatest(F.array_max(x), F.lit(1e-300)), lambda t: F.struct(*[(x[i] / t).alias(n) for i, n in enumerate("abcd")])))

    part = rows.groupBy(*by, "slice", "chunk").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "a", "b", "c", "d"))).alias("h")).withColumn("m", F.aggregate("h", unit, times))
    whole = part.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("slice", "chunk", "m"))).alias("h")).withColumn("m", F.aggregate(F.transform("h", lambda x: x["m"]), unit, times))
    on, off = F.col("m.a") * prior + F.col("m.b") * (1 - prior), F.col("m.c") * prior + F.col("m.d") * (1 - prior)
    return whole.select(*by, (on / (on + off)).alias("p_active"))


def _times(e: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Rows of 2x2 matrices (a, b, c, d): e after s, scaled to keep the products in range."""
    out = np.stack([e[:, 0] * s[:, 0] + e[:, 1] * s[:, 2], e[:, 0] * s[:, 1] + e[:, 1] * s[:, 3], e[:, 2] * s[:, 0] + e[:, 3] * s[:, 2], e[:, 2] * s[:, 1] + e[:, 3] * s[:, 3]], 1)
    return out / np.maximum(out.max(1, keepdims=True), 1e-300)


_UNIT = np.array([1.0, 0.0, 0.0, 1.0])


def prefix_products(m: np.ndarray, new: np.ndarray, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the product of what lies before each row of its run, the product up to the last row); carry goes before the first run.

    The span that a row's product covers doubles with each step.
    """
    m = m.copy()
    begin = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
    if not new[0]:
        m[:1] = _times(m[:1], carry[None])
    step, place = 1, np.arange(len(m)) - begin
    while step <= place.max():
        at = np.flatnonzero(place >= step)
        m[at] = _times(m[at], m[at - step])
        step *= 2
    before = np.vstack([carry[None], m[:-1]])
    before[new] = _UNIT
    return before, m[-1]


def _scanned(rows: DataFrame, by, order) -> DataFrame:
    """rows (with a, b, c, d) in ranges of (by, order), with p0..p3, the product of what lies before each row in its range.

    Adds part, the range; opens, whether the row's key is the first of its range; edge, whether it is the last row of the
    first or of the last key of its range: two rows a range.
    """
    n = len(by)
    names = [*rows.columns, "p0", "p1", "p2", "p3", "part", "opens", "edge"]
    at = [rows.columns.index(c) for c in "abcd"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry, opens, held = TaskContext.get().partitionId(), None, _UNIT, True, None

        def out(batch, before, first, edge):
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(before[:, i]) for i in range(4)), pa.array(np.full(len(first), part, np.int32)), pa.array(first), pa.array(edge)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            known = last is not None
            new, last = changes(batch.columns[:n], last)
            before, carry = prefix_products(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at], 1), new, carry)
            later = np.flatnonzero(new[1:] if not known else new)
            first = np.zeros(len(new), bool)
            if opens:
                first[: (later[0] + (0 if known else 1)) if len(later) else len(new)] = True
            edge = np.zeros(len(new), bool)
            if opens and len(later):
                end = int(first.sum()) - 1
                if end >= 0:
                    edge[end] = True
                elif held is not None:
                    held[3][-1] = True
                opens = False
            if held is not None:
                yield out(*held)
            held = (batch, before, first, edge)
        if held is not None:
            held[3][-1] = True
            yield out(*held)

    ranged = rows.select(*by, *[c for c in rows.columns if c not in by]).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    names[: len(rows.columns)] = ranged.columns
    at[:] = [ranged.columns.index(c) for c in "abcd"]
    kind = dict(ranged.dtypes)
    schema = ", ".join(f"`{c}` {kind[c]}" for c in ranged.columns) + ", p0 double, p1 double, p2 double, p3 double, part int, opens boolean, edge boolean"
    return written(ranged.mapInArrow(run, schema), "scan")


def _carries(scanned: DataFrame, by) -> list[tuple]:
    """(part, c0..c3) for each range whose first key goes on from the range before: the product of all that lies before it."""
    cells = [F.col(c) for c in ("p0", "p1", "p2", "p3", "a", "b", "c", "d")]
    edges = scanned.filter("edge").select("part", "opens", F.array(*cells).alias("m"), F.struct(*by).alias("key")).collect()  # two rows a range
    out, key, total = [], None, _UNIT
    ends: dict = {}
    for r in edges:
        m = np.array(r["m"])
        ends.setdefault(r["part"], {})[r["opens"]] = (tuple(r["key"]), _times(m[None, 4:], m[None, :4])[0])
    for part in sorted(ends):
        of = ends[part]
        if True in of:
            name, product = of[True]
            if key is not None and name == key:
                out.append((part, *map(float, total)))
                product = _times(product[None], total[None])[0]
            key, total = name, product
        if False in of:
            key, total = of[False]
    return out


def knowledge_trajectory(events: DataFrame, prior: float = C.POPULATION_PRIOR, by=KEY) -> DataFrame:
    """(by…, ts, seq, kind, p_before, p_after) of each event that changes P: prefixes of the fold.

    A prefix scan on two levels: the events are cut into ranges by key and time; in each range the products before every
    row come in one pass, then the ranges of a key that spans several go on from what lies before. Linear in a key's
    length, and a hot key is as many tasks as it has ranges.
    """
    rows = route_events(events)
    rows = rows.withColumn("levels", F.col("levels").cast("int")) if "levels" in rows.columns else rows.withColumn("levels", F.lit(0))
    rows = rows.filter("affects").withColumns(_matrix()).select(*by, "ts", "seq", "kind", "levels", "if_active", "if_not", *"abcd")
    at = _scanned(rows, by, ["ts", "seq", "kind", "levels", "if_active", "if_not"])
    carries = at.sparkSession.createDataFrame(_carries(at, by), "part int, c0 double, c1 double, c2 double, c3 double")
    at = at.join(F.broadcast(carries.withColumn("opens", F.lit(True))), ["part", "opens"], "left")  # at most a row a range
    on, off = F.coalesce(F.col("c0") * prior + F.col("c1") * (1 - prior), F.lit(prior)), F.coalesce(F.col("c2") * prior + F.col("c3") * (1 - prior), F.lit(1 - prior))
    active, not_ = F.col("p0") * on + F.col("p1") * off, F.col("p2") * on + F.col("p3") * off
    at = at.withColumn("p_before", active / (active + not_))
    e = {c: F.col(c) for c in ("kind", "levels", "if_active", "if_not")}
    return at.select(*by, "ts", "seq", "kind", "p_before", _step(F.col("p_before"), e).alias("p_after"))


def _next_state(state: Column, p: Column, *, step: str | None = None, trap=None, transfer=None, ghost_passed=None, ghost_failed=None, exam_passed=None, exposure=None) -> Column:
    no = F.lit(False)
    trap, transfer, ghost_passed, ghost_failed, exam_passed = (no if x is None else x for x in (trap, transfer, ghost_passed, ghost_failed, exam_passed))
    exposure = F.lit(0.0) if exposure is None else F.coalesce(exposure, F.lit(0.0))
    if step == "start":
        return F.when(state.isin("ACTIVE", "RELAPSED"), "TREATING").otherwise(state)
    after = F.when(p > C.ACTIVE_P, "TREATING").when((p < C.STABLE_P) & trap & transfer, "STABLE").otherwise("PROBATION")
    mastered = (p < C.MASTERED_P) & (ghost_passed | (exam_passed & (exposure >= C.EXAM_MASTERY_EXPOSURE)))
    return F.when(state.isin("STABLE", "MASTERED") & ((p >= C.ACTIVE_P) | ghost_failed), "RELAPSED").when((state == "UNSEEN") & (p >= C.ACTIVE_P), "ACTIVE").when(state == "PROBATION", after).when((state == "STABLE") & mastered, "MASTERED").otherwise(state)


#: Kinds whose answer implies that an intervention was taken.
PROBATION_KINDS = ("trap", "transfer_code", "same_family_code", "predict_output")


def mastery_fold(events: DataFrame, prior: float = C.POPULATION_PRIOR, by=KEY) -> DataFrame:
    """(by…, p_active, state, times_seen, trap_passed, transfer_passed, found_family, n_asked) after each key's history.

    events may have exam: a failure in an exam with enough exposure is a failed ghost for a settled class.
    Order within an event: an unrecorded intervention begins, one that is open ends (P falls, the checklist is
    emptied), a ghost after STABLE or MASTERED forgets, the answer moves P, the checklist, then the state.
    """
    rows = route_events(events)
    if "exposure" not in rows.columns:
        rows = rows.withColumn("exposure", F.lit(None).cast("double"))
    if "exam" not in rows.columns:
        rows = rows.withColumn("exam", F.lit(False))
    past = _history(rows, by, "kind", "resolved", "exam", "levels", "correct", "exposure", "family", "item_id", "if_active", "if_not")
    no = F.lit(False)
    start = F.struct(F.lit(float(prior)).alias("p"), F.lit("UNSEEN").alias("state"), F.lit(0).cast("long").alias("seen"), no.alias("trap"), no.alias("transfer"), F.lit(None).cast("string").alias("family"), F.array().cast("array<string>").alias("asked"))
    put = lambda s, **new: F.struct(*[(new[n] if n in new else s[n]).alias(n) for n in ("p", "state", "seen", "trap", "transfer", "family", "asked")])

    def event(s, e):
        kind = e["kind"]
        attempt = kind.isin("signature_failure", "latent_pass")
        done = kind == "intervention_done"
        asks = ~attempt & (kind != "intervention_start")
        implied = kind.isin(*PROBATION_KINDS) | done

        def begun(s):
            return put(s, state=F.when(implied | (kind == "intervention_start"), _next_state(s["state"], s["p"], step="start")).otherwise(s["state"]))

        def ended(s):
            over = asks & (s["state"] == "TREATING")
            return F.when(over, put(s, p=s["p"] * (1 - C.LEARN_RATE), state=F.lit("PROBATION"), trap=no, transfer=no, asked=F.array().cast("array<string>"))).otherwise(s)

        def answered(s):
            rusty = (kind == "ghost") & s["state"].isin("STABLE", "MASTERED")
            p = let(F.when(rusty, forget(s["p"], e["levels"])).otherwise(s["p"]), lambda p: F.when(e["if_active"].isNotNull(), likelihood_ratio(p, e["if_active"], e["if_not"])).otherwise(p))
            family = F.when(attempt & s["family"].isNull() & s["state"].isin("UNSEEN", "ACTIVE"), e["family"]).otherwise(s["family"])
            counts = e["family"].isNull() | is_transfer_family(F.col("class"), s["family"], e["family"])
            trap = s["trap"] | (e["resolved"].isin("trap", "predict_output_trap") & e["correct"])
            transfer = s["transfer"] | ((kind == "transfer_code") & e["correct"] & counts)
            asked = F.when(asks & ~F.array_contains(s["asked"], F.coalesce(e["item_id"], F.lit(""))), F.concat(s["asked"], F.array(e["item_id"]))).otherwise(s["asked"])
            return put(s, p=p, seen=s["seen"] + 1, trap=trap, transfer=transfer, family=family, asked=asked)

        def judged(s):
            ghost, exam = kind == "ghost", kind.isin("exam_code", "exam_trace") | F.coalesce(e["exam"], F.lit(False))
            exposed = F.coalesce(e["exposure"], F.lit(0.0)) >= C.EXAM_MIN_EXPOSURE
            failed = (ghost | (exam & exposed)) & ~F.coalesce(e["correct"], F.lit(False))
            state = F.when(attempt & ~exam, _next_state(s["state"], s["p"])).otherwise(_next_state(s["state"], s["p"], trap=s["trap"], transfer=s["transfer"], ghost_passed=ghost & e["correct"], ghost_failed=failed, exam_passed=exam & e["correct"], exposure=e["exposure"]))
            return put(s, state=state)

        plain = done | (kind == "intervention_start")
        return let(begun(s), lambda s: let(ended(s), lambda s: F.when(plain, s).otherwise(let(answered(s), judged))))

    out = past.withColumn("s", F.aggregate("history", start, event))
    return out.select(*by, F.col("s.p").alias("p_active"), F.col("s.state").alias("state"), F.col("s.seen").alias("times_seen"), F.col("s.trap").alias("trap_passed"), F.col("s.transfer").alias("transfer_passed"), F.col("s.family").alias("found_family"), F.size("s.asked").cast("long").alias("n_asked"))


def riskiest(knowledge: DataFrame, k: int = 3, by=("learner_id",)) -> DataFrame:
    """The k classes with the highest P of each learner, ties by class."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("p_active"), "class"))
    return knowledge.withColumn("rank", rank).filter(F.col("rank") <= k)


def reassess_conditions(knowledge: DataFrame) -> DataFrame:
    """A row for each of the three conditions: (keys, id, met, detail)."""
    p = F.col("p_active")
    each = F.array(
        F.struct(F.lit("p_active").alias("id"), (p < C.STABLE_P).alias("met"), two_digits(p).alias("detail")),
        F.struct(F.lit("trap").alias("id"), F.col("trap_passed").alias("met"), F.lit("").alias("detail")),
        F.struct(F.lit("transfer").alias("id"), F.col("transfer_passed").alias("met"), F.lit("").alias("detail")),
    )
    return knowledge.select(*KEY, F.inline(each))


def next_probation_item(knowledge: DataFrame, bank: DataFrame) -> DataFrame:
    """For keys on PROBATION: an unpassed trap first, else the first transfer problem. bank: (item_id, class, type, family)."""
    on = knowledge.filter("state = 'PROBATION'").select(*KEY, "trap_passed", "transfer_passed", "found_family")
    fits = F.when(F.col("type") == "trap", ~F.col("trap_passed")).otherwise(~F.col("transfer_passed") & is_transfer_family(F.col("class"), F.col("found_family"), F.col("family")))
    rows = on.join(bank, "class").filter(fits)
    return rows.groupBy(*KEY).agg(F.min_by("item_id", F.struct((F.col("type") != "trap").alias("late"), "item_id")).alias("item_id"))


def learner_snapshot(knowledge: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row for each learner: knowledge and attempts nested, P rounded to 6."""
    k = knowledge.groupBy("learner_id").agg(F.array_sort(F.collect_list(F.struct("class", F.round("p_active", 6).alias("p_active"), "state"))).alias("knowledge"))
    a = attempts.groupBy("learner_id").agg(F.array_sort(F.collect_list(F.struct("ts", "attempt_id", "passed", "total"))).alias("attempts"))
    return k.join(a, "learner_id", "full_outer")


def node_status(log: DataFrame) -> DataFrame:
    """(learner_id, node, status, stars): the last status, the most stars; 3 for all passed."""
    whole = (F.col("total") > 0) & (F.col("passed") == F.col("total"))
    return log.groupBy("learner_id", "node").agg(F.max_by(F.when(whole, "done").otherwise("unstable"), F.struct("ts", "attempt_id")).alias("status"), F.max(F.when(whole, 3).otherwise(0)).alias("stars"))


def learner_prior(knowledge: DataFrame) -> DataFrame:
    """(learner_id, prior MAP): null for learners of whom nothing was seen."""
    seen = F.max((F.col("state") != "UNSEEN") | (F.col("times_seen") > 0))
    return knowledge.groupBy("learner_id").agg(seen.alias("seen"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "p_active")))).alias("m")).select("learner_id", F.when(F.col("seen"), F.col("m")).alias("prior"))


def areas_complete(nodes: DataFrame, required: list[str]) -> DataFrame:
    """(learner_id, complete): whether all required areas are done."""
    done = F.collect_set(F.when(F.col("status") == "done", F.col("node")))
    return nodes.groupBy("learner_id").agg((F.size(F.array_except(F.lit(required), done)) == 0).alias("complete"))


def reason_updates(sentences: DataFrame) -> DataFrame:
    """The first sentence for each (learner, item) that names a class surely enough: an event of kind `why`."""
    first = F.row_number().over(W.partitionBy("learner_id", "item_id").orderBy("ts", "seq"))
    return sentences.withColumn("n", first).filter("n = 1").filter(~F.col("unsure") & F.col("matched") & (F.col("p_text") >= C.TEXT_MATCH_P)).drop("n").withColumn("kind", F.lit("why"))


def settle_options(posterior: DataFrame, sentences: DataFrame, by=("learner_id", "item_id")) -> DataFrame:
    """The option posterior of each answer times its first sentence that is not unsure: (by…, label, p, settled).

    posterior: (by…, label, p); sentences: (by…, ts, seq, unsure, p_text MAP label to p). Later sentences change nothing.
    """
    first = F.row_number().over(W.partitionBy(*by).orderBy("ts", "seq"))
    sure = sentences.filter(~F.coalesce("unsure", F.lit(False))).withColumn("n", first).filter("n = 1").select(*by, F.col("p_text").alias("__t"))
    rows = posterior.join(sure, list(by), "left").withColumn("settled", F.col("__t").isNotNull())
    rows = rows.withColumns({"p_text": F.element_at("__t", F.col("label")), "unsure": ~F.col("settled")}).drop("__t")
    return apply_text(rows, by).select(*by, "label", "p", "settled")


def asof_prior(attempts: DataFrame, trajectory: DataFrame) -> DataFrame:
    """(attempt_id, class, p): each class's P just before an attempt; classes without history give no row.

    Both sides are put in one order by learner and time; the latest value before the attempt is carried forward.
    """
    classes = trajectory.select("learner_id", "class").distinct()
    ask = attempts.select("learner_id", "ts", "attempt_id").join(classes, "learner_id").select("learner_id", "class", "ts", F.lit(0).alias("late"), F.lit(None).cast("long").alias("seq"), "attempt_id", F.lit(None).cast("double").alias("p"))
    give = trajectory.select("learner_id", "class", "ts", F.lit(1).alias("late"), "seq", F.lit(None).cast("long").alias("attempt_id"), F.col("p_after").alias("p"))
    before = W.partitionBy("learner_id", "class").orderBy("ts", "late", "seq").rowsBetween(W.unboundedPreceding, -1)
    return ask.unionByName(give).withColumn("p", F.coalesce(F.col("p"), F.last("p", ignorenulls=True).over(before))).filter("attempt_id is not null and p is not null").select("attempt_id", "class", "p")
