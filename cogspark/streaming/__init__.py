"""The operators as Structured Streaming queries: knowledge with keyed state, posteriors, activity, sessions, late rows.

withWatermark needs TIMESTAMP: time stamps without a zone are cast in the session's.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as C
from ..operators.bayes import sums_by_label
from ..operators.knowledge import PROBATION_KINDS, route_events


def timed(events: DataFrame, watermark: str, ts: str = "ts") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def stream_knowledge(events: DataFrame, watermark: str = "1 hour", prior: float = C.POPULATION_PRIOR) -> DataFrame:
    """(learner_id, class, ts, seq, p_before, p_after) of each event, from the P kept for each learner and class.

    Repeated seq within the watermark count once. Events of one batch are taken in the order of (ts, seq); an event
    that comes after later ones of an earlier batch is applied when it comes: late_rows() gives the keys to fold anew.
    """
    rows = route_events(timed(events, watermark)).filter("affects")
    levels = F.col("levels").cast("int") if "levels" in rows.columns else F.lit(0)
    rows = rows.withColumn("levels", levels).dropDuplicatesWithinWatermark(["learner_id", "seq"])

    def step(key, batches, state: GroupState):
        p = state.get[0] if state.exists else prior
        pdf = pd.concat(list(batches)).sort_values(["ts", "seq"])
        out = []
        for r in pdf.itertuples(index=False):
            before = p
            if r.kind == "intervention_done":
                p = p * (1 - C.LEARN_RATE)
            elif r.kind == "forgetting":
                p = 1 - (1 - p) * (1 - C.FORGET_RATE) ** max(0, int(r.levels))
            else:
                total = p * r.if_active + (1 - p) * r.if_not
                p = p if total == 0 else p * r.if_active / total
            out.append((key[0], key[1], r.ts, r.seq, before, p))
        state.update((p,))
        yield pd.DataFrame(out, columns=["learner_id", "class", "ts", "seq", "p_before", "p_after"])

    narrow = rows.select("learner_id", "class", "ts", "seq", "kind", "levels", "if_active", "if_not")
    return narrow.groupBy("learner_id", "class").applyInPandasWithState(step, "learner_id long, class string, ts timestamp, seq long, p_before double, p_after double", "p double", "append", GroupStateTimeout.NoTimeout)


def _reassess(cls: str, s: dict, e) -> dict:
    """The state of a learner's class after one event, in the order of mastery_fold."""
    s, kind = dict(s), e.kind
    attempt, done, start = kind in ("signature_failure", "latent_pass"), kind == "intervention_done", kind == "intervention_start"
    correct, exposure = bool(e.correct), 0.0 if pd.isna(e.exposure) else float(e.exposure)
    if (kind in PROBATION_KINDS or done or start) and s["state"] in ("ACTIVE", "RELAPSED"):
        s["state"] = "TREATING"
    if not attempt and not start and s["state"] == "TREATING":
        s.update(p=s["p"] * (1 - C.LEARN_RATE), state="PROBATION", trap=False, transfer=False)
    if done or start:
        return s
    if kind == "ghost" and s["state"] in ("STABLE", "MASTERED"):
        s["p"] = 1 - (1 - s["p"]) * (1 - C.FORGET_RATE) ** max(0, int(e.levels))
    if not pd.isna(e.if_active):
        total = s["p"] * e.if_active + (1 - s["p"]) * e.if_not
        s["p"] = s["p"] if total == 0 else s["p"] * e.if_active / total
    family = None if pd.isna(e.family) else e.family
    s["seen"] += 1
    s["trap"] = s["trap"] or (e.resolved in ("trap", "predict_output_trap") and correct)
    counts = family is None or (family in C.TRANSFER_FAMILIES.get(cls, ()) and family != s["family"])
    s["transfer"] = s["transfer"] or (kind == "transfer_code" and correct and counts)
    if attempt and s["family"] is None and s["state"] in ("UNSEEN", "ACTIVE"):
        s["family"] = family
    exam = kind in ("exam_code", "exam_trace") or bool(e.exam)
    attempt = attempt and not exam  # in an exam they are judged as its other answers are
    ghost_failed = not correct and (kind == "ghost" or (exam and exposure >= C.EXAM_MIN_EXPOSURE))
    mastered = s["p"] < C.MASTERED_P and correct and (kind == "ghost" or (exam and exposure >= C.EXAM_MASTERY_EXPOSURE))
    state, p = s["state"], s["p"]
    if state in ("STABLE", "MASTERED") and (p >= C.ACTIVE_P or (ghost_failed and not attempt)):
        s["state"] = "RELAPSED"
    elif state == "UNSEEN" and p >= C.ACTIVE_P:
        s["state"] = "ACTIVE"
    elif state == "PROBATION":
        s["state"] = "TREATING" if p > C.ACTIVE_P else "STABLE" if p < C.STABLE_P and s["trap"] and s["transfer"] and not attempt else "PROBATION"
    elif state == "STABLE" and mastered and not attempt:
        s["state"] = "MASTERED"
    return s


_ENTRY = "p double, state string, seen long, trap boolean, transfer boolean, family string"
_LOG = "learner_id long, class string, ts timestamp, seq long, p_before double, p_after double, state_before string, state_after string, times_seen long, trap_passed boolean, transfer_passed boolean"


def stream_states(events: DataFrame, watermark: str = "1 hour", prior: float = C.POPULATION_PRIOR) -> DataFrame:
    """The update log of knowledge with the mastery states: P, state and checklist before and after each event.

    Kept for each learner and class: P, state, times seen, trap and transfer passed, the family it was found in; events
    may have exam, as in mastery_fold. Repeated seq within the watermark count once; order and late events as in stream_knowledge.
    """
    rows = route_events(timed(events, watermark)).dropDuplicatesWithinWatermark(["learner_id", "seq"])
    for name, kind in (("levels", "int"), ("exposure", "double"), ("family", "string"), ("exam", "boolean")):
        rows = rows.withColumn(name, F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind))
    names = [c.split()[0] for c in _ENTRY.split(", ")]

    def step(key, batches, state: GroupState):
        s = dict(zip(names, state.get)) if state.exists else {"p": prior, "state": "UNSEEN", "seen": 0, "trap": False, "transfer": False, "family": None}
        out = []
        for e in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples(index=False):
            new = _reassess(key[1], s, e)
            out.append((key[0], key[1], e.ts, e.seq, s["p"], new["p"], s["state"], new["state"], new["seen"], new["trap"], new["transfer"]))
            s = new
        state.update(tuple(s[n] for n in names))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _LOG.split(", ")])

    narrow = rows.select("learner_id", "class", "ts", "seq", "kind", "resolved", F.coalesce("levels", F.lit(0)).alias("levels"), F.coalesce("correct", F.lit(False)).alias("correct"), "exposure", "family", F.coalesce("exam", F.lit(False)).alias("exam"), "if_active", "if_not")
    return narrow.groupBy("learner_id", "class").applyInPandasWithState(step, _LOG, _ENTRY, "append", GroupStateTimeout.NoTimeout)


def stream_posterior(answers: DataFrame, table: DataFrame) -> DataFrame:
    """(key, label, l): running sums of log likelihoods; the order of answers does not matter. For update or complete mode.

    The state has one row a key, with a sum for each label, instead of a row for each label.
    """
    logs = sums_by_label(table.withColumnRenamed("option", "answer"), F.log("p"), ("item_id", "answer")).withColumnRenamed("values", "logs")
    sums = answers.join(logs, ["item_id", "answer"]).groupBy("key").agg(*[F.sum(F.get("logs", F.lit(i))).alias(f"__{i}") for i in range(len(C.LABELS))])
    each = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"__{i}").alias("l")) for i, x in enumerate(C.LABELS)])
    return sums.select("key", F.inline(F.filter(each, lambda x: x["l"].isNotNull())))


def activity(events: DataFrame, window: str = "1 hour", slide: str | None = None, watermark: str = "1 hour", by: str = "type") -> DataFrame:
    """(start, end, type, n, pass_rate) in tumbling or sliding windows."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = timed(events, watermark).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("passed").cast("double")).alias("pass_rate"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "pass_rate")


def sessions(events: DataFrame, gap: str = f"{C.EXAM_TIME_LIMIT_S} seconds", watermark: str = "1 hour") -> DataFrame:
    """(learner_id, start, end, n): sessions that a pause ends."""
    g = timed(events, watermark).groupBy(F.session_window("ts", gap).alias("w"), "learner_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("learner_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def late_rows(batch: DataFrame, seen_to: Column) -> DataFrame:
    """Rows of a micro-batch that are older than what was seen: for a side table, and for their keys to be folded again."""
    return batch.filter(F.col("ts") < seen_to)


def split_late(stream: DataFrame, out: str, side: str, checkpoint: str, watermark: str = "1 hour", ts: str = "ts"):
    """Appends each micro-batch to a table, and rows that are later than the watermark of the batches before to a side table."""
    seen: list = []

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not seen and number:  # after a restart: what was written tells how far time had come
            seen.append(spark.read.schema(batch.schema).parquet(out).agg(F.max(ts)).first()[0])
        if seen and seen[-1] is not None:
            late_rows(batch, F.lit(seen[-1]) - F.expr(f"interval {watermark}")).write.mode("append").parquet(side)
        batch.write.mode("append").parquet(out)
        newest = batch.agg(F.max(ts)).first()[0]
        seen[:] = [max(x for x in (*seen, newest) if x is not None)] if newest is not None or seen else []

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refold(history: DataFrame, late: DataFrame, fold: Callable[[DataFrame], DataFrame], by=("learner_id", "class")) -> DataFrame:
    """The batch fold of the keys that late rows belong to, over their whole history."""
    return fold(history.join(late.select(*by).distinct(), list(by), "left_semi"))


def enrich(stream: DataFrame, items: DataFrame, on: str = "item_id") -> DataFrame:
    """A stream with a static table's columns."""
    return stream.join(items, on, "left")


def diagnosed(attempts: DataFrame, diagnoses: DataFrame, within: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Attempts joined with the diagnosis that comes within the interval; both streams have watermarks."""
    a = timed(attempts, watermark).alias("a")
    d = timed(diagnoses.withColumnRenamed("ts", "diagnosed_at"), watermark, "diagnosed_at").withColumnRenamed("attempt_id", "__attempt").alias("d")
    on = F.expr(f"attempt_id = __attempt and diagnosed_at >= ts and diagnosed_at <= ts + interval {within}")
    return a.join(d, on).drop("__attempt")


def monitor(stream: DataFrame, rules: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Runs quality rules on each micro-batch and appends (batch, rule_id, status, key, value) to a table."""

    def put(batch: DataFrame, number: int) -> None:
        rules(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
