"""The skill graph of each learner: what is cleared, shaky or at risk, what to do next, and checks of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.columns import class_eig
from .shared import broadcast_if_small


def records(attempts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(learner_id, record, cleared): tried records, and whether one was passed in full or its node is done."""
    whole = (F.col("total") > 0) & (F.col("passed") == F.col("total"))
    a = attempts.select("learner_id", F.col("problem_id").alias("record"), whole.alias("ok"))
    n = nodes.select("learner_id", F.element_at(F.split("node", ":"), -1).alias("record"), (F.col("status") == "done").alias("ok"))
    return a.unionByName(n).groupBy("learner_id", "record").agg(F.bool_or("ok").alias("cleared"))


def hazards(learners: DataFrame, exposure: DataFrame, knowledge: DataFrame, default: float = C.POPULATION_PRIOR) -> DataFrame:
    """(learner_id, star_id, class, exposure, p_active, state): p to 4 digits; classes without knowledge have the default.

    Every learner has every star: the rows are learners times the stars' exposures, a small table.
    """
    rows = _spread(learners, exposure)
    rows = rows.join(knowledge.select("learner_id", "class", "p_active", "state"), ["learner_id", "class"], "left")
    return rows.select("learner_id", "star_id", "class", "exposure", F.round(F.coalesce("p_active", F.lit(default)), 4).alias("p_active"), F.coalesce("state", F.lit("UNSEEN")).alias("state"))


def hazard_lists(hazard: DataFrame) -> DataFrame:
    """(learner_id, star_id, hazards): each star's classes as one array, the largest exposure times P first, ties by class."""
    e = F.struct((-F.round(F.col("exposure") * F.col("p_active"), 12)).alias("k"), "class", "exposure", "p_active", "state")
    return hazard.groupBy("learner_id", "star_id").agg(F.transform(F.array_sort(F.collect_list(e)), lambda x: x.dropFields("k")).alias("hazards"))


def _spread(learners: DataFrame, exposure: DataFrame) -> DataFrame:
    """Each learner with each row of a vocabulary, which is put into one array."""
    every = exposure.agg(F.collect_list(F.struct("star_id", "class", "exposure")).alias("x"))
    return learners.select("learner_id").distinct().withColumn("x", every.scalar()).select("learner_id", F.inline("x"))


def star_states(hazard: DataFrame, record: DataFrame, stars: DataFrame) -> DataFrame:
    """(learner_id, star_id, state, cleared, brightness, risk, at_risk). stars: (star_id, record)."""
    e = F.col("exposure") * F.col("p_active")
    live = F.col("state").isin(C.LIVE_STATES)
    high = (F.col("p_active") >= C.ACTIVE_P) & (e >= C.AT_RISK_MIN)
    own = hazard.groupBy("learner_id", "star_id").agg(F.product(1 - e).alias("solid"), F.bool_or(live).alias("live"), F.bool_or(high).alias("high"))
    seen = record.join(broadcast_if_small(stars), "record").groupBy("learner_id", "star_id").agg(F.bool_or("cleared").alias("cleared"), F.lit(True).alias("tried"))
    rows = own.join(seen, ["learner_id", "star_id"], "left").withColumn("cleared", F.coalesce("cleared", F.lit(False)))
    state = F.when(F.col("cleared"), F.when(F.col("live"), "shaky").otherwise("known")).when(F.coalesce("tried", F.lit(False)), "attempted").otherwise("unexplored")
    return rows.select("learner_id", "star_id", state.alias("state"), "cleared", F.when(F.col("cleared"), F.round("solid", 4)).alias("brightness"), F.when(~F.col("cleared"), F.round(1 - F.col("solid"), 4)).alias("risk"), (F.col("high") & ~F.col("cleared")).alias("at_risk"))


def suggested_next(hazard: DataFrame, states: DataFrame, order: DataFrame) -> DataFrame:
    """Each learner's uncleared star with the most expected bits, the earliest on a tie. order: (star_id, ord)."""
    rows = hazard.filter(F.col("exposure") >= C.EXAM_MIN_EXPOSURE).join(states.filter("not cleared").select("learner_id", "star_id"), ["learner_id", "star_id"])
    gains = rows.groupBy("learner_id", "star_id").agg(F.round(F.sum(class_eig(F.col("p_active"), F.col("exposure"))), 9).alias("bits")).join(broadcast_if_small(order), "star_id")
    return gains.groupBy("learner_id").agg(F.max_by(F.struct("star_id", "bits"), F.struct("bits", -F.col("ord"))).alias("b")).select("learner_id", "b.star_id", "b.bits")


def topic_rollup(states: DataFrame, topics: DataFrame) -> DataFrame:
    """(learner_id, topic, total, cleared, shaky, at_risk). topics: (star_id, topic)."""
    n = lambda c: F.count_if(c)
    return states.join(broadcast_if_small(topics), "star_id").groupBy("learner_id", "topic").agg(F.count(F.lit(1)).alias("total"), n(F.col("cleared")).alias("cleared"), n(F.col("state") == "shaky").alias("shaky"), n(F.col("at_risk")).alias("at_risk"))


def chart_summary(states: DataFrame) -> DataFrame:
    """(learner_id, known, shaky, attempted, unexplored, at_risk)."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return states.groupBy("learner_id").agg(*map(n, ("known", "shaky", "attempted", "unexplored")), F.count_if("at_risk").alias("at_risk"))


def check_families(skills: DataFrame, problems: DataFrame) -> DataFrame:
    """Violations (rule, id) of one skill for each family: skills (id, family), problems (family)."""
    have, used = problems.select("family").distinct(), skills.filter("family is not null")
    none = have.join(used, "family", "left_anti").select(F.lit("no_skill").alias("rule"), F.col("family").alias("id"))
    two = used.groupBy("family").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("two_skills").alias("rule"), F.col("family").alias("id"))
    lost = used.join(have, "family", "left_anti").select(F.lit("unknown_family").alias("rule"), F.col("id"))
    return none.unionByName(two).unionByName(lost)


def check_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations (rule, id): repeated ids, ends that do not exist, and nodes on or behind a cycle.

    Cycles are found by peeling nodes without remaining prerequisites, round by round, on checkpointed tables.
    """
    from .shared import written

    twice = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("repeated").alias("rule"), "id")
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    lost = ends.join(nodes, "id", "left_anti").select(F.lit("missing").alias("rule"), "id")
    left = written(edges.select("src", "dst").distinct(), "edges")
    n = left.count()
    while n:
        # an edge goes when its source waits for nothing any more
        waiting = left.select(F.col("dst").alias("src")).distinct()
        left = written(left.join(waiting, "src", "left_semi"), "edges")
        m = left.count()
        if m == n:
            break
        n = m
    cycle = left.select(F.col("dst").alias("id")).distinct().select(F.lit("cycle").alias("rule"), "id")
    return twice.unionByName(lost).unionByName(cycle)
