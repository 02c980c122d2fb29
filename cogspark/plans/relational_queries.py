"""Numbering, histories, top groups, cross-tabs and joins over the logical tables."""

from pyspark.sql import functions as F

from ..functions.columns import domain_of
from ..operators import relational as Z
from .bayes_queries import _L, _P0, _p0
from .registry import query


@query("w1_attempt_seq", "attempts", sql="select attempt_id, learner_id, row_number() over (partition by learner_id order by ts, attempt_id) seq from attempts")
def w1_attempt_seq(attempts):
    return Z.attempt_seq(attempts).select("attempt_id", "learner_id", "seq")


@query("w2_last_evidence", "responses", sql="select learner_id, seq, kind, row_number() over (partition by learner_id order by ts desc, seq desc) age from responses qualify row_number() over (partition by learner_id order by ts desc, seq desc) <= 20")
def w2_last_evidence(responses):
    return Z.last_n(responses, ["learner_id"], ["ts", "seq"]).select("learner_id", "seq", "kind", "age")


@query("o5_first_per_key", "lines", sql="select l_partkey, min(l_orderkey * 1000 + rn) k from lines group by 1")
def o5_first_per_key(lines):
    rows = lines.withColumn("k", F.col("l_orderkey") * 1000 + F.col("rn"))
    return Z.first_per_key(rows, "l_partkey", "k").select("l_partkey", "k")


@query("o3_top_groups", "lineitem", sql="select l_partkey, count(*) n from lineitem group by 1 order by n desc, l_partkey limit 10")
def o3_top_groups(lineitem):
    return Z.top_groups(lineitem, "l_partkey")


@query("o1_top_labels", "orders", sql=f"with {_L}, {_P0} select key, label, round(p, 6) p, row_number() over (partition by key order by round(p, 12) desc, label)::int \"rank\" from p0 where p >= 0.02e0 qualify row_number() over (partition by key order by round(p, 12) desc, label) <= 2")
def o1_top_labels(orders):
    return Z.top_labels(_p0(orders).select("key", "label", "p")).withColumn("p", F.round("p", 6))


@query("a2_crosstab", "corpus", sql="with a(l) as (values ('M01'), ('M08'), ('D01'), ('OTHER'), ('none')), b(s) as (values ('A'), ('E'), ('AMB')), n as (select label, source, count(*) n from corpus group by 1, 2) select a.l label, b.s source, coalesce(n, 0) n from a cross join b left join n on n.label = a.l and n.source = b.s")
def a2_crosstab(corpus):
    return Z.crosstab(corpus, "label", "source", ["M01", "M08", "D01", "OTHER", "none"], ["A", "E", "AMB"])


@query("j5_collision_trials", "beliefs", "predictions", sql="with g as (select item_id, believed, unnest(l) label from (select item_id, believed, list(distinct label) l from beliefs group by 1, 2) where len(l) > 1) select item_id, believed \"option\", label, id sentence_id from g join (select id, 'M0' || (1 + id % 8) label from predictions) using (label)")
def j5_collision_trials(beliefs, predictions):
    return Z.collision_trials(beliefs, predictions.select("id", F.concat(F.lit("M0"), 1 + F.col("id") % 8).alias("label")))


@query("d14_cross_domain", "attempts", sql="select attempt_id, case when problem_id like 'P%' then 'train' when problem_id like 'Q%' then 'test' end part from attempts")
def d14_cross_domain(attempts):
    return Z.cross_domain_plan(attempts, domain_of(F.col("problem_id")), "main", "dsa").select("attempt_id", "part")


@query("j1_fact_with_items", "lineitem", "part", sql="select p_brand, p_type, count(*) n, round(sum(l_extendedprice), 2) revenue from lineitem join part on p_partkey = l_partkey group by 1, 2")
def j1_fact_with_items(lineitem, part):
    rows = Z.fact_with_items(lineitem.withColumnRenamed("l_partkey", "p_partkey"), part, "p_partkey")
    return rows.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query(
    "udf_belief_product",
    "responses",
    sql="""with g as (select *, case kind when 'trap' then 0.15e0 when 'transfer_code' then 0.30e0 when 'belief_mcq' then 0.2e0 when 'ghost' then 0.25e0 when 'same_family_code' then 0.45e0 end g0, case kind when 'trap' then 0.10e0 when 'transfer_code' then 0.15e0 when 'belief_mcq' then 0.10e0 when 'ghost' then 0.15e0 when 'same_family_code' then 0.10e0 end s from responses where kind <> 'intervention_done'),
h as (select *, case when hint then least(0.9e0, g0 + 0.2e0) else g0 end gg from g) select learner_id, class, round(1 / (1 + exp(-(ln(0.1e0 / 0.9e0) + sum(ln(case when correct then gg else 1 - gg end / case when correct then 1 - s else s end))))), 6) p from h group by 1, 2""",
)
def udf_belief_product(responses):
    from ..operators.knowledge import route_events

    spark = responses.sparkSession
    Z.register_functions(spark)
    rows = route_events(responses).filter("if_active is not null")
    return spark.sql("select learner_id, class, round(belief_product(if_active, if_not), 6) p from {rows} group by learner_id, class", rows=rows)


@query("udtf_likelihood_rows", "choices", "beliefs", sql="with x as (select c.item_id, correct, options, believed, b.label, unnest(options) \"option\" from choices c join beliefs b using (item_id)), y as (select *, greatest(0.02e0, case when believed <> correct and list_contains(options, believed) then case when \"option\" = believed then 0.6e0 when \"option\" = correct then 0.2e0 else 0.2e0 / (len(options) - 2) end when \"option\" = correct then 0.9e0 else 0.1e0 / (len(options) - 1) end) raw from x) select item_id, label, \"option\", round(raw / sum(raw) over (partition by item_id, label), 6) p from y")
def udtf_likelihood_rows(choices, beliefs):
    spark = choices.sparkSession
    Z.register_functions(spark)
    rows = choices.join(beliefs, "item_id")
    return spark.sql("select item_id, label, option, round(p, 6) p from {rows} r, lateral likelihood_rows(r.options, r.correct, r.believed)", rows=rows)


@query("p4_public_view", "choices", "beliefs", sql="select item_id, 'quiz' type, 'loops' concept, array_to_string(options, ',') options, (1 + k % 3)::int difficulty from choices where item_id in (select item_id from beliefs)")
def p4_public_view(choices, beliefs):
    items = choices.join(beliefs.select("item_id").distinct(), "item_id").select("item_id", F.lit("quiz").alias("type"), F.lit("loops").alias("concept"), "options", "correct", (1 + F.col("k") % 3).cast("int").alias("difficulty"), F.lit(1.0).alias("exposure"))
    return Z.public_view(items, "quiz").withColumn("options", F.array_join("options", ","))
