"""Exams: customers' orders as items in time, sectors by priority. Skill graph: nations as skills, regions as topics."""

from pyspark.sql import functions as F

from ..operators import exam as X
from ..operators import graph as G
from .bayes_queries import _TABLE, _items
from .registry import logical, query

logical("exam_log", "attempts", sql="select learner_id exam_id, sector, row_number() over (partition by learner_id order by ts, attempt_id) seq, attempt_id item_id, difficulty, passed = total passed, learner_id % 4 = 0 bonus, case when passed = total then 'pass' when passed * 2 < total then 'skip' else 'fail' end outcome, problem_id from {attempts}")
logical("sessions", "responses", sql="select learner_id exam_id, class, round(0.05e0 + avg(case when correct then 0.2e0 else 0.7e0 end), 6) p, count(*) % 2 = 0 covered, 1200e0 + (learner_id % 9) * 50e0 theta from {responses} group by learner_id, class")
logical("states", "responses", sql="select learner_id exam_id, class, count(*) % 4 <> 1 tested, case when count(*) % 9 = 4 then 'T1' end ambiguous, case count(*) % 5 when 0 then 'STABLE' when 1 then 'MASTERED' when 2 then 'ACTIVE' else 'UNSEEN' end state0, case when min(seq) % 5 = 0 then 'RELAPSED' when min(seq) % 5 = 1 then 'MASTERED' else 'ACTIVE' end state, (count(*) * 7 % 100) / 100e0 p0, (count(*) * 13 % 100) / 100e0 p from {responses} group by learner_id, class")
logical("trial_log", "attempts", sql="select learner_id exam_id, row_number() over (partition by learner_id order by ts, attempt_id) seq, sector, attempt_id item_id, case when passed = total then 'pass' when passed * 2 < total then 'skip' else 'fail' end outcome, case when difficulty = 3 then 'OTHER' else top end top, top_p, latent asked from {attempts}")


_ELO = """recursive with o as (select *, row_number() over (partition by exam_id, sector order by seq) rn from exam_log), f as (select exam_id, sector, rn, seq, t + 40 * (passed::int - 1 / (1 + pow(10e0, (1000 + 200 * difficulty - t) / 400))) theta from (select *, 1300e0 + case when bonus then 100e0 else 0e0 end t from o where rn = 1)
  union all select o.exam_id, o.sector, o.rn, o.seq, theta + 40 * (passed::int - 1 / (1 + pow(10e0, (1000 + 200 * difficulty - theta) / 400))) from f join o on o.exam_id = f.exam_id and o.sector = f.sector and o.rn = f.rn + 1)"""


@query("x_elo_trajectory", "exam_log", sql=_ELO + " select exam_id, sector, seq, round(theta, 6) theta from f")
def x_elo_trajectory(exam_log):
    return X.elo_trajectory(exam_log).withColumn("theta", F.round("theta", 6))


@query("x_sector_rollup", "exam_log", sql=_ELO + " select f.exam_id, f.sector, string_agg(item_id::varchar, ',' order by f.seq) items, sum(passed::int)::bigint passed, round(min_by(theta, f.seq), 6) \"first\", round(max_by(theta, f.seq), 6) \"last\" from f join exam_log l on l.exam_id = f.exam_id and l.seq = f.seq group by 1, 2")
def x_sector_rollup(exam_log):
    return X.sector_rollup(exam_log.join(X.elo_trajectory(exam_log), ["exam_id", "sector", "seq"])).withColumns({c: F.round(c, 6) for c in ("first", "last")})


logical("exam_answers", "attempts", sql="select learner_id, ts, attempt_id seq, cast(1 + attempt_id % 1000 as bigint) item_id, passed = total passed, top diagnosed, latent, case when passed = total then latent when top <> 'CORRECT' then top end told from {attempts}")


@query("x_exam_updates", "exam_answers", "exposures", sql="""with h as (select a.*, class, e.exposure from exam_answers a join exposures e on e.item_id = a.item_id and e.exposure >= 0.2e0 union all
  select a.*, a.told, e.exposure from exam_answers a left join exposures e on e.item_id = a.item_id and e.class = a.told where told is not null and (e.exposure is null or e.exposure < 0.2e0))
select learner_id, class, ts, seq, case when class is not distinct from told then case when passed then 'latent_pass' else 'signature_failure' end else 'exam_code' end kind, passed correct, exposure, true exam from h""")
def x_exam_updates(answers, exposures):
    return X.exam_updates(answers.drop("told"), exposures.select("item_id", "class", "exposure"))


@query("x_exam_trace_updates", "choices", "beliefs", "answers", sql=f"""with {_TABLE}, ex as (select t.item_id, t.label class, t.p exposure from t join beliefs b on b.item_id = t.item_id and b.label = t.label and b.believed = t."option" join choices c on c.item_id = t.item_id where b.believed <> c.correct and t.p >= 0.2e0)
select a.key learner_id, ex.class, a.key ts, 0 seq, 'exam_trace' kind, a.answer = c.correct correct, round(ex.exposure, 6) exposure, true exam, round(coalesce(t.p, 0), 6) p_answer from answers a join choices c on c.item_id = a.item_id join ex on ex.item_id = a.item_id left join t on t.item_id = a.item_id and t.label = ex.class and t."option" = a.answer""")
def x_exam_trace_updates(choices, beliefs, answers):
    rows = answers.select(F.col("key").alias("learner_id"), "item_id", F.col("key").alias("ts"), F.lit(0).alias("seq"), "answer")
    return X.exam_trace_updates(rows, _items(choices, beliefs)).withColumns({c: F.round(c, 6) for c in ("exposure", "p_answer")})


_H = "(case when {0} <= 0 or {0} >= 1 then 0 else -({0} * log2({0}) + (1 - {0}) * log2(1 - {0})) end)"
_SCORE = f"""q as (select s.exam_id, e.item_id, e.difficulty, s.theta, s.covered, s.class, p, exposure x, case when e.item_id % 2 = 0 then 1e0 else 0.3e0 end cost from sessions s join exposures e on e.class = s.class and e.exposure >= 0.2e0 and e.item_id % 25 = s.exam_id % 25),
v as (select *, p * x + (1 - p) * 0.03e0 pf, p * x / (p * x + (1 - p) * 0.03e0) a, p * (1 - x) / (p * (1 - x) + (1 - p) * 0.97e0) b from q),
sc as (select exam_id, item_id, sum(({_H.format('p')} - (pf * {_H.format('a')} + (1 - pf) * {_H.format('b')})) / cost) eig, avg((not covered)::int) cov, any_value(abs(1 / (1 + pow(10e0, (1000 + 200 * difficulty - theta) / 400)) - 0.6e0)) off, max((class = 'M01')::int) gh from v group by 1, 2), s2 as (select exam_id, item_id, eig, eig + 0.5e0 * cov - 0.4e0 * off + 0.3e0 * gh score from sc)"""


def _bank(sessions, exposures):
    # a session meets the items of its own slice of the pool
    pool = exposures.select("item_id", F.when(F.col("item_id") % 2 == 0, "coding").otherwise("trace").alias("kind"), "difficulty", "sector", "class", "exposure", (F.col("item_id") % 25).alias("slice"))
    return sessions.withColumns({"ghosts": F.array(F.lit("M01")), "slice": F.col("exam_id") % 25}), pool, "slice"


@query("x_score_candidates", "sessions", "exposures", sql=f"with {_SCORE} select exam_id, item_id, round(score, 6) score, round(eig, 6) eig from s2")
def x_score_candidates(sessions, exposures):
    return X.score_candidates(*_bank(sessions, exposures), digits=6)


@query("x_recommend_exam_item", "sessions", "exposures", sql=f"with {_SCORE} select exam_id, round(max(score), 6) score from s2 group by 1")
def x_recommend_exam_item(sessions, exposures):
    return X.recommend_exam_item(*X.score_kinds(*_bank(sessions, exposures))).select("exam_id", F.round("score", 6).alias("score"))


# an exam's plan: four sectors of six in turn; the first two are covered, a third of the exams have not begun
logical("plan", "sessions", "exposures", sql="select exam_id, (r + exam_id) % 6 k, sector, item_id from (select distinct exam_id from {sessions}) e join (select sector, min(item_id) item_id, row_number() over (order by sector) - 1 r from {exposures} group by sector) t on (r + exam_id) % 6 < 4")

_NEXT = f"""it as (select distinct item_id, sector, difficulty, case when item_id % 2 = 0 then 'coding' else 'trace' end kind from exposures), g as (select exam_id, exam_id % 3 = 0 fresh from (select distinct exam_id from sessions)),
c as (select g.exam_id, fresh, k, p.sector, it.item_id, difficulty, kind, not fresh and k < 2 cov, 1200e0 + (g.exam_id % 9) * 50e0 + k * 25e0 theta from g join plan p on p.exam_id = g.exam_id join it on it.sector = p.sector
  where case when fresh then kind = 'coding' and difficulty = 1 else k <> 1 and it.item_id <> p.item_id and (k <> 0 or (g.exam_id % 2 = 1 and kind <> 'coding')) end),
v as (select c.*, e.class, e.exposure x, coalesce(s.p, 0e0) p, st.state0 = 'STABLE' and not st.tested stab from c join exposures e on e.item_id = c.item_id left join sessions s on s.exam_id = c.exam_id and s.class = e.class left join states st on st.exam_id = c.exam_id and st.class = e.class),
w as (select *, p * x + (1 - p) * 0.03e0 pf, p * x / (p * x + (1 - p) * 0.03e0) a, p * (1 - x) / (p * (1 - x) + (1 - p) * 0.97e0) b from v),
u as (select *, case when x >= 0.2e0 then {_H.format('p')} - (pf * {_H.format('a')} + (1 - pf) * {_H.format('b')}) else 0e0 end bits from w),
m as (select exam_id, item_id, fresh, sector, cov, kind, sum(bits) eig, sum(case when stab then x else 0e0 end) gh, max(abs(1 / (1 + pow(10e0, (1000 + 200 * difficulty - theta) / 400)) - 0.6e0)) off from u group by all),
n as (select *, eig / case when kind = 'coding' then 1e0 else 0.3e0 end + case when cov then 0e0 else 0.5e0 end - 0.4e0 * off + 0.3e0 * gh score from m),
o as (select exam_id, arg_max(sector, (round(b, 9), translate(substr(sha256(concat(exam_id, ':', exam_id, ':', sector)), 1, 16), '0123456789abcdef', 'fedcba9876543210'))) sector from (select exam_id, sector, max(eig) b from n where fresh group by 1, 2) group by 1),
q as (select n.*, row_number() over (partition by n.exam_id order by round(score, 9) desc, substr(sha256(concat(n.exam_id, ':', n.exam_id, ':', item_id)), 1, 16)) rn from n left join o on o.exam_id = n.exam_id where not fresh or n.sector = o.sector),
z as (select exam_id, item_id, class, coalesce(stab, false) stab, row_number() over (partition by exam_id, item_id order by case when x >= 0.2e0 then round(bits, 9) end desc nulls last, class) r, x from u),
y as (select exam_id, item_id, string_agg(concat(class, case when stab then ' (stable \u2192 recheck)' else '' end), ' and ' order by r) filter (r <= 2 and x >= 0.2e0) about, bool_or(stab) any_, coalesce(bool_or(stab) filter (r <= 2 and x >= 0.2e0), false) told from z group by 1, 2)
select q.exam_id, q.item_id, q.sector, round(score, 6) score, round(eig, 6) eig, concat(q.item_id, ' \u2014 most informative about ', coalesce(about, 'no class above the exposure floor'), '; ', case when cov and not (any_ and not told) then 'highest information per minute' else concat_ws('; ', case when not cov then concat('covers ', q.sector) end, case when any_ and not told then 'rechecks a stable misconception' end) end, '.') reason from q join y on y.exam_id = q.exam_id and y.item_id = q.item_id where rn = 1"""


@query("x_recommend_next", "sessions", "states", "plan", "exposures", sql="with " + _NEXT)
def x_recommend_next(sessions, states, plan, exposures):
    as_map = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    pool = exposures.groupBy("item_id").agg(F.first("sector").alias("sector"), F.first("difficulty").alias("difficulty"), as_map("class", "exposure").alias("exposure")).withColumn("kind", F.when(F.col("item_id") % 2 == 0, "coding").otherwise("trace"))
    k, e = F.col("k"), F.col("exam_id")
    had = lambda c: F.collect_list(F.when((k < 2) & (e % 3 != 0), F.col(c)))
    own = plan.groupBy("exam_id").agg(
        F.collect_list("sector").alias("sectors"), as_map("sector", (1200 + (e % 9) * 50 + k * 25).cast("double").alias("t")).alias("theta"), had("sector").alias("covered"), F.collect_list(F.when(e % 3 != 0, F.col("item_id"))).alias("used"),
        F.max(F.when((k == 1) & (e % 3 != 0), F.col("sector"))).alias("last_sector"), F.map_from_entries(F.collect_list(F.when(k == 0, F.struct("sector", F.lit(2))))).alias("by_sector"), F.count(F.lit(1)).alias("slots"))
    # as many slots as sectors to reach, one more in every second exam
    uncovered = F.size(F.array_except("sectors", "covered"))
    left = F.create_map(F.lit("coding"), F.lit(1), F.lit("trace"), (uncovered - 1 + e % 2).cast("int"))
    own = own.withColumn("left", left).withColumn("learner_id", e)
    p = sessions.groupBy("exam_id").agg(as_map("class", "p").alias("p"))
    state = states.groupBy("exam_id").agg(as_map("class", "state0").alias("states"), F.collect_list(F.when(F.col("tested"), F.col("class"))).alias("tested"))
    rows = own.join(p, "exam_id").join(state, "exam_id")
    return X.recommend_next(rows, pool, per_sector=2).withColumns({c: F.round(c, 6) for c in ("score", "eig")})


@query("x_opening", "sessions", "exposures", sql=f"with {_SCORE}, e as (select s2.*, p.sector from s2 join (select distinct item_id, sector from exposures where difficulty = 1) p on p.item_id = s2.item_id), m as (select exam_id, max_by(sector, (m, sector)) sector from (select exam_id, sector, round(max(eig), 9) m from e group by 1, 2) group by 1) select e.exam_id, round(max(score), 6) score from e join m on m.exam_id = e.exam_id and m.sector = e.sector group by 1")
def x_opening(sessions, exposures):
    return X.opening(*X.score_kinds(*_bank(sessions, exposures))).select("exam_id", F.round("score", 6).alias("score"))


@query("x_eligible", "exam_log", sql="with s as (select exam_id, max_by(sector, seq) ls, list(item_id) used from exam_log where seq <= 3 group by 1), b as (select exam_id, sector, count(*) n from exam_log where seq <= 3 group by 1, 2), c as (select exam_id, item_id, sector, case when item_id % 2 = 0 then 'coding' else 'trace' end kind from exam_log) select c.exam_id, c.item_id, c.sector, c.kind from c join s on s.exam_id = c.exam_id left join b on b.exam_id = c.exam_id and b.sector = c.sector where not list_contains(used, c.item_id) and c.kind = 'coding' and coalesce(n, 0) < 2 and c.sector <> ls")
def x_eligible(exam_log):
    c = exam_log.select("exam_id", "item_id", "sector", F.when(F.col("item_id") % 2 == 0, "coding").otherwise("trace").alias("kind"))
    past = exam_log.filter("seq <= 3")
    n = past.groupBy("exam_id", "sector").agg(F.count(F.lit(1)).cast("int").alias("n")).groupBy("exam_id").agg(F.map_from_entries(F.collect_list(F.struct("sector", "n"))).alias("by_sector"))
    s = past.groupBy("exam_id").agg(F.max_by("sector", "seq").alias("last_sector"), F.collect_list("item_id").alias("used")).join(n, "exam_id").withColumn("left", F.create_map(F.lit("coding"), F.lit(1)))
    return X.eligible(c, s)


_FIND = """s as (select *, case when not tested and ambiguous is null then 'NOT_TESTED' when state = 'RELAPSED' then 'RELAPSED' when state = 'MASTERED' then 'HELD' when (state0 = 'UNSEEN' or p0 <= 0.3e0) and p >= 0.5e0 then 'NEW' when ambiguous is not null or (p >= 0.3e0 and p <= 0.7e0) then 'UNCERTAIN' end status from states),
tw(k, x, y) as (values ('T1', 'M01', 'M08'), ('T2', 'M02', 'M07'), ('T4', 'M03', 'M05'), ('T6', 'D02', 'M02'), ('T7', 'D05', 'D06'), ('T9', 'D01', 'M03')),
tn as (select a.exam_id, a.class, min(k) twin from s a join s b on a.exam_id = b.exam_id and a.status = 'UNCERTAIN' and b.status = 'UNCERTAIN' join tw on (x = a.class and y = b.class) or (x = b.class and y = a.class) group by 1, 2),
fi as (select s.exam_id, s.class, status, coalesce(ambiguous, twin) twin from s left join tn on tn.exam_id = s.exam_id and tn.class = s.class where status is not null)"""


@query("x_eligible_coverage", "exam_log", sql="""with s as (select exam_id, max_by(sector, seq) ls, list(item_id) used, list(distinct sector) cov from exam_log where seq <= 3 group by 1), p as (select exam_id, list(distinct sector) secs from exam_log group by 1), c as (select exam_id, item_id, sector, case when item_id % 2 = 0 then 'coding' else 'trace' end kind from exam_log),
b as (select exam_id, sector, count(*) n from exam_log where seq <= 3 group by 1, 2) select c.exam_id, c.item_id, c.sector, c.kind from c join s on s.exam_id = c.exam_id join p on p.exam_id = c.exam_id left join b on b.exam_id = c.exam_id and b.sector = c.sector
where not list_contains(used, c.item_id) and (c.kind <> 'coding' or coalesce(n, 0) < 2) and c.sector <> ls and len(list_filter(secs, lambda x: not list_contains(cov, x) and x <> c.sector)) <= 1""")
def x_eligible_coverage(exam_log):
    c = exam_log.select("exam_id", "item_id", "sector", F.when(F.col("item_id") % 2 == 0, "coding").otherwise("trace").alias("kind"))
    past = exam_log.filter("seq <= 3")
    n = past.groupBy("exam_id", "sector").agg(F.count(F.lit(1)).cast("int").alias("n")).groupBy("exam_id").agg(F.map_from_entries(F.collect_list(F.struct("sector", "n"))).alias("by_sector"))
    s = past.groupBy("exam_id").agg(F.max_by("sector", "seq").alias("last_sector"), F.collect_list("item_id").alias("used"), F.collect_set("sector").alias("covered")).join(n, "exam_id")
    plan = exam_log.groupBy("exam_id").agg(F.collect_set("sector").alias("sectors"))
    return X.eligible(c, s.join(plan, "exam_id").withColumns({"left": F.create_map(F.lit("coding"), F.lit(1), F.lit("trace"), F.lit(1)), "slots": F.lit(5)}))


@query("x_findings", "states", sql=f"with {_FIND} select * from fi")
def x_findings(states):
    return X.findings(states)


@query("x_recommendations", "states", "attempts", sql=f"with {_FIND}, fam(c, f) as (values ('M01', 'count_loop'), ('M01', 'countdown_loop'), ('M01', 'prefix_loop'), ('M02', 'while_progress'), ('M02', 'count_loop'), ('M03', 'array_accumulate'), ('M03', 'accumulate_product'), ('M03', 'array_count_if'), ('D05', 'rec_array'), ('D05', 'rec_product'), ('D05', 'rec_digits'), ('D01', 'linear_search')), p as (select distinct problem_id, case when problem_id like 'P%' then 'count_loop' else 'rec_array' end f from attempts), u as (select distinct learner_id exam_id, problem_id from attempts), r as (select distinct fi.exam_id, fi.class, p.problem_id from fi join fam on fam.c = fi.class join p on p.f = fam.f where status in ('NEW', 'RELAPSED') and (fi.exam_id, p.problem_id) not in (select exam_id, problem_id from u)) select *, row_number() over (partition by exam_id, class order by problem_id)::int \"rank\" from r qualify row_number() over (partition by exam_id, class order by problem_id) <= 2")
def x_recommendations(states, attempts):
    problems = attempts.select("problem_id", F.when(F.col("problem_id").startswith("P"), "count_loop").otherwise("rec_array").alias("family")).distinct()
    return X.recommendations(X.findings(states), problems, attempts.select(F.col("learner_id").alias("exam_id"), "problem_id").distinct())


@query("x_deferred_probes", "sessions", "exposures", sql=f"with {_SCORE} select exam_id, item_id, round(eig, 6) eig_bits, row_number() over (partition by exam_id order by round(eig, 9) desc, item_id)::int \"rank\" from s2 where eig >= 0.1 qualify row_number() over (partition by exam_id order by round(eig, 9) desc, item_id) <= 3")
def x_deferred_probes(sessions, exposures):
    return X.deferred_probes(X.first_items(*X.score_kinds(*_bank(sessions, exposures))).withColumnRenamed("eig", "eig_bits")).withColumn("eig_bits", F.round("eig_bits", 6))


_SIMPLEX = f"""{_TABLE}, lb as (select distinct label, ord from t), kn as (select exam_id, label, greatest(case when label in ('CORRECT', 'OTHER') then 0.02e0 else coalesce(p, 0.1e0) end, 0.02e0) r from (select distinct exam_id from states) cross join lb left join (select exam_id e2, class, p from states) s on e2 = exam_id and class = label),
sx as (select exam_id, label, r / sum(r) over (partition by exam_id) p from kn)"""


@query("x_knowledge_simplex", "states", "choices", "beliefs", sql=f"with {_SIMPLEX} select exam_id, label, round(p, 6) p from sx")
def x_knowledge_simplex(states, choices, beliefs):
    return X.knowledge_simplex(states.select("exam_id", "class", "p")).withColumn("p", F.round("p", 6))


@query("x_probes_for_uncertain", "states", "choices", "beliefs", sql=f"""with {_FIND}, {_SIMPLEX}, op as (select fi.exam_id, fi.class, s.p from fi join s on s.exam_id = fi.exam_id and s.class = fi.class where fi.status = 'UNCERTAIN'), ab as (select op.exam_id, item_id, min_by(class, (-p, class)) for_class from op join beliefs on label = class group by 1, 2),
j as (select ab.exam_id, ab.item_id, t."option", sx.p * t.p j from ab join sx on sx.exam_id = ab.exam_id join t on t.item_id = ab.item_id and t.label = sx.label), pa as (select exam_id, item_id, "option", sum(j) pa, sum(case when j > 0 then j * log2(j) else 0 end) h from j group by 1, 2, 3), h0 as (select exam_id, -sum(p * log2(p)) h0 from sx group by 1),
e as (select pa.exam_id, item_id, any_value(h0) - sum(pa * log2(pa) - h) e from pa join h0 on h0.exam_id = pa.exam_id group by 1, 2) select e.exam_id, e.item_id, round(e, 6) eig_bits, row_number() over (partition by e.exam_id order by round(e, 9) desc, e.item_id)::int "rank", for_class from e join ab on ab.exam_id = e.exam_id and ab.item_id = e.item_id where e >= 0.1e0 qualify row_number() over (partition by e.exam_id order by round(e, 9) desc, e.item_id) <= 3""")
def x_probes_for_uncertain(states, choices, beliefs):
    return X.probes_for_uncertain(X.findings(states), states.select("exam_id", "class", "p"), _items(choices, beliefs)).withColumn("eig_bits", F.round("eig_bits", 6))


@query("x_adaptivity_log", "exam_log", sql="select exam_id, string_agg(item_id || ':' || sector || ':' || outcome, ',' order by seq) log, count(*) n from exam_log group by 1")
def x_adaptivity_log(exam_log):
    rows = exam_log.select("exam_id", "seq", "item_id", "sector", (F.col("difficulty") / 10).alias("eig_bits"), F.lit("r").alias("reason"), "outcome")
    out = X.adaptivity_log(rows)
    return out.select("exam_id", F.array_join(F.transform("log", lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["sector"], x["outcome"])), ",").alias("log"), F.element_at("log", -1)["order"].cast("long").alias("n"))


@query("x_exam_report", "exam_log", "states", sql=f"with {_FIND}, r as (select exam_id, count(distinct sector)::int n_sectors, sum(passed::int)::bigint n_passed from exam_log group by 1), g as (select exam_id, count(*)::int n_findings from fi group by 1) select r.exam_id, n_sectors, n_passed, n_findings from r left join g on g.exam_id = r.exam_id")
def x_exam_report(exam_log, states):
    log = exam_log.join(X.elo_trajectory(exam_log), ["exam_id", "sector", "seq"])
    r = X.exam_report(X.sector_rollup(log), X.findings(states))
    return r.select("exam_id", F.size("sectors").alias("n_sectors"), F.aggregate("sectors", F.lit(0).cast("long"), lambda a, s: a + s["passed"]).alias("n_passed"), F.when(F.col("findings").isNotNull(), F.size("findings")).alias("n_findings"))


@query("x_starting_p", "states", sql="select exam_id, class, case when tested then p0 when class in ('D01', 'D05') and state0 = 'UNSEEN' then 0.15e0 else 0.1e0 end p0 from states")
def x_starting_p(states):
    return X.starting_p(states.select("exam_id", "class", F.when(F.col("tested"), F.col("p0")).alias("p_active"), F.col("state0").alias("state"))).select("exam_id", "class", "p0")


_TRIAL = """f as (select exam_id, sector, 0::bigint rn, 1400 r from trial_log group by 1, 2 union all select o.exam_id, o.sector, o.rn, case outcome when 'pass' then r + 40 when 'fail' then greatest(1100, r - 30) else greatest(1100, r - 20) end from f join o on o.exam_id = f.exam_id and o.sector = f.sector and o.rn = f.rn + 1),
ts as (select f.exam_id, f.sector, n items, passed, r rating_after from f join (select exam_id, sector, count(*) n, count(*) filter (outcome = 'pass') passed from o group by 1, 2) c on c.exam_id = f.exam_id and c.sector = f.sector and c.n = f.rn),
tc as (select *, case when outcome = 'skip' then coalesce(asked, 'M01') when top in ('CORRECT', 'OTHER') then case when outcome = 'fail' then coalesce(asked, 'M01') end else top end class from trial_log),
tf as (select exam_id, class, case when outcome = 'skip' then 'UNRESOLVED' else 'ACTIVE' end status, case when outcome = 'skip' then 0.7e0 else top_p end p_active, item_id, sector from tc where class is not null qualify row_number() over (partition by exam_id, class order by seq) = 1)"""
_TRIAL = "recursive with o as (select *, row_number() over (partition by exam_id, sector order by seq) rn from trial_log), " + _TRIAL


@query("x_trial_sectors", "trial_log", sql=_TRIAL + " select exam_id, sector, items, passed, 1400 rating_before, rating_after from ts")
def x_trial_sectors(trial_log):
    return X.trial_sectors(trial_log).withColumn("items", F.size("items").cast("long"))


@query("x_trial_findings", "trial_log", sql=_TRIAL + " select * from tf")
def x_trial_findings(trial_log):
    return X.trial_findings(trial_log)


@query("x_trial_debrief", "trial_log", sql=_TRIAL + """, e as (select exam_id, count(*) items_total, count(*) filter (outcome = 'pass') items_passed from trial_log group by 1), rv as (select exam_id, string_agg(sector, ',' order by sector) review from (select exam_id, sector from ts where passed = 0 union select exam_id, sector from tf) group by 1)
select e.exam_id, items_total, items_passed, round_even(100 * items_passed / items_total::double, 0)::int score_pct, (select count(*) from ts where ts.exam_id = e.exam_id) n_sectors, (select count(*) from tf where tf.exam_id = e.exam_id) n_findings, coalesce(review, '') review from e left join rv on rv.exam_id = e.exam_id""")
def x_trial_debrief(trial_log):
    out = X.trial_debrief(trial_log)
    return out.select("exam_id", "items_total", "items_passed", "score_pct", F.size("sectors").cast("long").alias("n_sectors"), F.size("findings").cast("long").alias("n_findings"), F.array_join("review", ",").alias("review"))


@query("x_attach_remediation", "states", sql=f"with {_FIND}, h as (select distinct exam_id, class from fi where status in ('NEW', 'RELAPSED')) select exam_id, class, case class when 'M01' then 'loops' when 'D05' then 'recursion' else 'REVIEW' end advice from h union all select distinct exam_id, null, 'MASTERY' from fi where exam_id not in (select exam_id from h)")
def x_attach_remediation(states):
    guide = states.select("class").distinct().withColumn("advice", F.when(F.col("class") == "M01", "loops").when(F.col("class") == "D05", "recursion")).filter("advice is not null")
    return X.attach_remediation(X.findings(states), guide)


@query("x_changed_classes", "responses", sql="with r as (select learner_id exam_id, class, seq, count(*) filter (correct) over (partition by learner_id, class order by seq) e from responses), l as (select *, coalesce(lag(e) over (partition by exam_id, class order by seq), 0) b from r) select exam_id, seq, class from l where e > b")
def x_changed_classes(responses):
    from pyspark.sql import Window as W

    run = F.count(F.when(F.col("correct"), 1)).over(W.partitionBy("learner_id", "class").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return X.changed_classes(responses.select(F.col("learner_id").alias("exam_id"), "class", "seq", run.alias("evidence")))


# graph: a star for each nation, exposed to three classes; learners are customers with attempts
logical("star_exposure", "nation", sql=" union all ".join(f"select cast(n_nationkey as varchar(9)) star_id, '{c}' class, case when (n_nationkey + {k}) % 3 = 0 then 0.7e0 else 0.4e0 end exposure from {{nation}} where (n_nationkey + {k}) % 2 = 0" for k, c in enumerate(("M01", "M02", "M03", "D01"))))
logical("star_knowledge", "attempts", sql="select learner_id, class, round(0.1e0 + 0.8e0 * avg(case when passed < total then 1e0 else 0e0 end), 6) p_active, case when count(*) % 2 = 0 then 'ACTIVE' else 'STABLE' end state from (select learner_id, top class, passed, total from {attempts} where top in ('M01', 'M02', 'M03', 'D01')) group by learner_id, class")
logical("star_records", "nation", sql="select cast(n_nationkey as varchar(9)) star_id, concat(case when n_nationkey % 2 = 0 then 'P' else 'Q' end, cast(n_nationkey as varchar(9))) record from {nation}")
_HZ = "hz as (select l.learner_id, s.star_id, s.class, s.exposure, round(coalesce(k.p_active, 0.1e0), 4) p, coalesce(k.state, 'UNSEEN') state from (select distinct learner_id from attempts) l cross join star_exposure s left join star_knowledge k on k.learner_id = l.learner_id and k.class = s.class)"
_ST = f"""{_HZ}, rc as (select learner_id, problem_id record, bool_or(passed = total) ok from attempts group by 1, 2), se as (select learner_id, star_id, bool_or(ok) cleared from rc join star_records using (record) group by 1, 2),
ow as (select learner_id, star_id, product(1 - exposure * p) solid, bool_or(state in ('ACTIVE', 'TREATING', 'PROBATION', 'RELAPSED')) live, bool_or(p >= 0.5e0 and exposure * p >= 0.35e0) high from hz group by 1, 2),
st as (select ow.*, coalesce(se.cleared, false) cleared, se.star_id is not null tried from ow left join se on se.learner_id = ow.learner_id and se.star_id = ow.star_id),
ss as (select learner_id, star_id, case when cleared then case when live then 'shaky' else 'known' end when tried then 'attempted' else 'unexplored' end state, cleared, case when cleared then round(solid, 4) end brightness, case when not cleared then round(1 - solid, 4) end risk, high and not cleared at_risk from st)"""


def _stars(attempts, exposure, knowledge, recs):
    hazard = G.hazards(attempts, exposure, knowledge)
    nodes = attempts.select("learner_id", F.concat(F.lit("node:"), "problem_id").alias("node"), F.lit("unstable").alias("status"))
    return hazard, G.star_states(hazard, G.records(attempts, nodes), recs)


@query("g_hazards", "attempts", "star_exposure", "star_knowledge", sql=f"with {_HZ} select learner_id, star_id, class, exposure, p p_active, state from hz")
def g_hazards(attempts, exposure, knowledge):
    return G.hazards(attempts, exposure, knowledge)


@query("g_star_states", "attempts", "star_exposure", "star_knowledge", "star_records", sql=f"with {_ST} select * from ss")
def g_star_states(attempts, exposure, knowledge, recs):
    return _stars(attempts, exposure, knowledge, recs)[1]


_EIG = f"e as (select *, p * exposure + (1 - p) * 0.03e0 pf, p * exposure / (p * exposure + (1 - p) * 0.03e0) a, p * (1 - exposure) / (p * (1 - exposure) + (1 - p) * 0.97e0) b from hz), eg as (select e.learner_id, e.star_id, round(sum({_H.format('p')} - (pf * {_H.format('a')} + (1 - pf) * {_H.format('b')})), 9) bits from e join ss on ss.learner_id = e.learner_id and ss.star_id = e.star_id and not ss.cleared group by 1, 2)"


@query("g_suggested_next", "attempts", "star_exposure", "star_knowledge", "star_records", sql=f"with {_ST}, {_EIG} select learner_id, round(max(bits), 6) bits from eg group by 1")
def g_suggested_next(attempts, exposure, knowledge, recs):
    hazard, states = _stars(attempts, exposure, knowledge, recs)
    return G.suggested_next(hazard, states, recs.select("star_id", F.col("star_id").cast("int").alias("ord"))).select("learner_id", F.round("bits", 6).alias("bits"))


@query("g_topic_rollup", "attempts", "star_exposure", "star_knowledge", "star_records", "nation", sql=f"with {_ST} select learner_id, n_regionkey topic, count(*) total, count(*) filter (cleared) cleared, count(*) filter (state = 'shaky') shaky, count(*) filter (at_risk) at_risk from ss join nation on n_nationkey::varchar = star_id group by 1, 2")
def g_topic_rollup(attempts, exposure, knowledge, recs, nation):
    return G.topic_rollup(_stars(attempts, exposure, knowledge, recs)[1], nation.select(F.col("n_nationkey").cast("string").alias("star_id"), F.col("n_regionkey").alias("topic")))


@query("g_chart_summary", "attempts", "star_exposure", "star_knowledge", "star_records", sql=f"with {_ST} select learner_id, count(*) filter (state = 'known') known, count(*) filter (state = 'shaky') shaky, count(*) filter (state = 'attempted') attempted, count(*) filter (state = 'unexplored') unexplored, count(*) filter (at_risk) at_risk from ss group by 1")
def g_chart_summary(attempts, exposure, knowledge, recs):
    return G.chart_summary(_stars(attempts, exposure, knowledge, recs)[1])


@query("g_check_graph", "nation", sql="recursive with e as (select n_nationkey src, (n_nationkey + 5) % 30 dst from nation where n_regionkey <> 2 union all select n_nationkey, n_nationkey from nation where n_regionkey = 2), r(s, d) as (select src, dst from e union select r.s, e.dst from r join e on e.src = r.d) select 'missing' rule, dst id from (select distinct dst from e) where dst not in (select n_nationkey from nation) union all select distinct 'cycle', d from r where s in (select s from r where s = d)")
def g_check_graph(nation):
    k = F.col("n_nationkey")
    edges = nation.select(k.alias("src"), F.when(F.col("n_regionkey") == 2, k).otherwise((k + 5) % 30).alias("dst"))
    return G.check_graph(nation.select(k.alias("id")), edges)


@query("g_hazard_lists", "attempts", "star_exposure", "star_knowledge", sql=f"with {_HZ} select learner_id, star_id, string_agg(class, ',' order by round(exposure * p, 12) desc, class) classes from hz group by 1, 2")
def g_hazard_lists(attempts, exposure, knowledge):
    out = G.hazard_lists(G.hazards(attempts, exposure, knowledge))
    return out.select("learner_id", "star_id", F.array_join(F.transform("hazards", lambda x: x["class"]), ",").alias("classes"))


@query("g_check_families", "nation", "part", sql="with s as (select n_nationkey id, case when n_nationkey % 4 <> 3 then 'f' || (n_nationkey % 12) end family from nation), p as (select distinct 'f' || (p_size % 15) family from part) select 'no_skill' rule, family id from p where family not in (select family from s where family is not null) union all select 'two_skills', family from s where family is not null group by 2 having count(*) > 1 union all select 'unknown_family', id::varchar from s where family is not null and family not in (select family from p)")
def g_check_families(nation, part):
    k = F.col("n_nationkey")
    skills = nation.select(k.cast("string").alias("id"), F.when(k % 4 != 3, F.concat(F.lit("f"), k % 12)).alias("family"))
    return G.check_families(skills, part.select(F.concat(F.lit("f"), F.col("p_size") % 15).alias("family")))
