"""Knowledge tracing over the answers (events) and attempts (orders, lineitem)."""

from pyspark.sql import functions as F

from ..operators import knowledge as K
from .registry import logical, query

#: the ratios of an answer, as SQL
_RATIOS = """g as (select *, case kind when 'trap' then 0.15e0 when 'predict_output' then 0.2e0 when 'transfer_code' then 0.30e0 when 'belief_mcq' then 0.2e0 when 'ghost' then 0.25e0 when 'same_family_code' then 0.45e0 end g0,
  case kind when 'trap' then 0.10e0 when 'predict_output' then 0.10e0 when 'transfer_code' then 0.15e0 when 'belief_mcq' then 0.10e0 when 'ghost' then 0.15e0 when 'same_family_code' then 0.10e0 end s from responses),
h as (select *, case when hint and g0 is not null then least(0.9e0, g0 + 0.2e0) else g0 end gg from g),
r as (select *, case when correct then gg else 1 - gg end a, case when correct then 1 - s else s end n from h)"""
_FOLD = f"""recursive with {_RATIOS},
o as (select *, row_number() over (partition by learner_id, class order by ts, seq) rn from r),
f as (select learner_id, class, rn, ts, seq, kind, 0.1e0::double p0, case when kind = 'intervention_done' then 0.1e0 * 0.65e0 else 0.1e0 * a / (0.1e0 * a + 0.9e0 * n) end p, case when a is null then 0 else 1 end seen from o where rn = 1
  union all select o.learner_id, o.class, o.rn, o.ts, o.seq, o.kind, f.p, case when o.kind = 'intervention_done' then f.p * 0.65e0 else f.p * o.a / (f.p * o.a + (1 - f.p) * o.n) end, f.seen + case when o.a is null then 0 else 1 end
  from f join o on o.learner_id = f.learner_id and o.class = f.class and o.rn = f.rn + 1)"""


@query(
    "k_riskiest_classes",
    "responses",
    sql=f"""with {_RATIOS},
p as (select learner_id, class, 1 / (1 + exp(-(ln(0.1e0 / 0.9e0) + sum(ln(a / n))))) p_active, count(*) times_seen from r where a is not null group by 1, 2)
select learner_id, class, round(p_active, 6) p_active, times_seen, row_number() over (partition by learner_id order by p_active desc, class)::int "rank" from p qualify row_number() over (partition by learner_id order by p_active desc, class) <= 3""",
)
def k_riskiest_classes(responses):
    found = K.riskiest(K.knowledge_ratios(responses))
    return found.select("learner_id", "class", F.round("p_active", 6).alias("p_active"), "times_seen", "rank")


@query("k_knowledge_fold", "responses", sql=_FOLD + " select learner_id, class, round(p, 6) p_active, seen::bigint times_seen, (select max(ts) from o x where x.learner_id = f.learner_id and x.class = f.class) last_tested from f qualify row_number() over (partition by learner_id, class order by rn desc) = 1")
def k_knowledge_fold(responses):
    return K.knowledge_fold(responses).select("learner_id", "class", F.round("p_active", 6).alias("p_active"), "times_seen", "last_tested")


@query("k_belief_product", "responses", sql=_FOLD + " select learner_id, class, round(p, 6) p_active from f qualify row_number() over (partition by learner_id, class order by rn desc) = 1")
def k_belief_product(responses):
    return K.belief_product(responses, chunk=4).select("learner_id", "class", F.round("p_active", 6).alias("p_active"))


@query("k_knowledge_trajectory", "responses", sql=_FOLD + " select learner_id, class, ts, seq, kind, round(round(p0, 12), 6) p_before, round(round(p, 12), 6) p_after from f")
def k_knowledge_trajectory(responses):
    """Cut to 12 digits first, as products in another order may differ in the last one."""
    return K.knowledge_trajectory(responses).withColumns({c: F.round(F.round(c, 12), 6) for c in ("p_before", "p_after")})


_MASTERY = f"""recursive with {_RATIOS},
o as (select *, row_number() over (partition by learner_id, class order by ts, seq) rn from r),
tf as (select 'M01' c, ['count_loop', 'countdown_loop', 'prefix_loop'] fs union all select 'M02', ['while_progress', 'count_loop'] union all select 'M03', ['array_accumulate', 'accumulate_product', 'array_count_if'] union all select 'D01', ['linear_search'] union all select 'D05', ['rec_product', 'rec_digits', 'rec_array']),
f as (select distinct learner_id, class, 0::bigint rn, 0.1e0::double p, 'UNSEEN' state, 0::bigint seen, false trap, false transfer from o
  union all
  select learner_id, class, rn, p, case when kind = 'intervention_done' then state
      when state in ('STABLE', 'MASTERED') and (p >= 0.5e0 or (kind = 'ghost' and not correct)) then 'RELAPSED'
      when state = 'UNSEEN' and p >= 0.5e0 then 'ACTIVE'
      when state = 'PROBATION' then case when p > 0.5e0 then 'TREATING' when p < 0.15e0 and trap and transfer then 'STABLE' else 'PROBATION' end
      when state = 'STABLE' and kind = 'ghost' and correct and p < 0.1e0 then 'MASTERED' else state end, seen, trap, transfer
  from (select learner_id, class, rn, kind, correct, state, case when kind = 'intervention_done' then p else q * a / (q * a + (1 - q) * n) end p, seen + case when kind = 'intervention_done' then 0 else 1 end seen,
      trap or (kind = 'trap' and correct) trap, transfer or (kind = 'transfer_code' and correct and counts) transfer
    from (select *, case when kind = 'ghost' and state in ('STABLE', 'MASTERED') then 1 - (1 - p) * pow(0.95e0, levels) else p end q
      from (select learner_id, class, rn, kind, correct, a, n, levels, counts, seen, case when begun = 'TREATING' then p * 0.65e0 else p end p, case when begun = 'TREATING' then 'PROBATION' else begun end state, trap and begun <> 'TREATING' trap, transfer and begun <> 'TREATING' transfer
        from (select o.learner_id, o.class, o.rn, o.kind, o.correct, o.a, o.n, o.levels, f.p, f.seen, f.trap, f.transfer, list_contains(tf.fs, o.family) counts,
            case when f.state in ('ACTIVE', 'RELAPSED') and o.kind in ('trap', 'transfer_code', 'same_family_code', 'predict_output', 'intervention_done') then 'TREATING' else f.state end begun
          from f join o on o.learner_id = f.learner_id and o.class = f.class and o.rn = f.rn + 1 join tf on tf.c = o.class)))))"""


@query("k_mastery_fold", "responses", sql=_MASTERY + " select learner_id, class, round(p, 6) p_active, state, seen times_seen, trap trap_passed, transfer transfer_passed from f qualify row_number() over (partition by learner_id, class order by rn desc) = 1")
def k_mastery_fold(responses):
    return K.mastery_fold(responses).select("learner_id", "class", F.round("p_active", 6).alias("p_active"), "state", "times_seen", "trap_passed", "transfer_passed")


_END = "e as (select learner_id, class, p p_active, state, seen times_seen, trap trap_passed, transfer transfer_passed from f qualify row_number() over (partition by learner_id, class order by rn desc) = 1)"


# predicted outputs: those that the class's belief names are traps, the others plain questions
logical("belief_responses", "responses", sql="select learner_id, class, seq, ts, case when kind in ('trap', 'ghost') then 'predict_output' else kind end kind, correct, hint, levels, family, item_id, kind = 'trap' in_belief from {responses}")


@query("k8_belief_traps", "belief_responses", sql=_MASTERY.replace("from responses)", "from (select * replace (case when kind = 'predict_output' and in_belief then 'trap' else kind end as kind) from belief_responses))") + " select learner_id, class, round(p, 6) p_active, state, seen times_seen, trap trap_passed, transfer transfer_passed from f qualify row_number() over (partition by learner_id, class order by rn desc) = 1")
def k8_belief_traps(belief_responses):
    return K.mastery_fold(belief_responses).select("learner_id", "class", F.round("p_active", 6).alias("p_active"), "state", "times_seen", "trap_passed", "transfer_passed")


@query("k_reassess_conditions", "responses", sql=_MASTERY + f", {_END} select learner_id, class, 'p_active' id, p_active < 0.15e0 met, printf('%.2f', p_active) detail from e union all select learner_id, class, 'trap', trap_passed, '' from e union all select learner_id, class, 'transfer', transfer_passed, '' from e")
def k_reassess_conditions(responses):
    return K.reassess_conditions(K.mastery_fold(responses))


@query("k_learner_prior", "responses", sql=_MASTERY + f", {_END} select learner_id, class, round(p_active, 6) p from e where learner_id in (select learner_id from e group by 1 having bool_or(state <> 'UNSEEN' or times_seen > 0))")
def k_learner_prior(responses):
    return K.learner_prior(K.mastery_fold(responses)).filter("prior is not null").select("learner_id", F.explode("prior").alias("class", "p")).withColumn("p", F.round("p", 6))


_BANK = "b as (select distinct 'I' || (p_partkey % 40) item_id, class, case when p_partkey % 2 = 0 then 'trap' else 'transfer' end type, case p_partkey % 3 when 0 then 'count_loop' when 1 then 'array_accumulate' else 'rec_array' end family from part cross join (values ('M01'), ('M02'), ('M03'), ('D01'), ('D05')) c(class))"


@query(
    "k_next_probation_item",
    "responses",
    "part",
    sql=_MASTERY + f""", {_END}, {_BANK} select learner_id, e.class, min_by(item_id, [(case when type = 'trap' then '0' else '1' end), item_id]) item_id from e join b on b.class = e.class join tf on tf.c = e.class
where state = 'PROBATION' and case when type = 'trap' then not trap_passed else not transfer_passed and list_contains(tf.fs, family) end group by 1, 2""",
)
def k_next_probation_item(responses, part):
    n = F.col("p_partkey")
    bank = part.select(F.concat(F.lit("I"), n % 40).alias("item_id"), F.explode(F.array(*map(F.lit, ("M01", "M02", "M03", "D01", "D05")))).alias("class"), F.when(n % 2 == 0, "trap").otherwise("transfer").alias("type"), F.when(n % 3 == 0, "count_loop").when(n % 3 == 1, "array_accumulate").otherwise("rec_array").alias("family")).distinct()
    return K.next_probation_item(K.mastery_fold(responses), bank)


_UPDATES = """u as (select learner_id, case when kind = 'signature_failure' then top else latent end class, ts, attempt_id seq, kind, exposure from (select *, case
  when not (total > 0 and passed = total) and top <> 'CORRECT' and status in ('confident', 'two_bug') and top_p >= 0.5e0 then 'signature_failure'
  when total > 0 and passed = total and latent is not null then 'latent_pass' end kind from attempts) where kind is not null)"""


@query("k_attempt_updates", "attempts", sql=f"with {_UPDATES} select * from u")
def k_attempt_updates(attempts):
    return K.attempt_updates(attempts)


@query("k_attempt_knowledge", "attempts", sql=f"with {_UPDATES}, v as (select *, coalesce(exposure, 0.5e0) * case kind when 'latent_pass' then 0.5e0 else 1e0 end a from u) select learner_id, class, round(1 / (1 + exp(-(ln(0.1e0 / 0.9e0) + sum(ln(a / 0.03e0))))), 6) p_active, count(*) times_seen from v group by 1, 2")
def k_attempt_knowledge(attempts):
    return K.knowledge_ratios(K.attempt_updates(attempts)).select("learner_id", "class", F.round("p_active", 6).alias("p_active"), "times_seen")


@query(
    "j_asof_prior",
    "attempts",
    sql=f"""with {_UPDATES}, v as (select *, coalesce(exposure, 0.5e0) * case kind when 'latent_pass' then 0.5e0 else 1e0 end a from u),
t as (select learner_id, class, ts, seq, 1 / (1 + exp(-(ln(0.1e0 / 0.9e0) + sum(ln(a / 0.03e0)) over (partition by learner_id, class order by ts, seq)))) p from v)
select a.attempt_id, t.class, round(round(max_by(t.p, (t.ts, t.seq)), 12), 6) p from attempts a join t on t.learner_id = a.learner_id and t.ts < a.ts group by 1, 2""",
)
def j_asof_prior(attempts):
    return K.asof_prior(attempts, K.knowledge_trajectory(K.attempt_updates(attempts))).withColumn("p", F.round(F.round("p", 12), 6))


@query("k_node_status", "attempts", sql="select learner_id, problem_id node, max_by(case when total > 0 and passed = total then 'done' else 'unstable' end, (ts, attempt_id)) status, max(case when total > 0 and passed = total then 3 else 0 end)::int stars from attempts group by 1, 2")
def k_node_status(attempts):
    return K.node_status(attempts.withColumn("node", F.col("problem_id")))


@query("k_areas_complete", "attempts", sql="with n as (select learner_id, sector, max_by(total > 0 and passed = total, (ts, attempt_id)) ok from attempts group by 1, 2) select learner_id, count(*) filter (ok and sector in ('1-URGENT', '2-HIGH')) = 2 complete from n group by 1")
def k_areas_complete(attempts):
    return K.areas_complete(K.node_status(attempts.withColumn("node", F.col("sector"))), ["1-URGENT", "2-HIGH"])


@query(
    "k_learner_snapshot",
    "responses",
    "attempts",
    sql=_MASTERY + f", {_END}, k as (select learner_id, count(*) n_classes, round(sum(round(p_active, 6)), 6) p_sum from e group by 1), a as (select learner_id, count(*) n_attempts, sum(passed)::bigint n_passed from attempts group by 1) select coalesce(k.learner_id, a.learner_id) learner_id, n_classes::int n_classes, p_sum, n_attempts::int n_attempts, n_passed from k full join a on a.learner_id = k.learner_id",
)
def k_learner_snapshot(responses, attempts):
    s = K.learner_snapshot(K.mastery_fold(responses), attempts)
    total = lambda c, f, z: F.when(F.col(c).isNotNull(), F.aggregate(c, z, lambda a, x: a + x[f]))
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return s.select("learner_id", n("knowledge").alias("n_classes"), F.round(total("knowledge", "p_active", F.lit(0.0)), 6).alias("p_sum"), n("attempts").alias("n_attempts"), total("attempts", "passed", F.lit(0).cast("long")).alias("n_passed"))


@query(
    "k_reason_updates",
    "responses",
    sql="with s as (select *, row_number() over (partition by learner_id, item_id order by ts, seq) n from responses) select learner_id, item_id, class, seq from s where n = 1 and not hint and correct and (seq % 10) / 10e0 >= 0.6e0",
)
def k_reason_updates(responses):
    s = responses.withColumns({"unsure": F.col("hint"), "matched": F.col("correct"), "p_text": (F.col("seq") % 10) / 10})
    return K.reason_updates(s).select("learner_id", "item_id", "class", "seq")
