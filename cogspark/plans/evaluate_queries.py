"""Evaluation over embeddings as predictions: their label is the truth, their first ten components are logits."""

from pyspark.sql import functions as F

from ..operators import evaluate as E
from .registry import query

_R = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


@query("e_confusion", "predictions", sql="select truth, pred, count(*) n, round(count(*) / sum(count(*)) over (partition by truth), 6) share from predictions group by 1, 2")
def e_confusion(predictions):
    return _R(E.confusion(predictions), "share")


@query("e_soft_truth", "predictions", sql="select id, case when pred = truth or (id % 4 = 0 and pred = 'c1') then pred else truth end truth from predictions")
def e_soft_truth(predictions):
    soft = F.when((F.col("id") % 4 == 0) & (F.col("truth") != "c1"), F.map_from_arrays(F.array("truth", F.lit("c1")), F.array(F.lit(0.6), F.lit(0.4)))).otherwise(F.create_map("truth", F.lit(1.0)))
    return E.soft_truth(predictions.withColumn("truths", soft)).select("id", "truth")


_PRF = "c as (select domain, truth, pred, count(*) n from predictions group by 1, 2, 3), u as (select domain, truth cl, n s, 0 p, case when truth = pred then n else 0 end tp from c union all select domain, pred, 0, n, 0 from c), k as (select domain, cl, sum(s) s, sum(p) p, sum(tp) tp from u group by 1, 2)"


@query("e_prf", "predictions", sql=f'with {_PRF} select domain, cl "class", round(case when p > 0 then tp / p else 0 end, 6) "precision", round(case when s > 0 then tp / s else 0 end, 6) recall, round(case when s + p > 0 then 2 * tp / (s + p) else 0 end, 6) f1, s::bigint support, p::bigint predicted from k')
def e_prf(predictions):
    return _R(E.prf(predictions, ("domain",)), "precision", "recall", "f1")


@query("e_macro_f1", "predictions", sql=f"with {_PRF} select domain, round(avg(2 * tp / (s + p)) filter (s > 0), 6) macro_f1, round(avg(tp / s) filter (s > 0), 6) macro_recall, round(sum(tp) / sum(s), 6) accuracy from k group by 1")
def e_macro_f1(predictions):
    return _R(E.macro_f1(predictions, ("domain",)), "macro_f1", "macro_recall", "accuracy")


_SOFT = "z as (select vec_id, label y, list_transform(embedding[1:10], lambda x: x::double / 2.0) l from embeddings), e as (select *, list_transform(l, lambda x: exp(x - list_max(l))) e from z), p as (select y, list_transform(e, lambda x: x / list_sum(e)) p from e), q as (select list_max(p) conf, (list_position(p, list_max(p)) - 1 = y)::int hit, -ln(greatest(p[y + 1], 1e-12)) nll, list_sum(list_transform(p, lambda x: x * x)) - 2 * p[y + 1] + 1 brier from p)"
_BIN = ", b as (select (" + " + ".join(f"(conf >= {i / 10}e0)::int" for i in range(1, 10)) + ") bin, count(*) n, sum(conf) c, sum(hit) h, sum(nll) nll, sum(brier) br from q group by 1)"


def _logits(embeddings):
    return embeddings.select(F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("logits"), F.col("label").alias("y"))


@query("e_calibration", "embeddings", sql=f"with {_SOFT}{_BIN} select round(sum(nll) / sum(n), 6) nll, round(sum(br) / sum(n), 6) brier, round(sum(abs(h - c)) / sum(n), 6) ece from b")
def e_calibration(embeddings):
    return _R(E.calibration(_logits(embeddings), 2.0), "nll", "brier", "ece")


@query("e_reliability", "embeddings", sql=f"with {_SOFT}{_BIN} select bin, bin / 10 lo, (bin + 1) / 10 hi, n \"count\", round(c / n, 6) confidence, round(h / n, 6) accuracy from b")
def e_reliability(embeddings):
    return _R(E.reliability(_logits(embeddings), 2.0), "confidence", "accuracy")


@query("e_fit_temperature", "embeddings")
def e_fit_temperature(embeddings):
    """No SQL: a search. The tests hold it against a fine grid."""
    logits = _logits(embeddings)
    t = E.fit_temperature(logits)
    return _R(E.calibration(logits, t).withColumn("t", F.lit(t)), "nll", "brier", "ece", "t")


@query("e_kappa", "predictions", sql="with n as (select count(*) n, count(*) filter (truth = pred) s from predictions), a as (select truth k, count(*) x from predictions group by 1), b as (select pred k, count(*) y from predictions group by 1), m as (select sum(x * y) xy from a join b on a.k = b.k) select n, round(s / n, 6) observed, round(xy / (n * n), 6) expected, round((s / n - xy / (n * n)) / (1 - xy / (n * n)), 6) kappa from n, m")
def e_kappa(predictions):
    return _R(E.kappa(predictions, "truth", "pred"), "observed", "expected", "kappa")


@query("e_auroc", "predictions", sql="with c as (select domain, conf s, count(*) filter (y = 3) p, count(*) filter (y <> 3) q from predictions group by 1, 2), r as (select *, sum(q) over (partition by domain order by s) - q below from c) select domain, round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 6) auroc, (sum(p) + sum(q))::bigint n from r group by 1")
def e_auroc(predictions):
    return _R(E.auroc(predictions.withColumn("hit", (F.col("y") == 3).cast("int")), "conf", "hit", ("domain",)), "auroc")


_DRAW = "k as (select cluster, row_number() over (order by cluster) - 1 k from (select distinct cluster from predictions)), d as (select rep, (('0x' || substr(md5('42:' || rep || ':' || k), 1, 8))::bigint % (select count(*) from k))::int k from k cross join range(200) r(rep)), w as (select rep, k, count(*) w from d group by 1, 2)"


@query("e_cluster_bootstrap", "predictions", sql=f"with {_DRAW}, c as (select cluster, count(*) n, sum((truth = pred)::int)::double h from predictions group by 1), s as (select rep, sum(w * h) / sum(w * n) s from w join k on k.k = w.k join c on c.cluster = k.cluster group by 1) select (select sum(n) from c)::bigint n, (select count(*) from c) n_clusters, round((select sum(h) / sum(n) from c), 6) estimate, round(quantile_cont(s, 0.025), 6) lo, round(quantile_cont(s, 0.975), 6) hi, count(s) valid from s")
def e_cluster_bootstrap(predictions):
    return _R(E.cluster_bootstrap(predictions, "cluster", {"h": (F.col("truth") == F.col("pred")).cast("double"), "m": F.lit(1.0)}, F.col("h") / F.col("m")), "estimate", "lo", "hi")


_W = " + ".join(f"(u >= {t})::int" for t in E.POISSON)


@query("e_bootstrap", "predictions", sql=f"with u as (select rep, conf, (('0x' || substr(md5('42:' || rep || ':' || id), 1, 8))::bigint) / 4294967296e0 u from predictions cross join range(120) r(rep)), s as (select sum(conf * ({_W})) / sum({_W}) s from u group by rep) select (select count(*) from predictions) n, round((select avg(conf) from predictions), 6) estimate, round(quantile_cont(s, 0.025), 6) lo, round(quantile_cont(s, 0.975), 6) hi from s")
def e_bootstrap(predictions):
    return _R(E.bootstrap(predictions, "id", {"h": F.col("conf"), "m": F.lit(1.0)}, F.col("h") / F.col("m"), reps=120).select("n", "estimate", "lo", "hi"), "estimate", "lo", "hi")


@query("e_t_interval", "predictions", sql="with s as (select domain, avg(conf) m, stddev_samp(conf) sd, count(*) n from predictions group by 1) select domain, round(m, 6) mean, round(m - 1.959964e0 * sd / sqrt(n), 6) lo, round(m + 1.959964e0 * sd / sqrt(n), 6) hi, n from s")
def e_t_interval(predictions):
    return _R(E.t_interval(predictions, "conf", ("domain",)), "mean", "lo", "hi")


@query("e_risk_coverage", "predictions", sql="""with c as (select conf d, count(*) n, sum((truth <> pred)::int) w from predictions group by 1), r as (select *, sum(n) over (order by d) upto, sum(w) over (order by d) bad, sum(n) over () total from c), a as (select *, g / 10e0 coverage from r cross join range(1, 11) t(g)), k as (select *, greatest(1, round(coverage * total)) k from a)
select coverage, k::bigint "rows", round((bad - w + w / n * (k - (upto - n))) / k, 6) risk from k where upto >= k and upto - n < k""")
def e_risk_coverage(predictions):
    return _R(E.risk_coverage(predictions.withColumn("wrong", (F.col("truth") != F.col("pred")).cast("int")), "conf", "wrong"), "risk")


@query("e_threshold_at_precision", "predictions", sql="with c as (select round(conf, 2) tau, count(*) n, sum((y <> 3)::int) h from predictions group by 1), r as (select tau, sum(n) over (order by tau desc) n, sum(h) over (order by tau desc) h from c) select coalesce(min(tau) filter (n >= 10 and h / n >= 0.9), 1.01) tau from r")
def e_threshold_at_precision(predictions):
    return E.threshold_at_precision(predictions.withColumn("hit", (F.col("y") != 3).cast("int")), "conf", "hit")


@query("e_tau_d", "lineitem", sql="select round(quantile_cont(l_extendedprice, 0.99), 6) tau_d from lineitem")
def e_tau_d(lineitem):
    return _R(E.tau_d(lineitem, "l_extendedprice"), "tau_d")


@query("e_twin_accuracy", "predictions", sql="with r as (select *, case when truth in ('c1', 'c2') then 'T1' when truth in ('c3', 'c4') then 'T2' end t from predictions) select t twin_set, count(*) n, round(avg(case when truth in ('c1', 'c3') then (conf >= 0.5)::int else (conf < 0.5)::int end), 6) accuracy from r where t is not null group by 1")
def e_twin_accuracy(predictions):
    # the first of a pair has the confidence, the second what it leaves
    probs = F.map_from_arrays(F.array(*[F.lit(f"c{i}") for i in range(1, 5)]), F.array(F.col("conf"), 1 - F.col("conf"), F.col("conf"), 1 - F.col("conf")))
    return _R(E.twin_accuracy(predictions.withColumn("probs", probs), {"T1": ("c1", "c2"), "T2": ("c3", "c4")}), "accuracy")


@query("e_topk_accuracy", "embeddings", sql="with l as (select vec_id id, label y, generate_subscripts(embedding[1:10], 1) - 1 k, unnest(embedding[1:10]) p from embeddings), r as (select *, row_number() over (partition by id order by p desc, k) rk from l), t as (select id, rk from r where k = y) select k, round(sum((rk <= k)::int) / (select count(*) from embeddings), 6) accuracy, (select count(*) from embeddings) n from t cross join (values (1), (3)) v(k) group by 1")
def e_topk_accuracy(embeddings):
    rows = embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("truth"), F.posexplode(F.slice("embedding", 1, 10)).alias("label", "p"))
    return _R(E.topk_accuracy(rows), "accuracy")


@query("e_slice_report", "predictions", sql="select 'domain' slice, domain \"value\", count(*) n, round(avg((truth = pred)::int), 6) accuracy from predictions group by 2 union all select 'problem_id', problem_id, count(*), round(avg((truth = pred)::int), 6) from predictions group by 2")
def e_slice_report(predictions):
    return _R(E.slice_report(predictions, ["domain", "problem_id"]), "accuracy")


@query("e_rejection_report", "predictions", sql="with s as (select case when conf < 0.5 then 'unsure' when pred = 'c0' then 'correct_reasoning' else 'matched' end status, conf from predictions) select status, count(*) n, round(count(*) / sum(count(*)) over (), 6) share, round(avg(conf), 6) mean_conf from s group by 1")
def e_rejection_report(predictions):
    return _R(E.rejection_report(predictions.withColumn("status", F.when(F.col("conf") < 0.5, "unsure").when(F.col("pred") == "c0", "correct_reasoning").otherwise("matched"))), "share", "mean_conf")


@query("e_failure_audit", "predictions", sql="select domain, problem_id, truth, pred, count(*) n, min(id) first_id from predictions where truth <> pred and conf >= 0.6 group by 1, 2, 3, 4")
def e_failure_audit(predictions):
    return E.failure_audit(predictions, ["domain", "problem_id"])


@query("e_robustness", "predictions", sql="with a as (select id, 'r' || (id % 3) rewrite, case when id % 5 = 0 then 'c0' else pred end a from predictions where id % 4 <> 1) select rewrite, count(*) n, round(avg((a = pred)::int), 6) unchanged, round(avg((pred = truth)::int), 6) acc_before, round(avg((a = truth)::int), 6) acc_after from predictions p join a on a.id = p.id group by 1")
def e_robustness(predictions):
    after = predictions.select("id", F.concat(F.lit("r"), F.col("id") % 3).alias("rewrite"), F.when(F.col("id") % 5 == 0, "c0").otherwise(F.col("pred")).alias("pred"), (F.col("id") % 4 != 1).alias("keeps"))
    return _R(E.robustness(predictions, after), "unchanged", "acc_before", "acc_after")


@query("e_metric_table", "predictions", sql="select domain \"name\", round(avg(conf) filter (problem_id = 'p0'), 6) p0, round(avg(conf) filter (problem_id = 'p1'), 6) p1 from predictions group by 1")
def e_metric_table(predictions):
    return _R(E.metric_table(predictions.select(F.col("domain").alias("name"), F.col("problem_id").alias("split"), F.col("conf").alias("value")), ["p0", "p1"]), "p0", "p1")


@query("e_fold_stats", "predictions", sql="select domain \"name\", round(avg(conf), 6) mean, round(stddev_pop(conf), 6) std from predictions group by 1")
def e_fold_stats(predictions):
    return _R(E.fold_stats(predictions.select(F.col("domain").alias("name"), F.col("conf").alias("value"))), "mean", "std")


@query("e_profile_f1", "embeddings", sql="with l as (select vec_id id, generate_subscripts(embedding[1:17], 1) k, unnest(embedding[1:17])::double p from embeddings), r as (select id, 1 / (1 + exp(-p)) p, (id + k) % 3 = 0 t from l), s as (select id, count(*) filter (p >= 0.5 and t) tp, count(*) filter (p >= 0.5) a, count(*) filter (t) b, avg(pow(p - t::int, 2)) br from r group by 1) select id, round(case when a + b = 0 then 1 else 2 * tp / (a + b) end, 6) f1, round(br, 6) brier from s")
def e_profile_f1(embeddings):
    rows = embeddings.select(F.col("vec_id").alias("id"), F.posexplode(F.slice("embedding", 1, 17)).alias("k", "x"))
    rows = rows.select("id", F.col("k").alias("class"), (1 / (1 + F.exp(-F.col("x").cast("double")))).alias("p"), ((F.col("id") + F.col("k") + 1) % 3 == 0).alias("truth"))
    return _R(E.profile_f1(rows), "f1", "brier")


@query("e_policy_outcomes", "attempts", sql="with e as (select sector type, status policy, attempt_id % 5 seed, passed = total resolved, latent is not null active, total n from attempts) select type, policy, seed, round(avg(resolved::int) filter (active), 6) false_resolve, round(avg((not resolved)::int) filter (not active), 6) false_not_yet, round(avg(n) filter (resolved), 6) items from e group by 1, 2, 3")
def e_policy_outcomes(attempts):
    rows = attempts.select(F.col("sector").alias("type"), F.col("status").alias("policy"), (F.col("attempt_id") % 5).alias("seed"), (F.col("passed") == F.col("total")).alias("resolved"), F.col("latent").isNotNull().alias("active"), F.col("total").alias("n_items"))
    return _R(E.policy_outcomes(rows), "false_resolve", "false_not_yet", "items")


@query("e_agreement", "attempts", sql="select sector, count(*) n, round(avg((latent is not null and top is not null)::int), 6) covered, round(avg((latent = top)::int) filter (latent is not null), 6) agree from attempts group by 1")
def e_agreement(attempts):
    return _R(E.agreement(attempts, "latent", "top", ("sector",)), "covered", "agree")


@query("e_holdout_scores", "predictions", sql="with b as (select truth, avg((truth = pred)::int) a, count(*) n from predictions group by 1) select round(avg(a), 6) class_mean, round(sum(a * n) / sum(n), 6) micro, count(*) n_classes, sum(n)::bigint n from b")
def e_holdout_scores(predictions):
    return _R(E.holdout_scores(predictions), "class_mean", "micro")


@query("e_external_counts", "documents", "corpus", sql="select source, count(*) n, count(*) filter (doc_id in (select id from corpus where split = 'holdout')) in_bank, count(distinct doc_id) problems from documents group by 1")
def e_external_counts(documents, corpus):
    return E.external_counts(documents.withColumnRenamed("doc_id", "id"), corpus.filter("split = 'holdout'"), "source", "id")


@query("e_why_gain", "predictions", sql="""with l as (select id, 'p' || (id % 4) pair, k, y % 4 t, case when k = id % 4 or k = (id + 1) % 4 then 0.4e0 else 0.1e0 end po, case when k = y % 4 then conf else 0.1e0 end pt from predictions cross join range(4) r(k)), m as (select *, po * pow(0.02e0 + pt, 0.5e0) pw from l),
c as (select *, case when po >= max(po) over (partition by id) - 1e-9 then 1 else 0 end a, case when pw >= max(pw) over (partition by id) - 1e-9 then 1 else 0 end b from m), d as (select *, a / sum(a) over (partition by id) ca, b / sum(b) over (partition by id) cb from c)
select pair, count(*) n, round(avg(ca), 6) option_alone, round(avg(cb), 6) with_text, round(avg(cb - ca), 6) gain from d where k = t group by 1""")
def e_why_gain(predictions):
    i, k = F.col("id"), F.col("label")
    rows = predictions.select("id", "y", "conf", F.explode(F.array(*[F.lit(x) for x in range(4)])).alias("label"))
    rows = rows.select("id", F.concat(F.lit("p"), i % 4).alias("pair"), "label", (F.col("y") % 4).alias("truth"), F.when((k == i % 4) | (k == (i + 1) % 4), 0.4).otherwise(0.1).alias("p_option"), F.when(k == F.col("y") % 4, F.col("conf")).otherwise(0.1).alias("p_text"))
    return _R(E.why_gain(rows), "option_alone", "with_text", "gain")


@query("w_learning_curve", "attempts", sql="with a as (select sector policy, learner_id learner, row_number() over (partition by sector, learner_id order by ts, attempt_id) item, passed / total f1 from attempts), b as (select * from a where item <= 6), s as (select policy, learner, item from (select distinct policy, learner from b) cross join range(1, 7) r(item)), j as (select s.*, (select b.f1 from b where b.policy = s.policy and b.learner = s.learner and b.item <= s.item order by b.item desc limit 1) f1 from s) select policy, item::int item, round(avg(f1), 6) f1 from j group by 1, 2")
def w_learning_curve(attempts):
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("sector", "learner_id").orderBy("ts", "attempt_id"))
    rows = attempts.select(F.col("sector").alias("policy"), F.col("learner_id").alias("learner"), n.alias("item"), (F.col("passed") / F.col("total")).alias("f1")).filter("item <= 6")
    return _R(E.learning_curve(rows, 6), "f1")


@query("e_row_stochastic", "predictions", sql="with l(x) as (select 'c' || r from range(12) t(r)), n as (select truth, pred, count(*) n, sum(count(*)) over (partition by truth) t from predictions group by 1, 2) select a.x truth, b.x pred, round(case when a.x in (select truth from n) then coalesce(n / t, 0) else (a.x = b.x)::int end, 6) p from l a cross join l b left join n on n.truth = a.x and n.pred = b.x")
def e_row_stochastic(predictions):
    return _R(E.row_stochastic(predictions, [f"c{i}" for i in range(12)]), "p")


@query("e_auroc_interval", "predictions", sql=f"""with {_DRAW}, c as (select cluster, conf s, count(*) filter (y = 3) p, count(*) filter (y <> 3) q from predictions group by 1, 2), g as (select rep, s, sum(w * p) p, sum(w * q) q from w join k on k.k = w.k join c on c.cluster = k.cluster group by 1, 2), r as (select *, sum(q) over (partition by rep order by s) - q below from g), a as (select rep, case when sum(p) > 0 and sum(q) > 0 then sum(p * (below + q / 2)) / (sum(p) * sum(q)) end a from r group by 1),
g0 as (select s, sum(p) p, sum(q) q from c group by 1), r0 as (select *, sum(q) over (order by s) - q below from g0) select round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 6) estimate, (sum(p) + sum(q))::bigint n, (select count(*) from k) n_clusters, (select case when count(a) >= 100 then round(quantile_cont(a, 0.025), 6) end from a) lo, (select case when count(a) >= 100 then round(quantile_cont(a, 0.975), 6) end from a) hi, (select count(a) from a) valid from r0""")
def e_auroc_interval(predictions):
    return _R(E.auroc_interval(predictions.withColumn("hit", (F.col("y") == 3).cast("int")), "cluster", "conf", "hit"), "estimate", "lo", "hi")


@query("e_auroc_overall", "predictions", sql="with c as (select conf s, count(*) filter (y = 3) p, count(*) filter (y <> 3) q from predictions group by 1), r as (select *, sum(q) over (order by s) - q below from c) select round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 6) auroc, (sum(p) + sum(q))::bigint n from r")
def e_auroc_overall(predictions):
    return _R(E.auroc(predictions.withColumn("hit", (F.col("y") == 3).cast("int")), "conf", "hit"), "auroc")


@query("e_abstain_report", "predictions", sql="with r as (select conf < 0.5 a, y >= 8 f, truth <> pred w from predictions) select count(*) n, round(avg(a::int), 6) abstained, round(avg((f or w)::int) filter (a), 6) abstain_precision, round(avg(a::int) filter (f), 6) foreign_caught, round(avg(w::int) filter (not a and not f), 6) risk_kept from r")
def e_abstain_report(predictions):
    rows = predictions.select((F.col("conf") < 0.5).alias("a"), (F.col("y") >= 8).alias("f"), (F.col("truth") != F.col("pred")).alias("w"))
    return _R(E.abstain_report(rows, "a", "f", "w"), "abstained", "abstain_precision", "foreign_caught", "risk_kept")


@query("e_threshold_on_grid", "predictions", sql="with g as (select round(0.05 + i / 100, 2)::double tau from range(91) t(i)), r as (select tau, count(*) n, sum((y <> 3 or conf > 0.9)::int) h from g join predictions on round(conf, 9) >= round(tau, 9) group by 1) select coalesce((select min(tau) from r where h / n >= 0.9), 0.95::double) tau")
def e_threshold_on_grid(predictions):
    return E.threshold_on_grid(predictions.withColumn("hit", ((F.col("y") != 3) | (F.col("conf") > 0.9)).cast("int")), "conf", "hit")


@query("e_twin_summary", "predictions", sql="with r as (select *, case when truth in ('c1', 'c2') then 'T1' when truth in ('c3', 'c4') then 'T2' end t from predictions), s as (select t, count(*) n, avg(case when truth in ('c1', 'c3') then (conf >= 0.5)::int else (conf < 0.5)::int end) a from r where t is not null group by 1) select sum(n)::bigint n, round(avg(a), 6) mean_of_sets, round(sum(n * a) / sum(n), 6) micro from s")
def e_twin_summary(predictions):
    probs = F.map_from_arrays(F.array(*[F.lit(f"c{i}") for i in range(1, 5)]), F.array(F.col("conf"), 1 - F.col("conf"), F.col("conf"), 1 - F.col("conf")))
    return _R(E.twin_summary(E.twin_accuracy(predictions.withColumn("probs", probs), {"T1": ("c1", "c2"), "T2": ("c3", "c4")})), "mean_of_sets", "micro")


@query("e_answer_rate", "predictions", sql="select domain, count(*) n, round(avg((conf >= 0.5)::int), 6) answer_rate, round(avg((truth = pred)::int) filter (conf >= 0.5), 6) right_when_answers from predictions group by 1")
def e_answer_rate(predictions):
    return _R(E.answer_rate(predictions.withColumn("pred", F.when(F.col("conf") >= 0.5, F.col("pred"))), ("domain",)), "answer_rate", "right_when_answers")


@query("e_rejection_errors", "predictions", sql="select pred, count(*) n, row_number() over (order by count(*) desc, pred)::int \"rank\" from predictions where conf >= 0.5 and pred <> 'c0' group by 1 order by n desc, pred limit 5")
def e_rejection_errors(predictions):
    return E.rejection_errors(predictions.withColumn("status", F.when(F.col("conf") < 0.5, "unsure").when(F.col("pred") == "c0", "correct_reasoning").otherwise("matched")))


@query("e_top_confusions", "predictions", sql="select truth, pred, count(*) n, row_number() over (order by count(*) desc, truth, pred)::int \"rank\" from predictions where truth <> pred group by 1, 2 order by n desc, truth, pred limit 10")
def e_top_confusions(predictions):
    return E.top_confusions(predictions)


@query("e_false_alarms", "predictions", sql="select 'r' || (id % 3) rewrite, count(*) n, round(avg((case when id % 5 = 0 then 'c1' else pred end <> truth)::int), 6) false_alarm from predictions where id % 4 <> 1 and truth = 'c0' group by 1")
def e_false_alarms(predictions):
    right = lambda c: F.when(c == "c0", "CORRECT").otherwise(c)
    after = predictions.select(F.concat(F.lit("r"), F.col("id") % 3).alias("rewrite"), right(F.col("truth")).alias("truth"), right(F.when(F.col("id") % 5 == 0, "c1").otherwise(F.col("pred"))).alias("pred"), (F.col("id") % 4 != 1).alias("keeps"))
    return _R(E.false_alarms(after), "false_alarm")


@query("e16_slice_intervals", "predictions", sql=f"""with {_DRAW}, c as (select domain v, cluster, count(*) n, sum((truth = pred)::int)::double h from predictions group by 1, 2), s as (select v, rep, sum(w * h) / sum(w * n) s from w join k on k.k = w.k join c on c.cluster = k.cluster group by 1, 2)
select 'domain' slice, c.v \"value\", sum(n)::bigint n, round(sum(h) / sum(n), 6) accuracy, (select round(quantile_cont(s, 0.025), 6) from s where s.v = c.v) lo, (select round(quantile_cont(s, 0.975), 6) from s where s.v = c.v) hi, (select count(*) from s where s.v = c.v) valid from c group by c.v""")
def e16_slice_intervals(predictions):
    return _R(E.slice_intervals(predictions, ["domain"], "cluster"), "accuracy", "lo", "hi")


def _means(base: str, values: list[str], whole: str | None = None) -> str:
    """SQL of mean_intervals: base gives g, cluster and the values."""
    each = lambda f: ", ".join(f.replace("?", v) for v in values)
    sums = f"count(*) n, {each('sum(?)::double ?')} from base"
    every = f" union all select '{whole}', cluster, {sums} group by cluster" if whole else ""
    return (
        f"with base as ({base}), {_DRAW.replace('from predictions', 'from base')}, c as (select g, cluster, {sums} group by g, cluster{every}), s as (select g, rep, {each('sum(w * ?) / sum(w * n) ?')} from w join k on k.k = w.k join c on c.cluster = k.cluster group by 1, 2), p as (select g, sum(n)::bigint n, count(*) n_clusters, {each('sum(?) / sum(n) ?')} from c group by 1), "
        f"e as (select g, count(*) valid, {each('quantile_cont(?, 0.025) ?_lo, quantile_cont(?, 0.975) ?_hi')} from s group by 1), r as (select p.g, n, n_clusters, {each('round(?, 6) ?, case when valid >= 100 then round(?_lo, 6) end ?_lo, case when valid >= 100 then round(?_hi, 6) end ?_hi')}, coalesce(valid, 0)::bigint valid from p left join e on e.g = p.g)"
    )


def _ends(*names: str) -> list[str]:
    return [n + e for n in names for e in ("", "_lo", "_hi")]


_REWRITTEN = "select p.id, truth, pred b, cluster, 'r' || (p.id % 3) g, case when p.id % 5 = 0 then 'c0' else pred end a, p.id % 4 <> 1 keeps, p.id % 7 <> 0 same from predictions p"


@query("e19_robustness_report", "predictions", sql=_means(f"select g, cluster, (a = b)::int unchanged, same::int identical, (b = truth)::int acc_before, (a = truth)::int acc_after from ({_REWRITTEN}) where keeps", ["unchanged", "identical", "acc_before", "acc_after"]) + f", n as (select g, count(*) applicable, count(*) filter (not keeps) dropped from ({_REWRITTEN}) group by 1) select r.* rename (g as rewrite), applicable, dropped from r join n on n.g = r.g")
def e19_robustness_report(predictions):
    i = F.col("id")
    after = predictions.select("id", F.concat(F.lit("r"), i % 3).alias("rewrite"), F.when(i % 5 == 0, "c0").otherwise(F.col("pred")).alias("pred"), (i % 4 != 1).alias("keeps"), (i % 7 != 0).alias("identical"))
    return _R(E.robustness_report(predictions, after, "cluster"), *_ends("unchanged", "identical", "acc_before", "acc_after"))


@query("e26_holdout_report", "predictions", sql=_means("select truth g, cluster, (pred = truth or (id % 3 = 0 and pred = 'c1'))::int accuracy, (pred = truth)::int own from predictions", ["accuracy", "own"], "_micro") + " select * rename (g as truth, own as \"primary\", own_lo as primary_lo, own_hi as primary_hi) from r")
def e26_holdout_report(predictions):
    labels = F.when(F.col("id") % 3 == 0, F.array("truth", F.lit("c1"))).otherwise(F.array("truth"))
    return _R(E.holdout_report(predictions.withColumn("labels", labels), "cluster"), *_ends("accuracy", "primary"))


@query("e26_holdout_skips", "predictions", sql="with n as (select truth, count(distinct domain) filter (id % 2 = 0 and truth < 'c4') k from predictions group by 1), l(label) as (select 'c' || r from range(12) t(r)) select label, coalesce(k, 0) operators, coalesce(k, 0) || ' base operator(s), at least 2 are needed' reason from l left join n on truth = label where coalesce(k, 0) < 2")
def e26_holdout_skips(predictions):
    op = F.when((F.col("id") % 2 == 0) & (F.col("truth") < "c4"), F.col("domain")).otherwise(F.concat(F.col("domain"), F.lit("+other")))
    return E.holdout_skips(predictions.select(F.col("truth").alias("label"), op.alias("op_id")), [f"c{i}" for i in range(12)])


@query("e17_rejection_by_grade", "predictions", sql="select case when y >= 4 then 'or_more' else 'under' end graded, count(*) n, round(avg((conf < 0.5)::int), 6) unsure, round(avg((conf >= 0.5 and pred <> 'c0')::int), 6) matched_wrongly from predictions where y is not null group by 1")
def e17_rejection_by_grade(predictions):
    rows = predictions.withColumn("status", F.when(F.col("conf") < 0.5, "unsure").when(F.col("pred") == "c0", "correct_reasoning").otherwise("matched"))
    return _R(E.rejection_by_grade(rows, "y"), "unsure", "matched_wrongly")


@query("e18_failure_members", "predictions", sql="select domain, problem_id, truth, pred, count(*) over (partition by domain, problem_id, truth, pred) n, id from predictions where truth <> pred and conf >= 0.6")
def e18_failure_members(predictions):
    return E.failure_members(predictions, ["domain", "problem_id"])


_WHY = """with l as (select id, cluster, conf < 0.4 unsure, 'p' || (id % 4) g, k, y % 4 t, case when k = id % 4 or k = (id + 1) % 4 then 0.4e0 else 0.1e0 end po, case when k = y % 4 then conf else 0.1e0 end pt from predictions cross join range(4) r(k)), m as (select *, po * pow(0.02e0 + pt, 0.5e0) pa, case when unsure then po else po * pow(0.02e0 + pt, 0.5e0) end pw from l),
x as (select *, (po >= max(po) over (partition by id) - 1e-9)::int a, (pw >= max(pw) over (partition by id) - 1e-9)::int b, (pa >= max(pa) over (partition by id) - 1e-9)::int z from m), v as (select *, a / sum(a) over (partition by id) option_alone, b / sum(b) over (partition by id) with_text, z / sum(z) over (partition by id) always_text from x)
select g, cluster, option_alone, with_text, always_text, with_text - option_alone gain, always_text - option_alone gain_always from v where k = t"""


@query("e21_why_report", "predictions", sql=_means(_WHY, ["option_alone", "with_text", "always_text", "gain", "gain_always"], "_all") + " select 'cluster' as \"cluster\", r.* rename (g as pair) from r")
def e21_why_report(predictions):
    i, k = F.col("id"), F.col("label")
    rows = predictions.select("id", "y", "conf", "cluster", F.explode(F.array(*[F.lit(x) for x in range(4)])).alias("label"))
    rows = rows.select("id", "cluster", (F.col("conf") < 0.4).alias("unsure"), F.concat(F.lit("p"), i % 4).alias("pair"), "label", (F.col("y") % 4).alias("truth"), F.when((k == i % 4) | (k == (i + 1) % 4), 0.4).otherwise(0.1).alias("p_option"), F.when(k == F.col("y") % 4, F.col("conf")).otherwise(0.1).alias("p_text"))
    return _R(E.why_report(rows, ["cluster"]), *_ends("option_alone", "with_text", "always_text", "gain", "gain_always"))
