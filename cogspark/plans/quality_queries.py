"""Quality rules over documents as a labelled corpus, lineitem as features and attempts as results."""

from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import bayes as B
from ..operators import curate as D
from ..operators import evaluate as E
from ..operators import quality as Q
from .bayes_queries import _items
from .registry import query

_H = r"h as (select *, 'h_' || substr(sha256(trim(regexp_replace(lower(code), '\s+', ' ', 'g'))), 1, 16) hash from corpus)"
_V = lambda df: df.withColumn("value", F.round("value", 6))


@query("q1_counts", "corpus", sql="with l as (select unnest([" + ", ".join(f"'{x}'" for x in C.LABELS) + "]) label), n as (select label, count(*) n from corpus group by 1) select 'Q1' rule_id, case when coalesce(n, 0) < 80 then 'FAIL' else 'PASS' end status, l.label \"key\", coalesce(n, 0)::double \"value\" from l left join n on n.label = l.label")
def q1_counts(corpus):
    return Q.check_counts(corpus, C.LABELS)


@query("q2_drops", "corpus", sql="with a as (select op_id, count(*) a, count(*) filter (id % 5 <> 0) k, count(*) filter (passes_by_luck) l from corpus group by 1) select 'Q2' rule_id, case when k + l > a or l / a > 0.4 then 'FAIL' else 'PASS' end status, op_id \"key\", round((a - k) / a, 6) \"value\" from a")
def q2_drops(corpus):
    return _V(Q.check_drops(D.drop_report(corpus, corpus.filter("id % 5 <> 0"), corpus.filter("passes_by_luck"))))


@query("q3_duplicates", "corpus", sql=f"with {_H}, s as (select hash, list_sort(list(distinct label)) l from h group by 1) select 'Q3' rule_id, case when l <> ['M01', 'M08'] then 'FAIL' else 'PASS' end status, hash \"key\", len(l)::double \"value\" from s where len(l) > 1")
def q3_duplicates(corpus):
    return Q.check_duplicates(D.with_fingerprint(corpus))


@query("a4_label_sets", "corpus", sql=f"with {_H}, s as (select hash, array_to_string(list_sort(list(distinct label)), ',') labels, count(*) n from h group by 1) select labels, count(*) hashes, sum(n)::bigint \"rows\" from s group by 1")
def a4_label_sets(corpus):
    return Q.label_sets(D.with_fingerprint(corpus))


_KS = """l as (select distinct label lab from corpus), s as (select lab, n_chars x, sum((label = lab)::int) a, sum((label <> lab)::int) b from corpus cross join l group by 1, 2),
c as (select *, sum(a) over (partition by lab order by x) ca, sum(b) over (partition by lab order by x) cb, sum(a) over (partition by lab) n1, sum(b) over (partition by lab) n2 from s),
d as (select lab, any_value(n1) n1, any_value(n2) n2, max(abs(ca / n1 - cb / n2)) d from c group by 1), e as (select *, sqrt(n1 * n2 / (n1 + n2)) en from d), f as (select *, (en + 0.12e0 + 0.11e0 / en) * d lam from e),
p as (select *, case when lam < 0.2 then 1 else least(1, greatest(0, list_sum(list_transform(range(1, 101), lambda k: 2 * case when k % 2 = 1 then 1 else -1 end * exp(-2e0 * k * k * lam * lam))))) end p from f)"""


@query("q4_length", "corpus", sql=f"with {_KS} select 'Q4' rule_id, case when least(n1, n2) < 20 then 'SKIP' when d >= 0.25 and p < 0.01 then 'FAIL' else 'PASS' end status, lab \"key\", round(d, 6) \"value\" from p")
def q4_length(corpus):
    return _V(Q.check_length(corpus))


_FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query(
    "q5_stumps",
    "lineitem",
    sql="""with u as (select l_returnflag y, 'l_quantity' f, l_quantity x from lineitem union all select l_returnflag, 'l_discount', l_discount from lineitem union all select l_returnflag, 'l_tax', l_tax from lineitem),
t as (select f, y, count(*) t from u group by 1, 2), g as (select f, x, y, t from (select distinct f, x from u) join t using (f)), b as (select g.f, g.x, g.y, (select count(*) from u where u.f = g.f and u.y = g.y and u.x <= g.x) / t below from g),
m as (select f, x, (max(below) + max(1 - below)) / (select count(distinct y) from u) m from b group by 1, 2) select 'Q5' rule_id, case when max(m) > 0.6 then 'FAIL' else 'PASS' end status, f "key", round(max(m), 6) "value" from m group by f""",
)
def q5_stumps(lineitem):
    rows = lineitem.withColumn("id", F.struct("l_orderkey", "l_linenumber")).withColumn("label", F.col("l_returnflag"))
    return _V(Q.check_stumps(rows, "id", _FEATURES))


@query("q6_bleed", "attempts", sql="select 'Q6' rule_id, case when top <> latent and avg(passed / total) > 0.3 then 'FAIL' else 'PASS' end status, top || '>' || latent \"key\", round(avg(passed / total), 6) \"value\" from attempts where latent is not null group by top, latent")
def q6_bleed(attempts):
    return _V(Q.check_bleed(attempts.filter("latent is not null").select(F.col("top").alias("label"), F.col("latent").alias("predicate"), (F.col("passed") / F.col("total")).alias("share"))))


@query(
    "q7_health",
    "lineitem",
    sql="""with u as (select 'l_quantity' f, l_quantity x from lineitem union all select 'l_discount', l_discount from lineitem union all select 'l_tax', l_tax from lineitem), c as (select f, x, count(*) n from u group by 1, 2), h as (select f, max(n) / sum(n) m from c group by 1),
r as (select 'l_quantity~l_discount' k, corr(l_quantity, l_discount) r from lineitem union all select 'l_quantity~l_tax', corr(l_quantity, l_tax) from lineitem union all select 'l_discount~l_tax', corr(l_discount, l_tax) from lineitem)
select 'Q7' rule_id, case when m >= 0.99 then 'FAIL' else 'PASS' end status, f "key", round(m, 6) "value" from h union all select 'Q7', case when abs(r) > 0.95 then 'FAIL' else 'PASS' end, k, round(r, 6) from r""",
)
def q7_health(lineitem):
    return _V(Q.check_health(lineitem.withColumn("id", F.lit(0)), "id", _FEATURES))


@query("q10_outliers", "embeddings")
def q10_outliers(embeddings):
    """No SQL: random trees. The tests plant an outlier."""
    features = [f"x{i}" for i in range(64)]
    rows = embeddings.select("vec_id", *[F.get("embedding", i).alias(x) for i, x in enumerate(features)])
    return Q.outlier_trees(rows, "vec_id", features).withColumn("score", F.round("score", 6))


@query("q10_outlier_report", "embeddings", sql="with s as (select vec_id::varchar id, list_sum([abs(x::double) for x in embedding]) s from embeddings), c as (select quantile_cont(s, 0.98) c from s) select id, round(s, 6) score, row_number() over (order by s desc, id)::int \"rank\", s > c outlier from s, c order by s desc, id limit 20")
def q10_outlier_report(embeddings):
    """The cut and the twenty first over a score that SQL can express as well; q10_outliers has the trees'."""
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    return Q.outlier_report(embeddings.select(F.col("vec_id").cast("string").alias("id"), total.alias("score"))).withColumn("score", F.round("score", 6))


@query("q11_events", "events", sql="with d as (select distinct user_id id, user_id % 5 c, event_type t from events), n as (select c, count(distinct id) n from d group by 1), e as (select c, t, count(*) k from d group by 1, 2) select 'Q11' rule_id, case when k / n >= 0.5 then 'FAIL' else 'PASS' end status, c || ':' || t \"key\", round(k / n, 6) \"value\" from e join n using (c)")
def q11_events(events):
    return _V(Q.check_events(events.select(F.col("user_id").alias("id"), (F.col("user_id") % 5).cast("string").alias("class"), F.col("event_type").alias("type"))))


@query("q12_kappa", "predictions", sql="with n as (select count(*) n, count(*) filter (truth = pred) s from predictions), a as (select truth k, count(*) x from predictions group by 1), b as (select pred k, count(*) y from predictions group by 1), m as (select sum(x * y) xy from a join b on a.k = b.k), k as (select (s / n - xy / (n * n)) / (1 - xy / (n * n)) k from n, m) select 'Q12' rule_id, case when k < 0.6 then 'FAIL' else 'PASS' end status, 'kappa' \"key\", round(k, 6) \"value\" from k")
def q12_kappa(predictions):
    return _V(Q.check_kappa(E.kappa(predictions, "truth", "pred")))


@query("q13_exposure", "attempts", "exposures", sql="with m as (select problem_id, top, avg((passed < total)::int) m from attempts group by 1, 2), a as (select (case when item_id % 2 = 0 then 'P' else 'Q' end) || (item_id % 40) problem_id, class, max(exposure) e from exposures group by 1, 2) select 'Q13' rule_id, case when abs(m - e) > 0.3 then 'FAIL' else 'PASS' end status, m.problem_id || ':' || top \"key\", round(abs(m - e), 6) \"value\" from m join a on a.problem_id = m.problem_id and a.class = m.top")
def q13_exposure(attempts, exposures):
    name = F.concat(F.when(F.col("item_id") % 2 == 0, "P").otherwise("Q"), F.col("item_id") % 40)
    authored = exposures.groupBy(name.alias("problem_id"), "class").agg(F.max("exposure").alias("exposure"))
    return _V(Q.check_exposure(attempts.select("problem_id", F.col("top").alias("class"), (F.col("passed") < F.col("total")).alias("failed")), authored))


@query("q14_masking", "orders", sql="with o as (select o_orderkey k, case when o_orderkey % 2 = 0 then 'M01' else 'D05' end t from orders), a as (select t, case when t = 'M01' then k % 3 <> 0 or k % 5 = 0 else k % 4 <> 0 end ok from o) select 'Q14' rule_id, case when count(*) filter (not ok) > 0 then 'FAIL' else 'PASS' end status, t \"key\", (count(*) filter (not ok))::double \"value\" from a group by t")
def q14_masking(orders):
    from .bayes_queries import _p0

    k = F.col("o_orderkey")
    features = orders.select(k.alias("key"), F.when(k % 5 != 0, (k % 3).cast("double")).alias("f1"), (k % 4).cast("double").alias("f2"))
    masked = B.mask_posterior(_p0(orders).select("key", "label", "p"), features, {"M01": ["f1"], "D05": ["f2"]})
    return Q.check_masking(masked.withColumn("truth", F.when(F.col("key") % 2 == 0, "M01").otherwise("D05")))


@query("q15_problems", "part", sql="with p as (select p_partkey id, p_size % 5 t, p_size % 3 s, p_retailprice / 2000 e, p_size % 7 v from part) select id::varchar problem_id, 'tests' rule from p where t < 1 union all select id::varchar, 'samples' from p where s < 1 union all select id::varchar, 'exposure' from p where e < 0 or e > 1 union all select id::varchar, 'variants' from p where v < 1")
def q15_problems(part):
    size = F.col("p_size")
    return Q.check_problems(part.select(F.col("p_partkey").cast("string").alias("problem_id"), (size % 5).alias("n_tests"), (size % 3).alias("n_samples"), F.array(F.col("p_retailprice") / 2000).alias("exposures"), (size % 7).alias("n_variants")))


@query("q16_items", "choices", "beliefs", sql="with b as (select item_id, list(believed) bs from beliefs group by 1), c as (select c.item_id, case when k % 10 = 0 then c.options[1:2] else c.options end o, correct, bs from choices c join b on b.item_id = c.item_id) select item_id, 'options' rule from c where len(o) < 3 union all select item_id, 'correct' from c where not list_contains(o, correct) union all select item_id, 'belief' from c where len(list_filter(bs, lambda x: not list_contains(o, x))) > 0 union all select item_id, 'belief_correct' from c where list_contains(bs, correct)")
def q16_items(choices, beliefs):
    return Q.check_items(_items(choices.withColumn("options", F.when(F.col("k") % 10 == 0, F.slice("options", 1, 2)).otherwise(F.col("options"))), beliefs))


@query("q17_targets", "exposures", sql="with n as (select class, count(*) n from exposures group by 1), t(c, t) as (values ('M01', 900), ('M02', 1100), ('D08', 1)) select 'Q17' rule_id, case when coalesce(n, 0) < t then 'FAIL' else 'PASS' end status, c \"key\", coalesce(n, 0)::double \"value\" from t left join n on n.class = t.c")
def q17_targets(exposures):
    return Q.check_targets(exposures, {"M01": 900, "M02": 1100, "D08": 1}, "class")
