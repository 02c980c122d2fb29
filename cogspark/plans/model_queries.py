"""Models over embeddings and attempts; sources and streams over the given tables."""

import re
import uuid

from pyspark.sql import functions as F

from .. import sources as S
from .. import streaming as ST
from ..functions import columns as L
from ..functions import constants as C
from ..operators import boosting as G
from ..operators import models as M
from ..operators import text as T
from ..operators.shared import written
from .bayes_queries import _TABLE, _items
from .knowledge_queries import _FOLD, _MASTERY
from .registry import logical, query

_R = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
#: All components of an embedding.
_X = [f"x{i}" for i in range(64)]


def _wide(embeddings):
    return embeddings.select("vec_id", F.concat(F.lit("c"), "label").alias("label"), *[F.get("embedding", i).cast("double").alias(x) for i, x in enumerate(_X)], (F.col("vec_id") % 4).alias("fold"))


@query("m1_majority", "corpus", sql="select max_by(label, (n, label)) label from (select label, count(*) n from corpus group by 1)")
def m1_majority(corpus):
    return M.majority(corpus)


#: The features that the rules read. Each is made from a line's keys: mostly 0, now and then null.
_FEATURES = sorted({m for rule in C.RULES.values() for m in re.findall(r"[abr]_\w+", rule)})
logical("rule_features", "lines", sql="select l_orderkey * 10 + rn id, cast(case when l_linenumber = 3 then null when l_returnflag = 'N' then 1 else 0.5e0 end as double) b_pass_frac, " + ", ".join(f"cast(case when (l_partkey + {k}) % 19 = 0 then null when (l_partkey * {2 * k + 3} + l_suppkey) % 97 < {2 if not f.startswith('a_base') and f != 'a_update_present' else 60} then 1 else 0 end as double) {f}" for k, f in enumerate(_FEATURES)) + " from {lines}")
_RULE = "case " + " ".join("when " + re.sub(r"\b([abr]_\w+)\b(?!\s*[<>])", r"\1 <> 0", rule) + f" then '{label}'" for label, rule in C.RULES.items()) + " when b_pass_frac is null or b_pass_frac >= 1 then 'CORRECT' else 'OTHER' end"


@query("m2_rule_engine", "rule_features", sql=f"with z as (select id, b_pass_frac, {', '.join(f'coalesce({f}, 0) {f}' for f in _FEATURES)} from rule_features) select id, {_RULE} pred from z")
def m2_rule_engine(rule_features):
    return M.rule_engine(rule_features).select("id", "pred")


@query("m4_trees_out_of_fold", "embeddings")
def m4_trees_out_of_fold(embeddings):
    """No SQL: fitted forests. The tests check one row for each id and label, summing to 1."""
    rows = _wide(embeddings)
    return _R(M.oof(rows, "fold", lambda t: M.fit_trees(t, _X, "label", trees=5, depth=4), lambda m, t: M.score(m, t, _X, "vec_id", 1.5)), "p")


def _fitted(df, features, configs, rounds, label="label", id="id", fold=None):
    binned = G.bin_rows(df, features, G.quantile_edges(df, features, 16), label, id, fold, F.pmod(F.xxhash64(id), F.lit(4)) == 0)
    truths = df.select(F.col(id).alias("id"), F.create_map(F.col(label), F.lit(1.0)).alias("truths"))
    return G.cross_validate(binned, configs, truths, rounds, 3)[1]


@query("m4_boosted_grid", "embeddings")
def m4_boosted_grid(embeddings):
    """Scores of each configuration out of fold. No SQL: fitted trees. The tests hold the trees against a plain loop."""
    scores = _fitted(_wide(embeddings), _X, G.grid((4, 7), (20,), (0.6,), depth=3, rate=0.3), 4, id="vec_id", fold=F.col("vec_id") % 2)
    return _R(scores, "macro_f1_mean", "macro_f1_std", "log_loss_mean")


@query("m3_boosted_text", "conversations")
def m3_boosted_text(conversations):
    """The role of a turn by boosted trees over its most frequent TF-IDF terms. No SQL: fitted trees."""
    rows = conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text").dropDuplicates(["id"])
    wide, columns = G.text_columns(T.tfidf(rows), 64)
    return _R(_fitted(wide.join(rows.select("id", "role"), "id"), columns, [G.Config(7, 5, 0.5, 3, 0.3)], 4, "role", fold=F.pmod(F.floor(F.col("id") / 1000), F.lit(2))), "macro_f1_mean", "macro_f1_std", "log_loss_mean")


_CONFIG = """w as (select vec_id id, cast(vec_id % 4 as int) fold, concat('c', label) truth, list_transform(embedding[1:10], lambda x: x::double) v from embeddings),
x as (select id, fold, truth, config, list_transform(v, lambda x: exp(x * config)) e from w, (values (1), (2), (3)) c(config)),
p as (select id, fold, config, truth, list_transform(e, lambda x: x / list_sum(e)) p from x),
r as (select *, 'c' || (list_position(p, list_max(p)) - 1) pred, -ln(greatest(p[substr(truth, 2)::int + 1], 1e-12)) loss from p),
c as (select config, fold, truth, pred, count(*) n from r group by 1, 2, 3, 4),
u as (select config, fold, truth cl, n s, 0 q, case when truth = pred then n else 0 end tp from c union all select config, fold, pred, 0, n, 0 from c),
k as (select config, fold, cl, sum(s) s, sum(q) q, sum(tp) tp from u group by 1, 2, 3),
m as (select config, fold, avg(2 * tp / (s + q)) filter (s > 0) f1 from k group by 1, 2), l as (select config, fold, avg(loss) loss, count(*) n from r group by 1, 2),
a as (select config, avg(f1) macro_f1_mean, stddev_pop(f1) macro_f1_std, avg(loss) log_loss_mean, sum(n)::bigint n from m join l using (config, fold) group by 1)"""


def _config_scores(embeddings):
    """Scores of three configurations whose probabilities are the softmax of ten components, sharper from one to the next."""
    e = embeddings.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 4).cast("int").alias("fold"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("config"), F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("v"))
    e = e.select("id", "fold", "config", F.transform("v", lambda x: F.exp(x * F.col("config"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    p = e.select("config", "fold", "id", total.alias("t"), F.posexplode("e").alias("k", "x")).select("config", "fold", "id", F.concat(F.lit("c"), "k").alias("label"), (F.col("x") / F.col("t")).alias("p"))
    truths = embeddings.select(F.col("vec_id").alias("id"), F.create_map(F.concat(F.lit("c"), "label"), F.lit(1.0)).alias("truths"))
    return G.config_scores(p, truths)


@query("m4_config_scores", "embeddings", sql=f"with {_CONFIG} select config, round(macro_f1_mean, 6) macro_f1_mean, round(macro_f1_std, 6) macro_f1_std, round(log_loss_mean, 6) log_loss_mean, n from a")
def m4_config_scores(embeddings):
    return _R(_config_scores(embeddings), "macro_f1_mean", "macro_f1_std", "log_loss_mean")


@query("m4_select_config", "embeddings", sql=f"with {_CONFIG} select config, round(log_loss_mean, 6) log_loss_mean from a order by round(macro_f1_mean, 6) desc, a.log_loss_mean, config limit 1")
def m4_select_config(embeddings):
    return _R(G.select_config(_config_scores(embeddings)).select("config", "log_loss_mean"), "log_loss_mean")


logical("masked", "lineitem", sql="select l_orderkey * 10 + l_linenumber id, " + ", ".join(f"max(case when (l_partkey + {k}) % 4 = 0 then null when (l_partkey + {k}) % 4 = 1 then 1e0 else 0e0 end) {f}" for k, f in enumerate(sorted({f for need in C.MASK_PRECONDITIONS.values() for f in need}))) + ", (max(l_partkey) % 7) / 10e0 x from {lineitem} group by l_orderkey * 10 + l_linenumber")
_MASKED = " union all ".join(f"select id, '{c}' label, {v} p, " + (" and ".join(f"coalesce({f} = 0, false)" for f in C.MASK_PRECONDITIONS.get(c, [])) or "false") + " gone from masked" for c, v in (("D05", "x"), ("D08", "(1 - x) / 2"), ("D02", "(1 - x) / 2"), ("M01", "case when id % 3 = 0 then 0e0 else 1e0 end")))


@query("m5_mask", "masked", sql=f"with z as ({_MASKED}), t as (select *, case when gone then 0 else p end q, sum(case when gone then 0 else p end) over (partition by id) s, sum(p) over (partition by id) a from z) select id, label, round(case when s > 0 then q / s else p / a end, 6) p from t")
def m5_mask(masked):
    x = F.col("x")
    p = masked.select("id", F.explode(F.create_map(F.lit("D05"), x, F.lit("D08"), (1 - x) / 2, F.lit("D02"), (1 - x) / 2, F.lit("M01"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(1.0))).alias("label", "p"))
    return _R(G.mask(p, masked).select("id", "label", "p"), "p")


@query("m6_novelty_space", "embeddings", sql="with u as (" + " union all ".join(f"select 'x{i}' feature, embedding[{i + 1}]::double x from embeddings" for i in range(64)) + ") select feature, round(median(x), 6) median, round(avg(x), 6) mean, round(stddev_pop(x), 6) sd from u group by 1 having stddev_pop(x) > 0")
def m6_novelty_space(embeddings):
    return _R(M.fit_novelty(_wide(embeddings), _X, "vec_id")[0], "median", "mean", "sd")


@query("j_knn", "embeddings", sql="with p as (select a.vec_id id, b.vec_id ref_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::double - b.embedding[i]::double) ** 2))), 9) d from embeddings a join embeddings b on a.vec_id <> b.vec_id) select id vec_id, ref_id, round(d, 6) dist, row_number() over (partition by id order by d, ref_id)::int \"rank\" from p qualify row_number() over (partition by id order by d, ref_id) <= 5")
def j_knn(embeddings):
    v = embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return _R(M.knn_join(v, v, "vec_id"), "dist")


@query("m7_novelty_distance", "embeddings", sql="with p as (select a.vec_id id, b.vec_id ref_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::double - b.embedding[i]::double) ** 2))) d from embeddings a join embeddings b on a.vec_id <> b.vec_id), r as (select id, d from p qualify row_number() over (partition by id order by d, ref_id) <= 5) select id vec_id, round(avg(d), 6) knn_dist from r group by 1")
def m7_novelty_distance(embeddings):
    v = embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return _R(M.novelty_distance(M.knn_join(v, v, "vec_id"), "vec_id"), "knn_dist")


@query("m8_assess_novelty", "predictions", sql="select id, conf > 0.9 or id % 7 >= 5 or (conf < 0.5 and id % 3 <> 0) abstain from predictions")
def m8_assess_novelty(predictions):
    rows = predictions.select("id", F.col("conf").alias("knn_dist"), F.col("conf").alias("p1"), (F.col("id") % 7 / 10.0).alias("p_other"), F.when(F.col("id") % 3 == 0, "T1").alias("twin_set"))
    return M.assess_novelty(rows, 0.9, 0.5).select("id", "abstain")


@query("m9_stump_auc", "lineitem", sql="with u as (select (l_returnflag = 'R')::int y, l_quantity x, 'l_quantity' f from lineitem union all select (l_returnflag = 'R')::int, l_tax, 'l_tax' from lineitem), t as (select f, y, count(*) t from u group by 1, 2), g as (select d.f, d.x, t.y, (select count(*) from u where u.f = d.f and u.y = t.y and u.x <= d.x) / t b from (select distinct f, x from u) d join t on t.f = d.f), m as (select f, x, (max(b) + max(1 - b)) / 2 m from g group by 1, 2) select f feature, round(max(m), 6) auc from m group by 1")
def m9_stump_auc(lineitem):
    rows = lineitem.withColumns({"id": F.lit(0), "y": (F.col("l_returnflag") == "R").cast("int")})
    return _R(M.stump_auc(rows, ["l_quantity", "l_tax"], "id", "y").select("feature", "auc"), "auc")


@query("e24_nearest_description", "embeddings", sql="with v as (select vec_id id, 'c' || label label, list_transform(embedding, lambda x: x::double) v from embeddings), a as (select label, arg_min(v, id) a from v group by 1), c as (select v.id, a.label, list_cosine_similarity(v, a) c from v cross join a) select id, label, round(c, 6) cosine from c qualify row_number() over (partition by id order by round(c, 12) desc, label) = 1")
def e24_nearest_description(embeddings):
    v = embeddings.select(F.col("vec_id").alias("id"), F.concat(F.lit("c"), "label").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    anchors = v.groupBy("label").agg(F.min_by("vector", "id").alias("vector"))
    return _R(M.nearest_description(v, anchors).filter("rank = 1").select("id", "label", "cosine"), "cosine")


@query("q8_shift_report", "embeddings")
def q8_shift_report(embeddings):
    """Boosted trees, an interval from groups, and the features that gain most. No SQL: fitted trees."""
    rows = _wide(embeddings).withColumns({"side": (F.substring("label", 2, 9).cast("int") >= 5).cast("int"), "g": F.col("vec_id") % 20})
    return _R(G.check_shift(rows, _X, "side", "g", "vec_id", 3, 4, G.Config(7, 5, 0.7, 3, 0.3)), "value")


@query("q8_shift", "embeddings")
def q8_shift(embeddings):
    """No SQL: fitted forests. The sides are the labels' halves. The tests hold it between no and full separation."""
    rows = _wide(embeddings).withColumn("side", (F.substring("label", 2, 9).cast("int") >= 5).cast("int"))
    return _R(M.adversarial_auc(rows, _X, "side", "fold", "vec_id"), "auroc")


@query("m7_oof_distance", "embeddings", sql="""with u as (select vec_id, vec_id % 4 fold, i, embedding[i]::double x from embeddings cross join range(1, 65) r(i)), st as (select f.fold, i, avg(x) m, stddev_pop(x) sd from u join (select distinct fold from u) f on u.fold <> f.fold group by 1, 2),
q as (select u.vec_id, u.fold, list((x - m) / sd order by u.i) z from u join st on st.fold = u.fold and st.i = u.i group by 1, 2), r as (select u.vec_id, st.fold, list((x - m) / sd order by u.i) z from u join st on st.i = u.i and u.fold <> st.fold group by 1, 2),
p as (select q.vec_id, list_distance(q.z, r.z) d from q join r on r.fold = q.fold qualify row_number() over (partition by q.vec_id order by list_distance(q.z, r.z), r.vec_id) <= 5) select vec_id, round(avg(d), 6) knn_dist from p group by 1""")
def m7_oof_distance(embeddings):
    return _R(M.oof_distance(_wide(embeddings), "fold", _X, "vec_id"), "knn_dist")


@query("m9_stump_auc_oof", "lineitem")
def m9_stump_auc_oof(lineitem):
    """No SQL: a split for each fold. The tests hold it against plain loops."""
    rows = lineitem.withColumns({"id": F.lit(0), "fold": F.col("l_orderkey") % 3, "y": (F.col("l_returnflag") == "R").cast("int")})
    return _R(M.stump_auc(rows, ["l_quantity", "l_tax"], "id", "y", "fold"), "auc")


@query("q9_separation", "embeddings")
def q9_separation(embeddings):
    """No SQL: principal components. The tests hold both figures against plain loops."""
    return _R(M.check_projection(_wide(embeddings), _X, "vec_id", "label"), "value")


@query("q9_projection", "embeddings")
def q9_projection(embeddings):
    """No SQL: principal components, whose signs are free."""
    return _R(M.projection(_wide(embeddings), _X, "vec_id", "label"), "pc1", "pc2")


# scalar functions
@query("f_scalars", "attempts", sql="""select attempt_id, case when problem_id like 'P%' then 'main' when problem_id like 'Q%' then 'dsa' else 'other' end "domain", case when top_p >= 0.75 then 'Likely' when top_p >= 0.45 then 'Possible' else 'Unsure' end band, case when total < 24 then 16 when total < 40 then 6 else 4 end aug, round(1 / (1 + pow(10e0, (1000 + 200 * difficulty - 1300e0) / 400)), 6) p_pass, substr(sha256(learner_id || ':' || attempt_id || ':x'), 1, 16) tie,
case least(top, coalesce(latent, 'zz')) || greatest(top, coalesce(latent, 'zz')) when 'D01M03' then 'T9' end twin from attempts""")
def f_scalars(attempts):
    other = F.coalesce("latent", F.lit("zz"))
    return attempts.select("attempt_id", L.domain_of(F.col("problem_id")).alias("domain"), L.band(F.col("top_p")).alias("band"), L.aug_limit(F.lit("op"), F.col("total")).alias("aug"), F.round(L.pass_probability(F.col("difficulty"), F.lit(1300.0)), 6).alias("p_pass"), L.tie_key(F.col("learner_id").cast("string"), F.col("attempt_id").cast("string"), F.lit("x")).alias("tie"), L.twin_of(F.col("top"), other).alias("twin"))


# sources
@query("s10_fingerprint", "orders", sql="with h as (select md5(o_orderkey || chr(1) || o_custkey || chr(1) || o_orderstatus) m from orders), s as (select count(*) n, sum(('0x' || substr(m, 1, 8))::bigint) a, sum(('0x' || substr(m, 9, 8))::bigint) b from h) select n, substr(md5(n || ':' || a || ':' || b), 1, 16) hash from s")
def s10_fingerprint(orders):
    return S.table_fingerprint(orders, ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("s7_merge_cards", "part", sql="with c as (select p_brand id, max_by(p_name, p_partkey) doc from part group by 1), w(id) as (values ('Brand#11'), ('none')) select coalesce(c.id, w.id) id, doc, doc is null missing from c full join w on c.id = w.id")
def s7_merge_cards(part):
    return S.merge_cards(part.select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("prio"), F.col("p_name").alias("doc")), ["Brand#11", "none"])


@query("s8_baseline_pivot", "part", sql="select p_brand \"name\", p_type split, round(avg(p_retailprice), 6) macro_f1 from part group by 1, 2")
def s8_baseline_pivot(part):
    m = part.groupBy("p_brand", "p_type").agg(F.round(F.avg("p_retailprice"), 6).alias("v")).groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "v"))).alias("m"))
    return S.baseline_pivot(m.select(F.map_from_arrays(F.array("p_brand"), F.array("m")).alias("metrics")))


@query("s3_token_usage", "conversations", sql="select role job, count(*) calls, sum(length(text))::bigint prompt_tokens, sum(turn)::bigint completion_tokens from conversations group by 1")
def s3_token_usage(conversations):
    usage = F.struct(F.length("text").cast("long").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"))
    return S.token_usage(conversations.select(F.col("role").alias("job"), usage.alias("usage")))


@query("s3_cached_usage", "conversations", sql="select role job, count(*) calls, sum(length(text))::bigint prompt_tokens, sum(turn)::bigint completion_tokens, count(distinct conv_id // 1000)::int files from conversations group by 1")
def s3_cached_usage(conversations):
    """A file with an array of responses for each role and thousand conversations, read back as a cache."""
    from ..operators.shared import shared_path

    usage = F.struct(F.length("text").cast("long").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"))
    block = F.floor(F.col("conv_id") / 1000).alias("block")
    docs = conversations.groupBy("role", block).agg(F.to_json(F.collect_list(F.struct(F.col("role").alias("job"), usage.alias("usage")))).alias("value"))
    to = shared_path(conversations.sparkSession, "cache")
    docs.repartition("role", "block").write.partitionBy("role", "block").text(to)
    cache = S.scan_response_cache(conversations.sparkSession, f"{to}/*/*/*.txt")
    return S.token_usage(cache).join(cache.groupBy("job").agg(F.countDistinct("file").cast("int").alias("files")), "job")


def _cards(predictions):
    """Cards in three folders: E14 with a row for each domain, E15 in two folders, E10 with a row for each problem; E99 is expected and not there."""
    from ..operators.shared import shared_path

    spark, to = predictions.sparkSession, [shared_path(predictions.sparkSession, "cards") for _ in range(3)]
    put = lambda df, k: df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("append").text(to[k])
    mean = lambda c: F.round(F.avg(c), 6)
    each = predictions.groupBy(F.col("domain").alias("policy")).agg(mean("conf").alias("profile_f1"), mean((F.col("truth") == F.col("pred")).cast("double")).alias("stable_recheck"))
    put(each.agg(F.lit("E14").alias("id"), F.collect_list(F.struct("*")).alias("rows")), 0)
    whole = lambda c: predictions.agg(mean(c).alias("m_recall_on_dsa_trained_main_only"), F.lit(0.5).alias("shortcut_auc")).select(F.lit("E15").alias("id"), F.struct("*").alias("metrics"))
    put(whole(F.lit(0.0)), 0)
    put(whole(F.col("conf")), 2)
    by = predictions.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"))
    put(by.agg(F.lit("E10").alias("id"), F.lit("simulated").alias("caveat"), F.collect_list(F.struct("*")).alias("rows")), 1)
    put(predictions.limit(1).select(F.lit("no id").alias("id")), 1)
    return S.collect_cards(spark, to, ["E10", "E14", "E15", "E99"])


@query("s7_collect_cards", "predictions", sql="select unnest(['E10', 'E14', 'E15', 'E99']) id, unnest([false, false, false, true]) missing")
def s7_collect_cards(predictions):
    return _cards(predictions).select("id", "missing")


@query("s8_cross_domain", "predictions", sql="select round(avg(conf), 6) recall_main_only, 0.5::double shortcut_auc from predictions")
def s8_cross_domain(predictions):
    return S.cross_domain(_cards(predictions))


@query("s8_exam_sim", "predictions", sql="select domain policy, round(avg(conf), 6) profile_f1, round(avg((truth = pred)::int), 6) stable_recheck from predictions group by 1")
def s8_exam_sim(predictions):
    return S.exam_sim(_cards(predictions))


@query("s8_resolution", "predictions", sql="select problem_id, count(*) n, 'simulated' caveat from predictions group by 1")
def s8_resolution(predictions):
    return S.resolution(_cards(predictions), "problem_id: string, n: bigint")


@query("s5_event_log", "events", sql="select event_id, ts, value from events where event_type = 'purchase' and user_id = 7")
def s5_event_log(events):
    rows = events.withColumnsRenamed({"user_id": "learner_id", "event_type": "type"})
    return S.event_log(rows, 7, "purchase").select("event_id", "ts", "value")


@query("s6_json_round_trip", "lineitem", sql="select l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 6) x, count(*) n from lineitem group by 1, 2, 3")
def s6_json_round_trip(lineitem):
    """Written as JSON lines and read back."""
    from ..operators.shared import shared_path

    df = lineitem.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * F.col("l_discount")).alias("x"))
    to = shared_path(df.sparkSession, "jsonl")
    S.write_jsonl(df, to)
    return S.read_jsonl(df.sparkSession, to, df.schema).groupBy("l_orderkey", "l_linenumber", "x").agg(F.count(F.lit(1)).alias("n"))


@query("f_same_answer", "attempts", sql="select attempt_id, passed::varchar = total::varchar or abs(passed - total) <= 1e-9 same, trim(' ' || top || ' ') = trim(coalesce(latent, 'none')) named from attempts")
def f_same_answer(attempts):
    text = lambda c: F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(".0"))
    return attempts.select("attempt_id", L.same_answer(text("passed"), F.col("total").cast("string")).alias("same"), L.same_answer(F.concat(F.lit(" "), "top", F.lit(" ")), F.coalesce("latent", F.lit("none"))).alias("named"))


@query("f_voices", "attempts", sql="with v as (select attempt_id, case attempt_id % 4 when 0 then 'hinglish' when 1 then 'persona_friend_told' when 2 then 'persona_kid_told' else 'plain' end v from attempts) select attempt_id, regexp_replace(v, '_told$', '') base, case when v = 'hinglish' or v like 'persona\\_friend%' escape '\\' then 'Hinglish' else 'English' end \"language\" from v")
def f_voices(attempts):
    k = F.col("attempt_id") % 4
    v = F.when(k == 0, "hinglish").when(k == 1, "persona_friend_told").when(k == 2, "persona_kid_told").otherwise("plain")
    return attempts.select("attempt_id", L.base_voice(v).alias("base"), L.language_of(v).alias("language"))


@query("f_clean", "documents", sql=r"select doc_id, md5(regexp_replace(substr(coalesce(text, ''), 1, 2000), '^\s+|\s+$', '', 'g')) m from documents")
def f_clean(documents):
    return documents.select("doc_id", F.md5(L.clean(F.col("text"))).alias("m"))


@query("f_newest", "events", sql="select event_type, max(ts) newest from events group by 1")
def f_newest(events):
    return events.groupBy("event_type").agg(F.max("ts").alias("newest"))


# streams: the events table as a stream, run to its end
def _drain(df, mode: str):
    """The rows of a streaming DataFrame after all that is there has been read, through a table in the shared folder."""
    from ..operators.shared import shared_path

    spark = df.sparkSession
    to, at = shared_path(spark, "stream"), shared_path(spark, "stream-checkpoint")
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", to).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
    else:
        q = df.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(to)).option("checkpointLocation", at).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(to)


def _as_stream(df):
    """A batch table as a file stream."""
    at = written(df, "input")
    return df.sparkSession.readStream.schema(df.schema).parquet(at.inputFiles()[0].rsplit("/", 1)[0])


@query("st1_stream_knowledge", "responses", sql="""recursive with g as (select *, case kind when 'trap' then 0.15e0 when 'transfer_code' then 0.30e0 when 'belief_mcq' then 0.2e0 when 'ghost' then 0.25e0 when 'same_family_code' then 0.45e0 end g0, case kind when 'trap' then 0.10e0 when 'transfer_code' then 0.15e0 when 'belief_mcq' then 0.10e0 when 'ghost' then 0.15e0 when 'same_family_code' then 0.10e0 end s from responses),
h as (select *, case when hint and g0 is not null then least(0.9e0, g0 + 0.2e0) else g0 end gg from g), r as (select *, case when correct then gg else 1 - gg end a, case when correct then 1 - s else s end n from h), o as (select *, row_number() over (partition by learner_id, class order by ts, seq) rn from r),
f as (select distinct learner_id, class, 0::bigint rn, 0::bigint seq, 0.1e0::double p from o union all select o.learner_id, o.class, o.rn, o.seq, case when o.kind = 'intervention_done' then f.p * 0.65e0 else f.p * o.a / (f.p * o.a + (1 - f.p) * o.n) end from f join o on o.learner_id = f.learner_id and o.class = f.class and o.rn = f.rn + 1)
select learner_id, class, seq, round(p, 6) p_after from f where rn > 0""")
def st1_stream_knowledge(responses):
    return _drain(ST.stream_knowledge(_as_stream(responses)), "append").select("learner_id", "class", "seq", F.round("p_after", 6).alias("p_after"))


@query("st3_activity", "events", sql="select time_bucket(interval 1 hour, ts) \"start\", event_type type, count(*) n, round(avg((value >= 10)::int), 6) pass_rate from events group by 1, 2")
def st3_activity(events):
    rows = events.select("ts", F.col("event_type").alias("type"), (F.col("value") >= 10).alias("passed"))
    return _drain(ST.activity(_as_stream(rows)), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "type", "n", F.round("pass_rate", 6).alias("pass_rate"))


@query("st4_sessions", "events", sql="with l as (select user_id, ts, case when ts - lag(ts) over w < interval 1500 second then 0 else 1 end x from events window w as (partition by user_id order by ts)), s as (select *, sum(x) over (partition by user_id order by ts rows unbounded preceding) k from l) select user_id learner_id, min(ts) \"start\", count(*) n from s group by user_id, k")
def st4_sessions(events):
    rows = events.select(F.col("user_id").alias("learner_id"), "ts")
    return _drain(ST.sessions(_as_stream(rows)), "complete").select("learner_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("st2_stream_posterior", "answers", "choices", "beliefs", sql=f"with {_TABLE} select a.key, t.label, round(sum(ln(t.p)), 6) l from answers a join t on t.item_id = a.item_id and t.\"option\" = a.answer group by 1, 2")
def st2_stream_posterior(answers, choices, beliefs):
    from ..operators.bayes import likelihood_table

    return _R(_drain(ST.stream_posterior(_as_stream(answers), written(likelihood_table(_items(choices, beliefs)), "table")), "complete"), "l")


@query("st1_stream_states", "responses", sql=_MASTERY + " select learner_id, class, round(p, 6) p_active, state, seen times_seen, trap trap_passed, transfer transfer_passed from f qualify row_number() over (partition by learner_id, class order by rn desc) = 1")
def st1_stream_states(responses):
    """The last row of each key's log."""
    log = _drain(ST.stream_states(_as_stream(responses)), "append")
    last = log.groupBy("learner_id", "class").agg(F.max_by(F.struct("p_after", "state_after", "times_seen", "trap_passed", "transfer_passed"), F.struct("ts", "seq")).alias("x"))
    return last.select("learner_id", "class", F.round("x.p_after", 6).alias("p_active"), F.col("x.state_after").alias("state"), "x.times_seen", "x.trap_passed", "x.transfer_passed")


@query("st5_late_refold", "responses", sql=_FOLD.replace("recursive with", "recursive with bt as (select *, seq % 3 b from responses), mx as (select b, max(max(ts)) over (order by b rows between unbounded preceding and 1 preceding) m from bt group by b), lk as (select distinct learner_id, class from bt join mx on mx.b = bt.b and bt.ts < m - interval 20 day),", 1) + " select f.learner_id, f.class, round(p, 6) p_active, seen::bigint times_seen from f join lk on lk.learner_id = f.learner_id and lk.class = f.class qualify row_number() over (partition by f.learner_id, f.class order by rn desc) = 1")
def st5_late_refold(responses):
    """Three batches that overlap in time; keys with rows later than the watermark are folded anew from the whole table."""
    from ..operators.knowledge import knowledge_fold
    from ..operators.shared import shared_path

    spark, at = responses.sparkSession, [shared_path(responses.sparkSession, n) for n in ("in", "out", "side", "checkpoint")]
    for b in range(3):
        responses.filter(F.col("seq") % 3 == b).coalesce(1).write.mode("append").parquet(at[0])
    stream = spark.readStream.schema(responses.schema).option("maxFilesPerTrigger", 1).parquet(at[0])
    ST.split_late(stream, at[1], at[2], at[3], "20 days").awaitTermination()
    out, side = (spark.read.schema(responses.schema).parquet(x) for x in at[1:3])
    return ST.refold(out, side, knowledge_fold).select("learner_id", "class", F.round("p_active", 6).alias("p_active"), "times_seen")


@query("st6_enriched", "responses", "choices", sql="select learner_id, seq, r.item_id, k from responses r left join choices c on c.item_id = r.item_id")
def st6_enriched(responses, choices):
    return _drain(ST.enrich(_as_stream(responses.select("learner_id", "seq", "item_id")), choices.select("item_id", "k")), "append")


@query("st6_diagnosed", "attempts", sql="select attempt_id, learner_id, top, ts + interval 1 minute * (attempt_id % 20) diagnosed_at from attempts where attempt_id % 20 <= 10")
def st6_diagnosed(attempts):
    a = attempts.select("attempt_id", "learner_id", "ts")
    d = attempts.select("attempt_id", "top", (F.col("ts") + F.make_dt_interval(mins=(F.col("attempt_id") % 20).cast("int"))).alias("ts"))
    out = _drain(ST.diagnosed(_as_stream(a), _as_stream(d)), "append")
    return out.select("attempt_id", "learner_id", "top", F.col("diagnosed_at").cast("timestamp_ntz").alias("diagnosed_at"))


@query("st7_monitor", "corpus", sql="with l(label) as (values ('M01'), ('M08'), ('D01'), ('OTHER'), ('CORRECT'), ('M02')) select 'Q1' rule_id, case when coalesce(n, 0) < 80 then 'FAIL' else 'PASS' end status, label \"key\", coalesce(n, 0)::double \"value\", 0 batch from l left join (select label, count(*) n from corpus group by 1) using (label)")
def st7_monitor(corpus):
    from ..operators.quality import check_counts
    from ..operators.shared import shared_path

    spark, (to, at) = corpus.sparkSession, (shared_path(corpus.sparkSession, n) for n in ("rules", "checkpoint"))
    rows = _as_stream(corpus.select("id", "label"))
    ST.monitor(rows, lambda b: check_counts(b, ["M01", "M08", "D01", "OTHER", "CORRECT", "M02"]), to, at).awaitTermination()
    return spark.read.parquet(to)
