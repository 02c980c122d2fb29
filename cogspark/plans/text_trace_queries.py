"""Sentences from documents and conversations; runs from line items (tests) and conversations (steps)."""

from pyspark.sql import functions as F

from ..operators import text as T
from ..operators import traces as R
from .registry import logical, query

_R = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
logical("sentences", "conversations", sql="select conv_id * 1000 + turn id, role label, text, concat('c_', cast(conv_id % 8 as varchar(9))) context_id from {conversations}")
logical("lines", "lineitem", sql="select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) rn from {lineitem}")
logical("per_test", "lines", sql="select l_orderkey attempt_id, concat('P', cast(l_orderkey % 3 as varchar(9))) problem_id, rn test, case when l_returnflag = 'R' then 'crash' when l_returnflag = 'A' then 'timeout' else 'ok' end status, l_returnflag = 'N' passed, cast(l_quantity as int) % 5 iterations, l_partkey % 3 line, round(l_extendedprice / 1000, 0) got, round(l_extendedprice / 1000 + (l_suppkey % 3) - 1, 0) want, l_suppkey from {lines}")
logical("test_events", "lines", sql="select l_orderkey attempt_id, rn test, l_suppkey % 7 ord, case l_partkey % 4 when 0 then 'step_cap' when 1 then 'uninit_read' when 2 then 'oob_eq_n' else 'empty_body' end type, cast(l_quantity as int) line from {lines}")
logical("steps", "lines", sql="select l_orderkey attempt_id, 1 test, cast(rn as bigint) i, cast(l_quantity as int) % 6 line, cast(1 + l_partkey % 3 as int) depth, l_suppkey % 5 arg, l_partkey % 4 cell, l_suppkey % 3 value from {lines}")


@query("t_sentence_filter", "sentences", sql=r"""with d as (select label, max(text) d from sentences group by 1), w as (select s.*, d.d, len(list_filter(regexp_split_to_array(trim(text, E' \t\n\r'), '\s+'), lambda x: x <> '')) n from sentences s join d on d.label = s.label),
j as (select *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) a, list_distinct(regexp_extract_all(lower(d), '[a-z0-9'']+')) b from w)
select id, case when n < 3 then 'short' when n > 60 then 'long' when contains(lower(text), 'ing the') then 'banned' when len(list_distinct(list_concat(a, b))) > 0 and len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.8 then 'copy' end drop_reason from j""")
def t_sentence_filter(sentences):
    d = sentences.groupBy("label").agg(F.max("text").alias("description"))
    return T.sentence_filter(sentences, ["ing the"], d).select("id", "drop_reason")


@query("t_drop_counts", "sentences", sql=r"""with w as (select *, len(list_filter(regexp_split_to_array(trim(text, E' \t\n\r'), '\s+'), lambda x: x <> '')) n from sentences) select label, count(*) filter (n between 3 and 60 and not contains(lower(text), 'ing the')) kept, count(*) filter (n < 3) short, count(*) filter (n > 60) long, count(*) filter (n between 3 and 60 and contains(lower(text), 'ing the')) banned, 0::bigint copy from w group by 1""")
def t_drop_counts(sentences):
    return T.drop_counts(T.sentence_filter(sentences, ["ing the"]))


@query("t_near_dups", "sentences", sql="""recursive with t as (select id, label, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) t from sentences), p as (select a.id a, b.id b from t a join t b on a.label = b.label and a.id < b.id and len(a.t) > 0 and least(len(a.t), len(b.t)) >= 0.85 * greatest(len(a.t), len(b.t)) and len(list_intersect(a.t, b.t)) >= 0.85 * len(list_distinct(list_concat(a.t, b.t)))),
o as (select id, row_number() over (order by id) rn from t), s as (select 0::bigint rn, []::bigint[] kept union all select o.rn, case when exists (select 1 from p where p.b = o.id and list_contains(s.kept, p.a)) then s.kept else list_append(s.kept, o.id) end from s join o on o.rn = s.rn + 1),
k as (select kept from s order by rn desc limit 1) select id, list_contains((select kept from k), id) keep from sentences""")
def t_near_dups(sentences):
    return T.near_dups(sentences).select("id", "keep")


@query("t_split_by_context", "sentences", sql="select id, case conv when 1 then 'train' when 2 then 'train' when 3 then 'train' when 4 then 'train' when 5 then 'val' when 6 then 'test' end split from (select id, (id // 1000) % 8 conv from sentences)")
def t_split_by_context(sentences):
    return T.split_by_context(sentences).select("id", "split")


@query("t_tfidf", "sentences", sql="""with w as (select id, regexp_extract_all(lower(text), '[a-z0-9'']+') w from sentences), u as (select id, unnest(w) term from w union all select id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w),
tf as (select id, term, count(*) tf from u group by 1, 2), d as (select term, count(*) df from tf group by 1 having count(*) >= 2), x as (select id, tf.term, (1 + ln(tf)) * (1 + ln((1 + (select count(*) from sentences)) / (1 + df))) w from tf join d on d.term = tf.term), n as (select *, w / sqrt(sum(w * w) over (partition by id)) v from x)
select id, count(*) terms, round(sum(v), 5) weight, min(term) first_term from n group by 1""")
def t_tfidf(sentences):
    return T.tfidf(sentences).groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 5).alias("weight"), F.min("term").alias("first_term"))


@query("t_text_classifier", "documents")
def t_text_classifier(documents):
    """No SQL: a fitted model. The tests hold it against held-out accuracy."""
    rows = documents.select("doc_id", "text", F.col("lang").alias("label"))
    model = T.fit_text_classifier(rows.filter("doc_id % 4 <> 0"))
    names = model.stages[6].labels
    return model.transform(rows).select("doc_id", F.element_at(F.lit(names), F.col("prediction").cast("int") + 1).alias("predicted"))


@query("t_reader_status", "predictions", sql="with l as (select id, unnest(['M01', 'D05', 'CORRECT_REASON']) label, unnest([conf, 1 - conf, (id % 10) / 10e0]) p from predictions), b as (select id, label, p, row_number() over (partition by id order by round(p, 12) desc, label) rn from l where not (label = 'M01' and id % 6 = 0)) select id, label, round(p, 6) p, case when p < 0.6 then 'unsure' when label = 'CORRECT_REASON' then 'correct_reasoning' else 'matched' end status from b where rn = 1")
def t_reader_status(predictions):
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("label"), p.alias("p")) for n, p in (("M01", F.col("conf")), ("D05", 1 - F.col("conf")), ("CORRECT_REASON", (F.col("id") % 10) / 10.0))]))
    rows = predictions.select("id", each).withColumn("masked", (F.col("label") == "M01") & (F.col("id") % 6 == 0))
    return _R(T.reader_status(rows), "p")


@query("t_quote_grounding", "conversations", sql=r"with c as (select conv_id * 1000 + turn id, text, case when turn % 3 = 0 then substr(text, 5, 20) else 'not there' end quote from conversations) select id, quote from c where trim(regexp_replace(lower(quote), '\s+', ' ', 'g')) <> '' and contains(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), trim(regexp_replace(lower(quote), '\s+', ' ', 'g')))")
def t_quote_grounding(conversations):
    rows = conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.when(F.col("turn") % 3 == 0, F.substring("text", 5, 20)).otherwise("not there").alias("quote"))
    return T.quote_grounding(rows.select("id", "quote"), rows.select("id", "text"))


@query("t_claim_grounding", "per_test", sql="with r as (select attempt_id * 100 + test id, iterations r, iterations + l_suppkey % 3 - 1 c, l_suppkey % 11 = 0 never, iterations % 2 = 0 ended from per_test), v as (select id, case when never and ended then 'M02' when abs(c - r) = 1 then 'M01' end class, c - r = 0 or (never and not ended) g from r) select id, class, case when class is not null then 'misread' when g then 'grounded' else 'open' end verdict from v")
def t_claim_grounding(per_test):
    i = (F.col("attempt_id") * 100 + F.col("test")).alias("id")
    claims = per_test.select(i, (F.col("iterations") + F.col("l_suppkey") % 3 - 1).alias("iterations"), (F.col("l_suppkey") % 11 == 0).alias("never_ends"), F.lit(None).cast("string").alias("text"))
    runs = per_test.select(i, F.col("iterations").alias("iterations_run"), (F.col("iterations") % 2 == 0).alias("ended"))
    return T.claim_grounding(claims, runs).select("id", "class", "verdict")


@query("w_path_divergence", "conversations", sql="with p as (select conv_id id, list(role order by turn) p, list(case when turn % 2 = 1 then 'assistant' else 'user' end order by turn) c, list(turn order by turn) t from conversations group by 1), q as (select id, p, c, list_filter(range(1, len(p) + 1), lambda i: p[i] is distinct from c[i]) o from p) select id, (o[1] - 1)::int divergence_index, case when o[1] > 1 then c[o[1] - 1] end divergence_node, case when p = ['user'] then 'M01' when p = ['system', 'user', 'assistant'] then 'M02' end misconception from q")
def w_path_divergence(conversations):
    p = conversations.groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("path"), F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.when(t % 2 == 1, "assistant").otherwise("user")).alias("correct_path"))
    known = [F.struct(F.array(*map(F.lit, path)).alias("path"), F.lit(m).alias("misconception")) for path, m in ((["user"], "M01"), (["system", "user", "assistant"], "M02"))]
    return T.path_grounding(p.withColumn("buggy", F.array(*known))).select("id", "divergence_index", "divergence_node", "misconception")


@query("t_prediction_of", "events", sql="""with v as (select user_id id, event_id, json_extract_string(props, '$.k') v from events where event_type <> 'error') select id, min_by(v, event_id) prediction from v where v is not null group by 1""")
def t_prediction_of(events):
    rows = events.filter("event_type <> 'error'").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), F.regexp_replace("props", '"k"', '"value"').alias("payload"))
    return T.prediction_of(rows)


@query("t_code_item_outcome", "attempts", sql="select attempt_id, case attempt_id % 3 when 0 then case when passed = total then 'fixed' else 'still_broken' end when 1 then case when difficulty = 1 then 'found' else 'missed' end else case when passed = total then 'completed' else 'incomplete' end end outcome, case attempt_id % 3 when 0 then true when 1 then latent is not null else passed = total end updates from attempts")
def t_code_item_outcome(attempts):
    k = F.col("attempt_id") % 3
    rows = attempts.select("attempt_id", F.when(k == 0, "fix_bug").when(k == 1, "debug").otherwise("complete").alias("type"), (F.col("passed") == F.col("total")).alias("tests_pass"), (F.col("difficulty") == 1).alias("line_right"), F.col("latent").alias("planted"))
    return T.code_item_outcome(rows).select("attempt_id", "outcome", "updates")


@query("t_debug_answers", "attempts", "part", sql="with i as (select p_partkey item_id, p_partkey % 3 <> 0 planted, [p_size % 5, p_size % 7] l from part), a as (select attempt_id, 1 + attempt_id % 200 item_id, case when attempt_id % 4 <> 0 then total % 5 end line from attempts) select attempt_id, case when not planted then line is null else coalesce(list_contains(l, line), false) end correct, planted updates from a join i on i.item_id = a.item_id")
def t_debug_answers(attempts, part):
    items = part.select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_partkey") % 3 != 0, "M01").alias("planted"), F.array(F.col("p_size") % 5, F.col("p_size") % 7).cast("array<bigint>").alias("bug_lines"))
    a = attempts.select("attempt_id", (1 + F.col("attempt_id") % 200).alias("item_id"), F.when(F.col("attempt_id") % 4 != 0, F.col("total") % 5).alias("line"))
    return T.debug_answers(a, items).select("attempt_id", "correct", "updates")


@query("j_cross_bank_leaks", "documents", sql=r"with k as (select substr(sha256(regexp_replace(lower(text), '\s+', '', 'g')), 1, 16) k, source from documents), n as (select k, source, count(*) n from k group by 1, 2) select k \"key\", source bank_a, source bank_b from n where n > 1 union all select a.k, a.source, b.source from n a join n b on a.k = b.k and a.source < b.source".replace('\\"', '"'))
def j_cross_bank_leaks(documents):
    return T.cross_bank_leaks(documents.select(F.col("source").alias("bank"), "text"))


# traces
_REF = "rf as (select problem_id, test, max(iterations) r from per_test group by 1, 2)"
_KINDS = ", ".join(f"max((type = '{k}')::int) flag_{k}, min_by(line, (test, ord)) filter (type = '{k}') line_{k}" for k in R.EVENTS)


@query("r_trace_features", "per_test", "test_events", sql=f"""with {_REF}, a as (select attempt_id, count(*) tests, avg(passed::int) pf, max((status = 'crash')::int) c, max((status = 'timeout')::int) t, avg(iterations - r) md, min((iterations - r = 1)::int) p1, min((iterations - r = -1)::int) m1, avg((status = 'ok' and iterations = 1)::int) filter (r >= 2) es from per_test join rf using (problem_id, test) group by 1),
e as (select attempt_id, {_KINDS} from test_events group by 1)
select tests, round(pf, 6) pass_fraction, c any_crash, t any_timeout, e.*, round(md, 6) mean_delta, p1 always_plus_one, m1 always_minus_one, round(coalesce(es, 0), 6) early_share from a join e using (attempt_id)""")
def r_trace_features(per_test, test_events):
    """All kinds of events; the reference ran as long as the longest run of its problem and test."""
    ref = per_test.groupBy("problem_id", "test").agg(F.max("iterations").alias("iterations"))
    return _R(R.trace_features(per_test, test_events, ref, R.EVENTS), "pass_fraction", "mean_delta", "early_share")


@query("r_branch_features", "per_test", sql="with s as (select attempt_id, problem_id, line, sum(passed::int) t, sum((not passed)::int) f, min(test) o from per_test group by 1, 2, 3), v as (select problem_id, max((t > 0 and f > 0)::int) = 1 v from (select problem_id, line, sum(passed::int) t, sum((not passed)::int) f from per_test group by 1, 2) group by 1) select attempt_id, max((v and f = 0 and t >= 2)::int) always, max((v and t = 0 and f >= 2)::int) never, min_by(line, (o, line)) filter (v and f = 0 and t >= 2) always_line, min_by(line, (o, line)) filter (v and t = 0 and f >= 2) never_line from s join v using (problem_id) group by 1")
def r_branch_features(per_test):
    rows = per_test.select("attempt_id", "problem_id", "line", F.col("test").alias("ord"), F.col("passed").cast("int").alias("t"), (~F.col("passed")).cast("int").alias("f"))
    return R.branch_features(rows, rows)


@query("a6_counters", "per_test", sql="select attempt_id, 'line' || line \"key\", sum(iterations)::bigint total from per_test group by 1, 2")
def a6_counters(per_test):
    return R.counters(per_test.withColumn("m", F.create_map(F.concat(F.lit("line"), "line"), F.col("iterations").cast("long"))), "m")


# numbers below zero, fractions, and values near one that was never written; arrays of three items are made from `mid` and `form`
logical("outputs", "lines", sql="select l_orderkey attempt_id, rn test, case l_suppkey % 5 when 0 then w when 1 then w + 1 when 2 then 0e0 when 3 then -858993460e0 + rn else cast(l_linenumber as double) end got, w + case when l_partkey % 2 = 0 then 0.5e0 * sign(w) else 0e0 end want, cast(l_linenumber as double) arg, cast(l_suppkey % 3 as double) mid, l_partkey % 3 form from (select *, round(l_extendedprice / 10000, 0) - 4 w from {lines})")


@query("r_relation_features", "outputs", sql="""with b as (select *, [1, mid, 3] items, case form when 0 then [1, mid, 3] when 1 then [mid, 3, 3] else [3, 2, 1] end ar, [3, mid, 1] wa from outputs where abs(got - want) > 1e-9)
select attempt_id, count(*) failed, round(avg((abs(abs(got - want) - 1) <= 1e-9)::int), 6) off_by_one, round(avg((got = 0 and want <> 0)::int), 6) zero, round(avg((abs(got - trunc(want)) <= 1e-9 and want <> trunc(want))::int), 6) floored, round(avg((abs(got + 858993460) <= 1000000)::int), 6) garbage, round(avg((got = arg or got = 3)::int), 6) top_frame, round(avg((ar = items and wa <> items)::int), 6) unchanged, round(avg((ar = [items[2], items[3], items[3]] or ar = [items[2], items[3], items[2]])::int), 6) shifted from b group by 1""")
def r_relation_features(outputs):
    a = lambda *x: F.array(*[F.lit(float(y)) if isinstance(y, int) else F.col(y) for y in x])
    array = F.when(F.col("form") == 0, a(1, "mid", 3)).when(F.col("form") == 1, a("mid", 3, 3)).otherwise(a(3, 2, 1))
    rows = outputs.select("attempt_id", "test", "got", "want", a("arg").alias("args"), a(1, "mid", 3).alias("items"), array.alias("array"), a(3, "mid", 1).alias("want_array"))
    return _R(R.relation_features(rows), "off_by_one", "zero", "floored", "garbage", "top_frame", "unchanged", "shifted")


@query("r_reference_relations", "per_test", sql="with b as (select * from per_test where abs(got - want) > 1e-9), o as (select distinct test, 't' || (l_suppkey % 3) tr, want out from per_test), n as (select attempt_id, count(*) n from b group by 1), h as (select attempt_id, tr, count(distinct b.test) k from b join o on o.test = b.test and abs(b.got - o.out) <= 1e-9 group by 1, 2) select attempt_id, tr transform, round(k / n, 6) share from h join n using (attempt_id)")
def r_reference_relations(per_test):
    ref = per_test.select("test", F.concat(F.lit("t"), F.col("l_suppkey") % 3).alias("transform"), F.col("want").alias("out")).distinct()
    return _R(R.reference_relations(per_test, ref), "share")


@query("w_frozen_passes", "steps", sql="select attempt_id, i pass, coalesce(value = lag(value) over (partition by attempt_id order by i), false) frozen from steps")
def w_frozen_passes(steps):
    return R.frozen_passes(steps.withColumn("pass", F.col("i")).withColumn("vars", F.col("value").cast("string"))).select("attempt_id", "pass", "frozen")


@query("w_segment_passes", "steps", sql="select attempt_id, i, sum((line = 0)::int) over (partition by attempt_id order by i)::bigint pass from steps")
def w_segment_passes(steps):
    return R.segment_passes(steps, F.col("line") == 0).select("attempt_id", "i", "pass")


@query("w_islands", "steps", sql="with n as (select *, case when row_number() over w = 1 or value is distinct from lag(value) over w then 1 else 0 end x from steps window w as (partition by attempt_id order by i)), g as (select *, sum(x) over (partition by attempt_id order by i) island from n) select attempt_id, island::bigint island, value, min(i) \"first\", max(i) \"last\", count(*) n from g group by 1, 2, 3")
def w_islands(steps):
    return R.islands(steps, "value").drop("test")


@query("w_call_stack", "steps", sql="with p as (select a.attempt_id, a.i, a.depth, a.arg, max_by(b.i, b.i) parent, max_by(b.arg, b.i) pa from steps a left join steps b on b.attempt_id = a.attempt_id and b.i < a.i and b.depth = a.depth - 1 group by 1, 2, 3, 4) select attempt_id, i, depth, arg, parent, coalesce(pa = arg, false) same_arg, coalesce(arg > pa, false) growing_arg from p")
def w_call_stack(steps):
    return R.call_stack(steps).drop("test")


@query("w_memory_strip", "steps", sql="select attempt_id, i, cell, value, lag(value) over w old, value is distinct from lag(value) over w changed from steps window w as (partition by attempt_id, cell order by i)")
def w_memory_strip(steps):
    return R.memory_strip(steps).select("attempt_id", "i", "cell", "value", "old", "changed")


@query("w_final_memory", "steps", sql="select attempt_id, cell, max_by(value, i) \"value\" from steps group by 1, 2")
def w_final_memory(steps):
    return R.final_memory(steps).drop("test")


@query("r_array_features", "steps", sql="with a as (select attempt_id id, list(arg order by i) b, list(case when attempt_id % 2 = 0 then value else arg end order by i) a from steps group by 1) select id, list_sort(a) = list_sort(b) same_multiset, round(case when len(a) > 1 then list_sum(list_transform(range(1, len(a)), lambda k: (a[k] <= a[k + 1])::int)) / (len(a) - 1) end, 6) sorted_fraction from a")
def r_array_features(steps):
    s = steps.groupBy(F.col("attempt_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("i", "arg", "value"))).alias("h"))
    pick = lambda f: F.transform("h", lambda x: x[f])
    return _R(R.array_features(s.select("id", pick("arg").alias("before"), F.when(F.col("id") % 2 == 0, pick("value")).otherwise(pick("arg")).alias("after"))), "sorted_fraction")


@query("r_timeline_rows", "steps", sql="with t as (select *, lag(i) over w is null or lead(i) over w is null or line < lag(line) over w or depth is distinct from lag(depth) over w k from steps window w as (partition by attempt_id order by i)) select attempt_id, i, line, depth from t where k")
def r_timeline_rows(steps):
    return R.timeline_rows(steps).select("attempt_id", "i", "line", "depth")


_TIMELINE = """s as (select attempt_id, concat('P', attempt_id % 5) problem_id, i, line, sum((line < 2)::int) over (partition by attempt_id order by i) pass, arg a, value v, case cell when 0 then [] when 1 then ['ret:1'] when 2 then ['compare:x', 'call:f:1'] else ['read_void:p'] end::varchar[] effects, depth = 3 uninit from steps),
z as (select problem_id, min(attempt_id) ref from s group by 1), m as (select *, dense_rank() over (partition by attempt_id order by pass) - 1 k, row_number() over (partition by attempt_id, pass order by i desc) = 1 is_last from s),
init as (select attempt_id, 'a' var, min_by(a, i) x from m where k = 0 group by 1 having min(a) <> max(a) union all select attempt_id, 'v', min_by(v, i) from m where k = 0 group by 1 having min(v) <> max(v)),
e as (select attempt_id, k, lag(a) over w pa, lag(v) over w pv from m where is_last window w as (partition by attempt_id order by k)),
h as (select m.attempt_id, m.k, min_by(var, (i, var)) var, min(i) i from m join e on e.attempt_id = m.attempt_id and e.k = m.k join init t on t.attempt_id = m.attempt_id where m.k > 0 and case var when 'a' then a = x and pa <> x else v = x and pv <> x end group by 1, 2),
rv as (select distinct problem_id, var from h join z on ref = attempt_id), n as (select attempt_id, max(k) + 1 n from m group by 1),
p as (select m.attempt_id, problem_id, m.k, max((effects = ['read_void:p'])::int) void, max(uninit::int) st, min(m.i) filter (uninit or effects = ['read_void:p']) fi, max(m.i) li, max(h.i) hi, bool_or(h.var is not null and (problem_id, h.var) not in (select (problem_id, var) from rv)) reset, bool_or(is_last and effects = ['ret:1']) ret from m left join h on h.attempt_id = m.attempt_id and h.k = m.k group by 1, 2, 3),
c as (select p.*, n.n, r.n rn, coalesce(fi, case when reset then hi end, li) ci, case when void = 1 then 'void_read' when st = 1 then 'static' when reset then 'reset' when ret and k + 1 = n.n and n.n < r.n then 'early_return' when k >= r.n then 'extra' end flag from p join n on n.attempt_id = p.attempt_id join z using (problem_id) join n r on r.attempt_id = z.ref),
o as (select c.attempt_id, c.k, c.ci step, x.line, x.a, x.v, flag, case when x.effects[1] is not null then case x.effects[1] when 'compare:x' then 'compare:x' else x.effects[1] end else (select min_by(y.effects[1], (case y.effects[1] when 'read_void:p' then 0 when 'compare:x' then 2 else 5 end, y.i)) from m y where y.attempt_id = c.attempt_id and y.k = c.k and len(y.effects) > 0) end effect from c join m x on x.attempt_id = c.attempt_id and x.i = c.ci),
b as (select attempt_id, max_by(step, k) base from o group by 1),
w as (select o.* from o union all select c.attempt_id, y.k, b.base + y.k - c.n + 1, y.line, y.a, y.v, 'missing', y.effects[1] from (select distinct attempt_id, problem_id, n, rn from c) c join z using (problem_id) join m y on y.attempt_id = z.ref and y.is_last and y.k >= c.n join b on b.attempt_id = c.attempt_id),
q as (select *, row_number() over (partition by attempt_id order by k) r, count(*) over (partition by attempt_id) t from w)"""


@query("r_timeline", "steps", sql=f"with {_TIMELINE} select attempt_id, k, step, line, a || '/' || v vars, effect, flag from q where t <= 12 or r <= 10 or r > t - 2")
def r_timeline(steps):
    """Passes of each run beside those of the first run of its problem."""
    k = F.col("cell")
    effects = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("ret:1"))).when(k == 2, F.array(F.lit("compare:x"), F.lit("call:f:1"))).otherwise(F.array(F.lit("read_void:p")))
    rows = R.segment_passes(steps, F.col("line") < 2, ("attempt_id",)).select("attempt_id", F.concat(F.lit("P"), F.col("attempt_id") % 5).alias("problem_id"), "test", "i", "line", "pass", F.create_map(F.lit("a"), F.col("arg").cast("string"), F.lit("v"), F.col("value").cast("string")).alias("vars"), effects.alias("effects"), F.when(F.col("depth") == 3, F.array(F.lit("uninit_read"))).alias("events"))
    first = rows.groupBy("problem_id").agg(F.min("attempt_id").alias("attempt_id"))
    reference = rows.join(first, ["problem_id", "attempt_id"], "left_semi").drop("attempt_id")
    return R.timeline(rows, reference).select("attempt_id", "k", "step", "line", F.concat_ws("/", F.col("vars")["a"], F.col("vars")["v"]).alias("vars"), "effect", "flag")


@query("r_trace_summary", "test_events", "per_test", sql="with f as (select attempt_id, type, min((test, ord)) m from test_events group by 1, 2), e as (select attempt_id, string_agg(type, ',' order by m, type) events from f group by 1), s as (select attempt_id, max_by(status, case status when 'crash' then 2 when 'timeout' then 1 else 0 end) status from per_test group by 1) select s.attempt_id, status, events from s join e using (attempt_id)")
def r_trace_summary(test_events, per_test):
    return R.trace_summary(test_events, per_test)


@query("r_test_to_show", "per_test", sql="select attempt_id, min_by(test, (case when test = 2 and not passed then 0 when not passed then 1 when got <> want then 2 when test = 2 then 3 else 4 end, test)) test from per_test group by 1")
def r_test_to_show(per_test):
    return R.test_to_show(per_test.withColumns({"display": F.col("test") == 2, "signature": F.col("got"), "reference_signature": F.col("want")}))


@query("r_main_loop", "steps", sql="select attempt_id, max_by(line, (arg, -depth, -line)) line from steps group by 1")
def r_main_loop(steps):
    return R.main_loop(steps.withColumn("iterations", F.col("arg")))


@query("r_task_features", "part", sql=r"with p as (select p_partkey::varchar problem_id, case p_partkey % 4 when 0 then 'int f(int a[], int n)' when 1 then 'void g(void)' when 2 then 'double h(char *s)' else 'int k()' end s from part), q as (select *, regexp_extract(s, '\((.*)\)', 1) a from p) select problem_id, regexp_matches(s, '\[\]|\*') has_array, regexp_matches(a, '\bint (n|size|len)\b') has_size, regexp_matches(s, '^\s*void\b') returns_void, case when trim(a) in ('', 'void') then 0 else len(string_split(a, ',')) end::int n_params from q")
def r_task_features(part):
    k = F.col("p_partkey") % 4
    return R.task_features(part.select(F.col("p_partkey").cast("string").alias("problem_id"), F.when(k == 0, "int f(int a[], int n)").when(k == 1, "void g(void)").when(k == 2, "double h(char *s)").otherwise("int k()").alias("signature")))


_FR = """f as (select a.attempt_id, a.i, a.depth, a.arg, value > 0 returned, cell > 1 used, max_by(b.i, b.i) parent, max_by(b.arg, b.i) pa from (select * from steps) a left join steps b on b.attempt_id = a.attempt_id and b.i < a.i and b.depth = a.depth - 1 group by all),
g as (select f.*, (attempt_id, i) in (select (attempt_id, parent) from f where parent is not null) deeper from f)"""
_FR = _FR.replace("value > 0", "a.value > 0").replace("cell > 1", "a.cell > 1")


def _frames(steps):
    return steps.withColumns({"returned": F.col("value") > 0, "used": F.col("cell") > 1})


@query("r_call_table", "steps", sql=f"with {_FR}, n as (select *, row_number() over (partition by attempt_id order by i) rn, count(*) over (partition by attempt_id) n from g) select attempt_id, string_agg(case when rn <= 3 then i || '/' || depth || '/' || (coalesce(pa = arg, false))::int || (coalesce(arg > pa, false))::int || (not deeper and not returned)::int || (returned and not used)::int end, ' ' order by i) rows, case when any_value(n) > 3 then '...+' || (any_value(n) - 3) end more from n group by 1")
def r_call_table(steps):
    bit = lambda c: c.cast("int").cast("string")
    out = R.call_table(_frames(steps), 3)
    show = lambda x: F.concat(x["i"].cast("string"), F.lit("/"), x["depth"].cast("string"), F.lit("/"), bit(x["same_arg"]), bit(x["growing_arg"]), bit(x["no_base"]), bit(x["dropped_value"]))
    return out.select("attempt_id", F.array_join(F.transform("rows", show), " ").alias("rows"), "more")


@query("r_recursion_features", "steps", sql="""with f as (select a.attempt_id, a.i, a.depth, a.arg, a.line % 2 fn, a.value > 0 returned, max(b.i) up, max_by(b.arg, b.i) pa, max_by(b.line % 2, b.i) pf from steps a left join steps b on b.attempt_id = a.attempt_id and b.i < a.i and b.depth = a.depth - 1 group by all),
h as (select *, case when pf = fn then up end parent from f), g as (select h.*, (attempt_id, i) in (select (attempt_id, parent) from h where parent is not null) deeper from h)
select attempt_id, round(max(depth) / 2e0, 6) depth_ratio, coalesce(bool_or(pa = arg) filter (parent is not null), false) arg_constant, count(parent) >= 2 and coalesce(bool_and(arg > pa) filter (parent is not null), false) arg_growing, bool_or(not deeper and returned) or (attempt_id % 2 = 0 and not bool_or(returned)) base_return from g group by 1""")
def r_recursion_features(steps):
    """Two functions; every second run came to its end."""
    ref = steps.select("test").distinct().withColumn("depth", F.lit(2))
    frames = _frames(steps).withColumns({"fn": F.col("line") % 2, "ok": F.col("attempt_id") % 2 == 0})
    return _R(R.recursion_features(frames, ref).drop("test"), "depth_ratio")


@query("r_body_once", "steps", sql="with l as (select attempt_id, line, count(*) n from steps where line <> 0 group by 1, 2) select attempt_id, max(n) <= 1 body_once from l group by 1")
def r_body_once(steps):
    ref = steps.select("test").distinct().withColumn("iterations", F.lit(2))
    return R.body_once(steps.withColumn("is_header", F.col("line") == 0), ref).drop("test")


@query("r_output_features", "outputs", sql="select attempt_id, bool_or(abs(got + 858993460) <= 1000000) returned_garbage, bool_or(form <> 1) printed_nonempty, round(coalesce(avg((case form when 1 then false when 2 then abs(arg - want) <= 1e-9 else false end)::int) filter (mid <> 0), 0), 6) printed_eq_return, count(*) filter (mid <> 0) wanted from outputs group by 1")
def r_output_features(outputs):
    text = F.when(F.col("form") == 2, F.concat(F.lit(" "), F.col("arg").cast("string"), F.lit("\n"))).when(F.col("form") == 0, "word")
    return _R(R.output_features(outputs.select("attempt_id", "test", F.col("got").alias("returned"), text.alias("printed"), F.when(F.col("mid") != 0, F.col("want")).alias("wanted"))), "printed_eq_return")


@query("r_outer_passes", "per_test", sql="select attempt_id, round(sum(case when line = 0 then iterations when iterations >= 1 then 1 else 0 end) / (select sum(r) from (select min(iterations) + 1 r from per_test group by test)), 6) ratio from per_test group by 1")
def r_outer_passes(per_test):
    ref = per_test.groupBy("test").agg((F.min("iterations") + 1).alias("outer"))
    return _R(R.outer_passes(per_test.select("attempt_id", "test", F.when(F.col("line") == 0, F.col("iterations")).alias("outer"), F.col("iterations").alias("main")), ref), "ratio")


@query("t5_char_tfidf", "sentences", sql=r"""with w as (select id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) || ' ' w from sentences where id % 1000 < 3), g as (select id, substr(w, i::int, n::int) term from w, range(3, 6) a(n), range(1, 400) b(i) where n <= greatest(3, length(w)) and i <= greatest(length(w) - n, 0) + 1),
tf as (select id, term, count(*) tf from g group by 1, 2), d as (select term, count(*) df from tf group by 1 having count(*) >= 2), x as (select tf.id, tf.term, (1 + ln(tf)) * (1 + ln((1 + (select count(*) from sentences where id % 1000 < 3)) / (1 + df))) w from tf join d on d.term = tf.term) select id, term, round(w / sqrt(sum(w * w) over (partition by id)), 5) weight from x""".replace("where id % 1000 < 3", ""))
def t5_char_tfidf(sentences):
    return T.tfidf(sentences, analyzer="char_wb").withColumn("weight", F.round("weight", 5))


@query("r13_window_strip", "steps", sql="with s as (select *, row_number() over (partition by attempt_id order by i) n, lag(line) over (partition by attempt_id order by i) l1, lag(depth) over (partition by attempt_id order by i) l2 from steps where arg <> 4) select attempt_id, string_agg(case when n <= 3 then i || ':' || line || '-' || depth || case when value = cell then '==' when value < cell then '<' else '>' end || case when l1 = line and l2 = depth then 'f' else '' end end, ' ' order by i) rows, case when count(*) > 3 then '...+' || (count(*) - 3) end more from s group by 1")
def r13_window_strip(steps):
    p = steps.select("attempt_id", "test", F.col("i").alias("pass"), F.col("line").alias("low"), F.when(F.col("arg") != 4, F.col("arg")).alias("mid"), F.col("depth").alias("high"), F.col("value").alias("mid_value"), F.col("cell").alias("target"))
    show = lambda x: F.concat(x["pass"].cast("string"), F.lit(":"), x["low"].cast("string"), F.lit("-"), x["high"].cast("string"), x["cmp"], F.when(x["flag"].isNotNull(), "f").otherwise(""))
    return R.window_strip(p, 3).select("attempt_id", F.array_join(F.transform("rows", show), " ").alias("rows"), "more")


@query("r14_memory_flags", "steps", sql="""with ini as (select attempt_id, c cell, c % 3 v from (select distinct attempt_id from steps) cross join range(4) r(c)), ev as (select attempt_id, i, cell, value v from steps union all select attempt_id, -1, cell, v from ini), o as (select *, lag(v) over (partition by attempt_id, cell order by i) old from ev), fin as (select attempt_id, cell, max_by(v, i) v from ev group by 1, 2),
b as (select attempt_id, v, count(*) n from ini group by 1, 2), e as (select attempt_id, v, count(*) n from fin group by 1, 2), c as (select coalesce(b.attempt_id, e.attempt_id) attempt_id, coalesce(b.v, e.v) v, coalesce(b.n, 0) n0, coalesce(e.n, 0) n1 from b full join e on b.attempt_id = e.attempt_id and b.v = e.v),
l as (select o.*, case when c.n1 < c.n0 and i = max(case when c.n1 < c.n0 then i end) over (partition by o.attempt_id, old) then 'lost' end f1 from o left join c on c.attempt_id = o.attempt_id and c.v = o.old where i >= 0),
d as (select l.*, coalesce(f1, case when c.n1 > c.n0 and i = max(case when c.n1 > c.n0 and f1 is null then i end) over (partition by l.attempt_id, l.v) then 'duplicate' end) flag from l left join c on c.attempt_id = l.attempt_id and c.v = l.v) select attempt_id, i, cell, old, v "value", flag from d""")
def r14_memory_flags(steps):
    ini = steps.select("attempt_id", "test").distinct().select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("cell")).withColumn("value", F.col("cell") % 3)
    return R.memory_flags(steps.select("attempt_id", "test", "i", "cell", "value"), ini).drop("test")
