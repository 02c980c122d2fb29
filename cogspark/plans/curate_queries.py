"""Curation over documents with their labels as a labelled corpus."""

from pyspark.sql import functions as F

from ..functions import columns as L
from ..functions import constants as C
from ..functions.columns import jaccard, token_set
from ..operators import curate as D
from .registry import query

_H = r"h as (select *, 'h_' || substr(sha256(trim(regexp_replace(lower(code), '\s+', ' ', 'g'))), 1, 16) hash from corpus)"
_MAJOR = "n as (select hash, label, count(*) n from h group by 1, 2), m as (select hash, list(label order by label) labels_all, max_by(label, (n, label)) major from n group by 1)"
_SHOW = ("id", "hash", "label")


@query("d_fingerprint", "corpus", sql=f"with {_H} select id, hash from h")
def d_fingerprint(corpus):
    return D.with_fingerprint(corpus).select("id", "hash")


@query("p_training_rows", "corpus", sql="select id, label from corpus where split <> 'holdout' and not passes_by_luck")
def p_training_rows(corpus):
    return D.training_rows(corpus).select("id", "label")


@query("p_slice_masks", "corpus", sql="select id, split = 'train' bank_train, split = 'holdout' holdout, false realistic from corpus")
def p_slice_masks(corpus):
    return D.slice_masks(corpus).select("id", "bank_train", "holdout", "realistic")


@query("d_resolve_clashes", "corpus", sql=f"with {_H}, {_MAJOR} select id, h.hash, label, array_to_string(labels_all, ',') labels_all, labels_all = ['M01', 'M08'] soft from h join m on m.hash = h.hash where labels_all = ['M01', 'M08'] or label = major")
def d_resolve_clashes(corpus):
    return D.resolve_clashes(D.with_fingerprint(corpus)).select(*_SHOW, F.array_join("labels_all", ",").alias("labels_all"), "soft")


@query("d_clashes", "corpus", sql=f"with {_H}, {_MAJOR} select hash, array_to_string(labels_all, ',') labels, major kept from m where len(labels_all) > 1 and labels_all <> ['M01', 'M08']")
def d_clashes(corpus):
    return D.clashes(D.with_fingerprint(corpus))


@query("d_expand_ambiguous", "corpus", sql=f"with {_H}, a as (select * from h where source = 'AMB' and label in ('M01', 'M08')), w as (select distinct hash, l from a cross join (values ('M01'), ('M08')) v(l)) select hash, l label from w where (hash, l) not in (select hash, label from a)")
def d_expand_ambiguous(corpus):
    return D.expand_ambiguous(D.with_fingerprint(corpus)).select("hash", "label")


@query("d_dedupe_by_priority", "corpus", sql="select id from corpus qualify row_number() over (partition by label, code order by case source when 'AMB' then 1 when 'E' then 2 else 3 end, id) = 1")
def d_dedupe_by_priority(corpus):
    return D.dedupe_by_priority(corpus).select("id")


@query(
    "d_capped_round_robin",
    "corpus",
    sql="""with t as (select *, row_number() over (partition by label, problem_id, op_id order by id) turn from corpus), h as (select label, count(*) filter (turn <= 3) held from t group by 1),
k as (select t.* from t join h on h.label = t.label where turn <= case when held < 60 then turn else 3 end), r as (select *, row_number() over (partition by label order by turn, problem_id, op_id, id) rk from k) select id, label, turn::int turn, rk::int "rank" from r where rk <= 90""",
)
def d_capped_round_robin(corpus):
    return D.capped_round_robin(corpus.select("id", "label", "problem_id", "op_id"), "label", ["problem_id", "op_id"], 90, 60, 3).select("id", "label", "turn", "rank")


@query("d_backfill", "corpus", sql="with p as (select * from corpus where id % 3 = 0), h as (select label, count(*) n from p group by 1), r as (select c.id, c.label, coalesce(n, 0) n, row_number() over (partition by c.label order by c.id) rn from corpus c left join h on h.label = c.label where c.id % 3 <> 0) select id, label from r where rn <= 80 - n")
def d_backfill(corpus):
    return D.backfill(corpus, corpus.filter("id % 3 = 0")).select("id", "label")


@query("d_balance_share", "corpus", sql="with s as (select id, label = 'M01' sp from corpus), n as (select count(*) filter (sp) n from s), r as (select id, sp, row_number() over (partition by sp order by id) rn from s) select id from r, n where sp or rn <= floor(n * 0.7e0 / 0.3e0)")
def d_balance_share(corpus):
    return D.balance_share(corpus, F.col("label") == "M01").select("id")


@query(
    "d_judge",
    "attempts",
    sql="select attempt_id, case when total = 0 then 'fail_tests' when total = passed then 'luck' when top <> coalesce(latent, 'none') and latent is not null then 'other_class' when latent is null then 'predicate' else 'keep' end decision from attempts",
)
def d_judge(attempts):
    fired = F.when(F.col("latent").isNull(), F.array().cast("array<string>")).otherwise(F.array("latent"))
    rows = attempts.select("attempt_id", (F.col("total") - F.col("passed")).alias("tests_failed"), F.col("total").alias("tests_total"), fired.alias("fired"), F.col("top").alias("label"))
    return D.judge(rows).select("attempt_id", "decision")


@query(
    "d_two_bug_pairs",
    "lineitem",
    sql="with e as (select distinct l_orderkey problem_id, 'op' || (l_partkey % 7) op_id, l_linenumber % 3 test from lineitem where l_returnflag = 'R') select a.problem_id, a.op_id op_a, b.op_id op_b, count(distinct a.test) common from e a join e b on a.problem_id = b.problem_id and a.test = b.test and a.op_id < b.op_id group by 1, 2, 3",
)
def d_two_bug_pairs(lineitem):
    rows = lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("problem_id"), F.concat(F.lit("op"), F.col("l_partkey") % 7).alias("op_id")).agg(F.collect_set(F.col("l_linenumber") % 3).alias("fails"))
    return D.two_bug_pairs(rows)


@query("d_drop_report", "corpus", sql="with a as (select op_id, count(*) attempts, count(*) filter (id % 5 <> 0) kept, count(*) filter (passes_by_luck) luck from corpus group by 1) select op_id, attempts, kept, luck, round(luck / attempts, 6) drop_low, round((attempts - kept) / attempts, 6) drop_high, kept + luck > attempts inconsistent from a")
def d_drop_report(corpus):
    return D.drop_report(corpus, corpus.filter("id % 5 <> 0"), corpus.filter("passes_by_luck")).withColumns({c: F.round(c, 6) for c in ("drop_low", "drop_high")})


@query("d_class_weights", "corpus", sql="with s as (select label l, case when id % 7 = 0 then 0.5e0 else 1e0 end p from corpus union all select 'M08', 0.5e0 from corpus where id % 7 = 0), m as (select l, sum(p) mass from s group by 1) select l label, round(mass, 6) mass, round((select sum(mass) from m) / ((select count(*) from m) * mass), 6) weight from m")
def d_class_weights(corpus):
    half = F.col("id") % 7 == 0
    soft = F.transform(F.filter(F.array(F.struct(F.col("label").alias("l"), F.when(half, 0.5).otherwise(1.0).alias("p")), F.struct(F.lit("M08").alias("l"), F.when(half, 0.5).otherwise(0.0).alias("p"))), lambda x: x["p"] > 0), lambda x: x)
    # a map holds a label once: equal halves are put together
    once = F.when(F.col("label") == "M08", F.create_map(F.col("label"), F.lit(1.0))).otherwise(F.map_from_entries(soft))
    return D.class_weights(D.soft_expand(corpus.withColumn("soft_label", once))).withColumns({c: F.round(c, 6) for c in ("mass", "weight")})


@query("d_grouped_folds", "corpus", sql="with n as (select bank, problem_id, count(*) n from corpus group by 1, 2), p as (select *, row_number() over (partition by problem_id order by n desc, bank) - 1 pos from n) select bank, problem_id, n, (case when (pos // 5) % 2 = 0 then pos % 5 else 4 - pos % 5 end)::int fold from p")
def d_grouped_folds(corpus):
    return D.grouped_folds(corpus, "bank", "problem_id")


@query("j_leak_free", "corpus", sql=f"with {_H} select id from h where split = 'train' and hash not in (select hash from h where split = 'holdout')")
def j_leak_free(corpus):
    rows = D.with_fingerprint(corpus)
    return D.leak_free(rows.filter("split = 'train'"), rows.filter("split = 'holdout'")).select("id")


_HOLD = "o as (select label, unnest(list_filter(string_split(op_id, '+'), lambda x: x <> '')) op from corpus), n as (select label, op, count(*) n from o group by 1, 2), pl as (select label, max(case when n >= 8 then op end) held from n group by 1 having count(*) >= 2 and max(case when n >= 8 then op end) is not null)"


@query("d_operator_holdout", "corpus", sql=f"with {_HOLD} select pl.label, held, n.n from pl join n on n.label = pl.label and n.op = held")
def d_operator_holdout(corpus):
    return D.operator_holdout(corpus)


@query("d_holdout_split", "corpus", sql=f"with {_HOLD} select id, case when list_contains(string_split(op_id, '+'), held) then case when op_id = held then 'test' else 'drop' end else 'train' end part from corpus c left join pl on pl.label = c.label")
def d_holdout_split(corpus):
    return D.holdout_split(corpus, D.operator_holdout(corpus)).select("id", "part")


@query("d_leave_one_class_out", "corpus", sql="select case when label = 'M01' then 'test' else 'train' end part, problem_id, count(*) n from corpus group by 1, 2")
def d_leave_one_class_out(corpus):
    return D.leave_one_class_out(corpus, "M01").groupBy("part", "problem_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d_pick_diverse",
    "corpus",
    sql="with r as (select *, row_number() over (partition by label, problem_id order by n_chars, id) a, row_number() over (partition by label, op_id order by n_chars, id) b from corpus), u as (select *, case when a = 1 and b = 1 then 1 when b = 1 then 2 else 3 end rl from r), k as (select *, row_number() over (partition by label order by rl, n_chars, id) rk from u) select id, label, rl::int rule, rk::int \"rank\" from k where rk <= 10",
)
def d_pick_diverse(corpus):
    return D.pick_diverse(corpus.withColumn("diff", F.col("n_chars")), 10).select("id", "label", "rule", "rank")


@query("d_compose_bank", "exposures", sql="with c as (select item_id, class, case when difficulty = 1 then 'probe' when difficulty = 2 then 'trap' else 'quiz' end type, item_id % 50 = 0 collision from exposures), r as (select *, row_number() over (partition by class, type, collision order by item_id) rk from c) select item_id, class, type, collision from r where collision or rk <= case type when 'probe' then 5 when 'trap' then 2 else 0 end")
def d_compose_bank(exposures):
    rows = exposures.select("item_id", "class", F.when(F.col("difficulty") == 1, "probe").when(F.col("difficulty") == 2, "trap").otherwise("quiz").alias("type"), (F.col("item_id") % 50 == 0).alias("collision"))
    return D.compose_bank(rows, {"probe": 5, "trap": 2})


@query("d_adjudicate", "corpus", sql=f"with {_H}, o as (select hash from h where id % 17 = 0 group by 1) select id, case when o.hash is not null then 'OTHER' else label end label, case when o.hash is not null then label end old_label from h left join o on o.hash = h.hash")
def d_adjudicate(corpus):
    rows = D.with_fingerprint(corpus)
    over = rows.filter("id % 17 = 0").select("hash", F.lit("OTHER").alias("new_label"), F.lit("checked").alias("reason")).distinct()
    return D.adjudicate(rows, over).select("id", "label", "old_label")


@query("o_assign_ids", "corpus", sql="select id, printf('%s-%06d', source, row_number() over (partition by source order by label, id)) new_id from corpus")
def o_assign_ids(corpus):
    return D.assign_ids(corpus.select("id", "label", "source"), ["label", "id"]).select("id", "new_id")


@query("p_feature_dropout", "corpus", sql="select id, case when (('0x' || substr(md5(id || ':42'), 1, 8))::bigint) / 4294967296e0 >= 0.15e0 then n_chars end n_chars from corpus")
def p_feature_dropout(corpus):
    return D.feature_dropout(corpus, "id", ["n_chars"]).select("id", "n_chars")


@query("p_mask_groups", "lineitem", sql="select l_orderkey, l_linenumber, l_quantity, null::double l_tax, null::double l_discount from lineitem")
def p_mask_groups(lineitem):
    return D.mask_groups(lineitem, {"A"}, {"l_quantity": "A", "l_tax": "B", "l_discount": "C"}).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount")


@query("p_allowed_ops", "corpus", sql="with o as (select distinct op_id from corpus), p as (select distinct problem_id from corpus) select problem_id, op_id from o, p where op_id like 'op1%' or op_id = 'op3' or (problem_id = 'fr' and op_id like 'op%+op1')")
def p_allowed_ops(corpus):
    globs = F.when(F.col("problem_id") == "fr", F.array(F.lit("op1*"), F.lit("op3"), F.lit("op*+op1"))).otherwise(F.array(F.lit("op1*"), F.lit("op3")))
    return D.allowed_ops(corpus, corpus.select("problem_id").distinct().withColumn("allowed_ops", globs))


@query("d_dataset_card", "corpus", sql=f"""with {_H} select 'label' section, label "key", count(*) n from h group by label union all select 'source', source, count(*) from h group by source union all select 'problem', problem_id, count(*) from h group by problem_id
union all select 'label_source', label || '|' || source, count(*) from h group by label, source union all select 'rows', '', count(*) from h union all select 'distinct_hash', '', count(distinct hash) from h union all select 'distinct_cell', '', count(distinct (problem_id, op_id)) from h""")
def d_dataset_card(corpus):
    return D.dataset_card(D.with_fingerprint(corpus))


@query("u_union_by_name", "corpus", sql="select id, label, 'kept' part from corpus where id % 2 = 0 union all select id, label, 'clone' from corpus where source = 'AMB'")
def u_union_by_name(corpus):
    return corpus.filter("id % 2 = 0").select("id", "label", F.lit("kept").alias("part")).unionByName(corpus.filter("source = 'AMB'").select(F.lit("clone").alias("part"), "label", "id"))


@query("u_intersect_except", "corpus", sql="with k as (select distinct problem_id, op_id from corpus where not passes_by_luck), l as (select distinct problem_id, op_id from corpus where passes_by_luck) select 'both' part, * from (select * from k intersect select * from l) union all select 'kept', * from (select * from k except select * from l) union all select 'luck', * from (select * from l except select * from k)")
def u_intersect_except(corpus):
    k = corpus.filter("not passes_by_luck").select("problem_id", "op_id")
    luck = corpus.filter("passes_by_luck").select("problem_id", "op_id")
    part = lambda name, df: df.select(F.lit(name).alias("part"), "problem_id", "op_id")
    return part("both", k.intersect(luck)).unionByName(part("kept", k.subtract(luck))).unionByName(part("luck", luck.subtract(k)))


@query("f_token_jaccard", "documents", "benchmark", sql="""with b as (select item_id, regexp_extract_all(lower(text), '[a-z0-9'']+') t from benchmark), d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') t from documents),
j as (select doc_id, item_id, list_distinct(d.t) x, list_distinct(b.t) y from d join b on b.item_id = d.doc_id % 40) select doc_id, item_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) jaccard from j""")
def f_token_jaccard(documents, benchmark):
    b = benchmark.select("item_id", token_set(F.col("text")).alias("y"))
    d = documents.select("doc_id", (F.col("doc_id") % 40).alias("item_id"), token_set(F.col("text")).alias("x"))
    return d.join(b, "item_id").select("doc_id", "item_id", F.round(jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query("d6_fill_total", "corpus", sql="select id, label from corpus where id % 3 <> 0 order by id limit greatest(0, 400 - (select count(*) from corpus where id % 3 = 0))")
def d6_fill_total(corpus):
    return D.fill_total(corpus, corpus.filter("id % 3 = 0"), 400).select("id", "label")


@query("d8_judge_modes", "attempts", sql="""with a as (select *, case attempt_id % 9 when 0 then 'parse_error' when 1 then 'timeout' else 'ok' end s, case attempt_id % 4 when 0 then 'correct' when 1 then 'other' else 'bug' end m, attempt_id % 5 = 0 odd, list_filter([top, latent], lambda x: x is not null and x <> 'CORRECT') f from attempts)
select attempt_id, case when s = 'parse_error' then 'parse' when m = 'correct' then case when passed = total and s = 'ok' then 'keep' else 'fail_tests' end when passed = total then 'luck' when m = 'other' then case when len(f) > 0 then 'other_class' else 'keep' end
  when len(list_filter(f, lambda x: x <> 'M01')) > 0 and not list_contains(f, 'M01') then 'other_class' when odd then 'odd_n' when not list_contains(f, 'M01') then 'predicate' else 'keep' end decision from a""")
def d8_judge_modes(attempts):
    k = F.col("attempt_id")
    fired = F.filter(F.array("top", "latent"), lambda x: x.isNotNull() & (x != "CORRECT"))
    rows = attempts.select("attempt_id", (F.col("total") - F.col("passed")).alias("tests_failed"), F.col("total").alias("tests_total"), fired.alias("fired"), F.lit("M01").alias("label"), F.when(k % 9 == 0, "parse_error").when(k % 9 == 1, "timeout").otherwise("ok").alias("status"), F.when(k % 4 == 0, "correct").when(k % 4 == 1, "other").otherwise("bug").alias("mode"), (k % 5 != 0).alias("odd_ok"))
    return D.judge(rows).select("attempt_id", "decision")


@query("d18_rater_agreement", "corpus", sql="with r as (select label, case when id % 4 = 0 then null when id % 4 = 1 then label else 'M08' end r2, id % 6 < 2 soft from corpus) select count(*) n, count(*) filter (label = case when soft and r2 in ('M01', 'M08') then 'M01' else coalesce(r2, 'none') end) agree, round(count(*) filter (label = case when soft and r2 in ('M01', 'M08') then 'M01' else coalesce(r2, 'none') end) / count(*), 6) share from r")
def d18_rater_agreement(corpus):
    soft = F.when(F.col("id") % 6 < 2, F.map_from_arrays(F.array(F.lit("M01"), F.lit("M08")), F.array(F.lit(0.5), F.lit(0.5))))
    rows = corpus.select("label", soft.alias("soft_label"), F.when(F.col("id") % 4 == 1, F.col("label")).when(F.col("id") % 4 > 1, "M08").alias("rater2"))
    return D.rater_agreement(rows).withColumn("share", F.round("share", 6))


@query("j3_leak_free_held", "corpus", sql=r"with h as (select *, case when id % 7 = 0 then '' else substr(md5(code), 1, 4) end k from corpus) select id from h where k not in (select k from h where id % 11 = 0 and k <> '') and not list_contains(string_split(op_id, '+'), 'op3') and id % 11 <> 0")
def j3_leak_free_held(corpus):
    rows = corpus.withColumn("hash", F.when(F.col("id") % 7 == 0, "").otherwise(F.substring(F.md5("code"), 1, 4)))
    return D.leak_free(rows.filter("id % 11 <> 0"), rows.filter("id % 11 = 0"), held="op3").select("id")


@query("a3_effective_n", "corpus", sql="select count(*) n_rows, count(distinct md5(code)) n_hashes, count(distinct (problem_id, op_id)) filter (problem_id is not null and op_id is not null) n_cells from corpus")
def a3_effective_n(corpus):
    return D.effective_n(corpus.withColumn("hash", F.md5("code")))


def _bank(part):
    """Parts as items: their names are the programs, a seventh has two classes."""
    k = F.col("p_partkey")
    cls = F.element_at(F.lit(C.MISCONCEPTIONS), (1 + F.length("p_type") % 5).cast("int"))
    kind = F.when(F.col("p_size") % 4 == 0, "mcq").when(F.col("p_size") % 4 == 1, "next_state").otherwise("predict_output")
    return part.select(k.alias("item_id"), cls.alias("class"), kind.alias("type"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("code"), (k % 7 == 0).alias("collision"), (k % 5 != 0).alias("has_options"), (k % 11 == 0).alias("in_problem"))


@query("d16_choose_bank", "part")
def d16_choose_bank(part):
    """No SQL: which items are too close depends on those chosen before. The tests hold it against a plain loop."""
    return D.choose_bank(_bank(part))


@query("d16_bank_gaps", "part")
def d16_bank_gaps(part):
    return D.bank_gaps(D.choose_bank(_bank(part)), C.MISCONCEPTIONS)


@query("f_matching_ratio", "part")
def f_matching_ratio(part):
    """How alike a part's name and type are, and whether they are too close. No SQL: blocks are matched recursively."""
    a, b = F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_name")
    return part.select("p_partkey", F.round(L.matching_ratio(a, b), 6).alias("ratio"), L.is_close(a, b).alias("close"))
