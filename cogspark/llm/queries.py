"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Families of hosts that serve junk, as the first words of a host's label.
JUNK_HOSTS = ["spam", "casino", "free-bets", "ads-track", "cheap-pills", "adult"]
_JUNK = r"(^|\.)(" + "|".join(JUNK_HOSTS) + ")"


def op1_url_filter(spark, sf_dir):
    """Listed are the keys of hosts with a label that begins as one of JUNK_HOSTS."""
    from .url_filters import filter_urls, url_parts

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_parts(F.col("url"))
    listed = pages.filter(host.rlike(_JUNK)).select(F.concat(host, path).alias("key")).distinct()
    return filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op2_exact_top_k(spark, sf_dir):
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_language_id(spark, sf_dir):
    from .language_id import language_id

    return language_id(_table(spark, sf_dir, "documents"))


def op4_language_model(spark, sf_dir):
    from .pitman_yor import language_model

    return language_model(_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark, sf_dir):
    from .pieces import piece_digest

    return piece_digest(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import repeat_digest

    return repeat_digest(_table(spark, sf_dir, "documents"))


def op7_transport_stream(spark, sf_dir):
    from .transport_stream import media_digest

    return media_digest(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mix_sources(spark, sf_dir):
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_jaccard(spark, sf_dir):
    from .ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    from .hard_negatives import hard_negatives

    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


def op12_whitening(spark, sf_dir):
    from .whitening import whitening

    return whitening(_table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark, sf_dir):
    from .line_dedup import line_digest

    return line_digest(_table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"op1_url_filter": op1_url_filter, "op2_exact_top_k": op2_exact_top_k, "op3_language_id": op3_language_id, "op4_language_model": op4_language_model, "op5_sentencepiece": op5_sentencepiece, "op6_suffix_dedup": op6_suffix_dedup, "op7_transport_stream": op7_transport_stream, "op8_toxicity": op8_toxicity, "op9_mix_sources": op9_mix_sources, "op10_ngram_jaccard": op10_ngram_jaccard, "op11_hard_negatives": op11_hard_negatives, "op12_whitening": op12_whitening, "op13_line_dedup": op13_line_dedup, "pipeline": pipeline}

SQL = {
    "op1_url_filter": r"""
with u as (select page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') h, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path from pages),
v as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, path from u),
r as (select *, case when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
  when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
  when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
  when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end rule from v)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when regexp_matches(host, '""" + _JUNK + """') then 'block' else 'allow' end verdict from r""",
    "op2_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint score from (select distinct vec_id, v from v where vec_id % 100 = 0) q join v c on q.vec_id <> c.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int "rank", vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10""",
    "op10_ngram_jaccard": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) s from w where len(w) > 0),
n as (select doc_id, count(*) n, md5(string_agg(s, '|' order by s)) h from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b, x.h ha, y.h hb from p join n x on x.doc_id = a join n y on y.doc_id = b where i >= 0.8 * (x.n + y.n - i) - 1e-9),
reach(a, b) as (select doc_id, doc_id from n union select r.a, l.b from reach r join l on l.a = r.b),
c as (select a doc_id, min(b) class_id from reach group by 1),
k as (select a doc_id, count(*) n_links, count(distinct case when ha <> hb then hb end) n_texts from l group by 1)
select d.doc_id, coalesce(c.class_id, d.doc_id) class_id, coalesce(n_links, 0) n_links, coalesce(n_texts, 0) n_texts from documents d left join c using (doc_id) left join k using (doc_id)""",
    "op11_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end lab, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, a.lab = c.lab same, c.vec_id, list_dot_product(a.v, c.v)::bigint score from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id negative_id, s.score negative_score, (row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id))::int "rank"
  from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * s.score and s.score <= positive_score)
select anchor_id, positive_id, "rank", negative_id, positive_score, negative_score from n where "rank" <= 5""",
    "op13_line_dedup": """
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') "key" from l),
g as (select "key", max(doc_id) last from k where length("key") >= 40 group by 1 having count(distinct doc_id) >= 5),
f as (select doc_id, pos, line, coalesce(doc_id < last, false) gone from k left join g using ("key"))
select doc_id, count(*) n_lines, sum(gone::int)::bigint n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256 from f group by doc_id""",
}
