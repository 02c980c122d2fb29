"""Where queries are registered, with the SQL they have to agree with, and the logical tables both read.

A logical table is a view over the given tables in SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
SQL: dict[str, tuple] = {}
GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name: (tables it reads, SELECT)
LOGICAL: dict[str, tuple[tuple[str, ...], str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or a logical table."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, sql = LOGICAL[name]
    frames = {n: table(spark, sf_dir, n) for n in needs}
    for n in needs:
        sql = sql.replace("{" + n + "}", "{_" + n + "}")
    return spark.sql(sql, **{"_" + n: f for n, f in frames.items()})


def _order(names: tuple[str, ...], done: list[str]) -> list[str]:
    for n in names:
        if n not in done and n not in GIVEN:
            _order(LOGICAL[n][0], done)
            done.append(n)
    return done


def duck(names: tuple[str, ...], sql: str) -> str:
    """The SQL with the logical tables it reads as common table expressions."""
    ctes = []
    for n in _order(names, []):
        body = LOGICAL[n][1]
        for m in LOGICAL[n][0]:
            body = body.replace("{" + m + "}", m)
        ctes.append(f"{n} as ({body})")
    sql, head = sql.strip(), "with "
    if sql.lower().startswith("recursive "):
        sql, head = sql[len("recursive ") :], "with recursive "
    if sql.lower().startswith("with "):
        return head + ", ".join([*ctes, sql[5:]])
    return f"{head}{', '.join(ctes)} {sql}" if ctes else sql


def query(name: str, *reads: str, sql: str | None = None):
    """Registers a function of one DataFrame for each table it reads."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(table(spark, sf_dir, n) for n in reads))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = (reads, sql)
        return f

    return put


def logical(name: str, *reads: str, sql: str) -> None:
    LOGICAL[name] = (reads, sql)


logical(
    "responses",
    "events",
    sql="""select user_id learner_id, case event_type when 'signup' then 'M01' when 'purchase' then 'M02' when 'view' then 'M03' when 'click' then 'D01' else 'D05' end class,
  event_id seq, ts, case when event_id % 11 = 0 then 'intervention_done' else case event_id % 5 when 0 then 'trap' when 1 then 'transfer_code' when 2 then 'belief_mcq' when 3 then 'ghost' else 'same_family_code' end end kind,
  value >= 15e0 + (user_id % 6) * 5e0 correct, event_id % 7 = 0 hint, cast(event_id % 4 as int) levels,
  case event_id % 3 when 0 then 'count_loop' when 1 then 'array_accumulate' else 'rec_array' end family, concat('I', cast(event_id % 40 as varchar(20))) item_id from {events}""",
)
logical(
    "attempts",
    "orders",
    "lineitem",
    sql="""select o.o_orderkey attempt_id, o.o_custkey learner_id, o.o_orderdate ts, concat(case when min(l.l_partkey) % 2 = 0 then 'P' else 'Q' end, cast(min(l.l_partkey) % 40 as varchar(20))) problem_id, count(*) total,
  sum(case when l.l_returnflag <> 'R' then 1 else 0 end) passed, o.o_orderpriority sector, cast(1 + min(l.l_partkey) % 3 as int) difficulty,
  case min(l.l_partkey) % 6 when 0 then 'M01' when 1 then 'M02' when 2 then 'M03' when 3 then 'D01' when 4 then 'D05' else 'CORRECT' end top,
  case o.o_orderstatus when 'F' then 'confident' when 'O' then 'two_bug' else 'ambiguous' end status, (o.o_orderkey % 100) / 100e0 top_p,
  case when o.o_orderkey % 4 = 0 then 'M03' when o.o_orderkey % 4 = 1 then 'D05' end latent, case when o.o_orderkey % 2 = 0 then 0.4e0 when o.o_orderkey % 6 = 1 then 0.7e0 end exposure
  from {orders} o join {lineitem} l on l.l_orderkey = o.o_orderkey group by o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_orderpriority, o.o_orderstatus""",
)
_EXPOSED = "select p_partkey item_id, p_type sector, cast(1 + p_size % 3 as int) difficulty, '{c}' class, case when (p_partkey + {k}) % 3 = 0 then 0.7e0 when (p_partkey + {k}) % 3 = 1 then 0.4e0 else 0.1e0 end exposure from {part} where (p_partkey + {k}) % 2 = 0"
logical("exposures", "part", sql=" union all ".join(_EXPOSED.replace("{c}", c).replace("{k}", str(k)) for k, c in enumerate(("M01", "M02", "M03", "D01", "D05"))))
_LABELS = "M01,M02,M03,M04,M05,M06,M07,M08,M10,D01,D02,D03,D04,D05,D06,D07,D08"
# choice items: one for each size of parts
logical("choices", "part", sql="select distinct concat('I', cast(p_size as varchar(9))) item_id, p_size k, split(case when p_size % 3 = 0 then 'a,b,c' else 'a,b,c,d' end, ',') options, split_part('a,b,c', ',', cast(1 + p_size % 3 as int)) correct from {part}")
logical(
    "beliefs",
    "choices",
    sql=f"""select item_id, split_part('{_LABELS}', ',', cast(1 + k % 17 as int)) label, split_part('a,b,c', ',', cast(1 + (k + 1) % 3 as int)) believed from {{choices}}
  union all select item_id, split_part('{_LABELS}', ',', cast(1 + (k * 5 + 3) % 17 as int)), split_part('a,b,c', ',', cast(1 + (k + k % 2 + 1) % 3 as int)) from {{choices}} where k % 17 <> (k * 5 + 3) % 17""",
)
logical("answers", "lineitem", sql="select distinct l_orderkey key, concat('I', cast(1 + l_partkey % 50 as varchar(9))) item_id, min(split_part('a,b,c,d,e', ',', cast(1 + l_suppkey % 5 as int))) answer from {lineitem} group by l_orderkey, concat('I', cast(1 + l_partkey % 50 as varchar(9)))")
logical(
    "corpus",
    "documents",
    "labels",
    sql="""select d.doc_id id, d.text code, case when d.doc_id % 3 = 0 then 'AMB' when d.doc_id % 3 = 1 then 'E' else 'A' end source, d.source bank, d.lang problem_id,
  case when l.toxic is null then case when d.doc_id % 5 = 0 then 'OTHER' else 'CORRECT' end when l.toxic = 1 then 'M08' when l.quality = 1 then 'M01' else 'D01' end label,
  concat('op', cast(d.doc_id % 12 as varchar(20)), case when d.doc_id % 4 = 0 then '+op1' else '' end) op_id, d.doc_id % 9 = 0 passes_by_luck, case when d.doc_id % 10 = 0 then 'holdout' else 'train' end split, d.n_chars
  from {documents} d left join {labels} l on l.doc_id = d.doc_id""",
)
logical("predictions", "embeddings", sql="select vec_id id, concat('c', cast(label as varchar(9))) truth, concat('c', cast(case when vec_id % 3 = 0 then label else (label + vec_id) % 10 end as varchar(9))) pred, 0.3e0 + (vec_id * 37 % 71) / 100e0 conf, vec_id % 20 cluster, case when vec_id % 2 = 0 then 'main' else 'dsa' end domain, concat('p', cast(vec_id % 7 as varchar(9))) problem_id, label y from {embeddings}")
