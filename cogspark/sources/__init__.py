"""Readers, writers and views of metric documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """One object a line; blank lines are left out."""
    return spark.read.schema(schema).json(path)


def read_bank(spark: SparkSession, glob: str, schema) -> DataFrame:
    """Files with an object or an array of objects each, ordered by nothing; `file` names the source."""
    return spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("file", F.input_file_name())


def token_usage(cache: DataFrame) -> DataFrame:
    """(job, calls, prompt_tokens, completion_tokens) of a response cache (job, usage STRUCT)."""
    n = lambda f: F.sum(F.coalesce(F.col(f"usage.{f}"), F.lit(0))).alias(f)
    return cache.groupBy("job").agg(F.count(F.lit(1)).alias("calls"), n("prompt_tokens"), n("completion_tokens"))


def scan_response_cache(spark: SparkSession, path: str) -> DataFrame:
    """(job, usage, file) of a folder of cached responses: a file holds an object or an array of objects."""
    return read_bank(spark, path, "job string, usage struct<prompt_tokens: bigint, completion_tokens: bigint>")


def read_matrix(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A Parquet feature table whose columns must be just these, in this order."""
    df = spark.read.parquet(path)
    if df.columns != columns:
        raise ValueError(f"columns differ: {[c for c in columns if c not in df.columns]} missing, {[c for c in df.columns if c not in columns]} more")
    return df


def event_log(events: DataFrame, learner=None, type: str | None = None) -> DataFrame:
    """A learner's events of a type; both filters reach the scan."""
    if learner is not None:
        events = events.filter(F.col("learner_id") == learner)
    return events if type is None else events.filter(F.col("type") == type)


def json_safe(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, NaN and infinities null."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            out[f.name] = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.round(c, digits))
    return df.withColumns(out) if out else df


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_safe(df).write.mode(mode).json(path)


def write_card(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_safe(df).write.mode(mode).parquet(path)


def merge_cards(cards: DataFrame, expected: list[str]) -> DataFrame:
    """(id, doc, missing): of each id the card of the highest prio; expected ids without one are filled in."""
    best = cards.groupBy("id").agg(F.max_by("doc", "prio").alias("doc"))
    want = cards.sparkSession.createDataFrame([(x,) for x in expected], "id string")
    return best.join(want, "id", "full_outer").withColumn("missing", F.col("doc").isNull())


#: Ids of cards.
CARD_ID = r"^[A-Z][0-9]+[a-z]?$"


def collect_cards(spark: SparkSession, folders: list[str], expected: list[str]) -> DataFrame:
    """(id, doc, missing) of folders of JSON documents: the last folder that has an id wins, in it the last file by name.

    Documents that are no objects or have no proper id are left out; expected ids without a card are filled in.
    """
    cards = None
    for k, folder in enumerate(folders):
        some = spark.read.option("wholetext", True).text(folder).select(F.col("value").alias("doc"), F.struct(F.lit(k).alias("folder"), F.input_file_name().alias("file")).alias("prio"))
        cards = some if cards is None else cards.unionByName(some)
    return merge_cards(cards.withColumn("id", F.get_json_object("doc", "$.id")).filter(F.col("id").rlike(CARD_ID)), expected)


def cross_domain(cards: DataFrame) -> DataFrame:
    """(recall_main_only, shortcut_auc) of card E15; null where the card does not have them."""
    at = lambda k: F.get_json_object("doc", f"$.metrics.{k}").try_cast("double")
    return cards.filter("id = 'E15' and not missing").select(at("m_recall_on_dsa_trained_main_only").alias("recall_main_only"), at("shortcut_auc").alias("shortcut_auc"))


def exam_sim(cards: DataFrame) -> DataFrame:
    """(policy, profile_f1, stable_recheck) of the rows of card E14; the last row of a policy counts."""
    rows = F.from_json(F.get_json_object("doc", "$.rows"), "array<struct<policy: string, profile_f1: double, stable_recheck: double>>")
    each = cards.filter("id = 'E14' and not missing").select(F.posexplode(rows).alias("k", "r")).filter("r.policy is not null")
    return each.groupBy(F.col("r.policy").alias("policy")).agg(F.max_by("r.profile_f1", "k").alias("profile_f1"), F.max_by("r.stable_recheck", "k").alias("stable_recheck"))


def resolution(cards: DataFrame, schema: str) -> DataFrame:
    """The rows of card E10, and its caveat with each. schema: that of a row."""
    rows = F.from_json(F.get_json_object("doc", "$.rows"), f"array<struct<{schema}>>")
    return cards.filter("id = 'E10' and not missing").select(F.inline(rows), F.get_json_object("doc", "$.caveat").alias("caveat"))


def baseline_pivot(cards: DataFrame) -> DataFrame:
    """(name, split, macro_f1) of cards with a metrics MAP<name, MAP<split, DOUBLE>>."""
    return cards.select(F.explode("metrics").alias("name", "m")).select("name", F.explode("m").alias("split", "macro_f1"))


def table_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (n, hash): 16 hex digits that do not depend on the order of rows."""
    cols = columns or df.columns
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in cols])
    # sums of the hash's halves: order-free, and repeated rows do not cancel
    half = lambda i: F.sum(F.conv(F.substring(F.md5(text), i, 8), 16, 10).cast("decimal(20,0)"))
    row = df.agg(F.count(F.lit(1)).alias("n"), half(1).alias("a"), half(9).alias("b"))
    return row.select("n", F.substring(F.md5(F.concat_ws(":", "n", "a", "b")), 1, 16).alias("hash"))
