"""Lines that many documents repeat go from all but one of them, by hashes of their keys.

The hashes of all long lines, 128 bits each, are partitioned by range and sorted within each range by document, the
largest first, and position. A window streams through each run of equal hashes: its first occurrences stay, and if the
run spans enough documents what follows is dropped. What comes back is not text but a bitmap for each document, with
only those words of 64 lines in which something goes; it is applied where the texts are.

Hot keys: a sample of the lines names keys that may have more than an eighth of a range's rows (at most eight a
range, so they may travel); their runs are cut into ways by a hash of the row. Each way hands on its `least` largest
documents, which are enough to tell both the largest of all and whether there are `least` of them. The sample only
steers the balance: any key, named or not, is judged by all its rows.

Only DataFrame expressions, no Python on the executors.

Defined cases: a null text is one empty line, as is an empty one; documents are told apart by id, so repeated rows
count once and several texts of one id count as one document (each keeps its own lines); rows without an id are one
document, below all others; an empty table gives an empty result; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts_for, written

#: White space that keys are stripped of: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One line of so many is looked at for hot keys; rows of one key among them from which it may be hot.
SAMPLE, SAMPLED = 64, 32
#: Bytes of one line's row while it is shuffled, and of a range.
ROW_BYTES, RANGE_BYTES = 48, 16 << 20
#: The place of documents without an id.
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(row, doc, tie, text): the whole row, its document and which of the document's texts it has."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(body).alias("tie"), body.alias("text"))


def long_lines(keyed: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, doc, tie, pos) of each line whose key has at least that many code points."""
    each = keyed.select("doc", "tie", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = each.select("doc", "tie", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= least_chars)
    return key.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "tie", "pos")


def hot_keys(lines: DataFrame) -> tuple[DataFrame, int]:
    """(h1, h2, ways) of the keys that a sample of the lines shows to be hot, at most eight for each range, and the number of ranges."""
    counts = written(lines.sample(False, 1 / SAMPLE, 13).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")), "line_sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    ranges = parts_for(lines.sparkSession, total * SAMPLE * ROW_BYTES, RANGE_BYTES)
    hot = counts.filter(F.col("n") >= max(SAMPLED, total / (8 * ranges)))
    return hot.select("h1", "h2", F.ceil(F.col("n") * F.lit(4 * ranges / max(total, 1))).cast("int").alias("ways")), ranges


def dropped_lines(keyed: DataFrame, least_chars: int, least: int) -> DataFrame:
    """(doc, tie, pos) of the lines that go. Texts are split once; what is sampled, ranged and sorted are hashes and places."""
    lines = written(long_lines(keyed, least_chars), "lines")
    hot, ranges = hot_keys(lines)
    way = F.when(F.col("ways").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc", "tie", "pos", F.spark_partition_id()), F.col("ways")) + 1).cast("int")
    rows = lines.join(F.broadcast(hot), ["h1", "h2"], "left").select("h1", "h2", way.alias("way"), "doc", "tie", "pos")
    ordered = rows.repartitionByRange(ranges, "h1", "h2", "way").sortWithinPartitions("h1", "h2", "way", F.desc("doc"), "pos")
    run = W.partitionBy("h1", "h2", "way")
    ranked = ordered.withColumn("place", F.dense_rank().over(run.orderBy(F.desc("doc")))).withColumn("places", F.max("place").over(run))
    ranked = written(ranked.filter((F.col("way") > 0) | (F.col("place") > 1) & (F.col("places") >= least)).drop("places"), "line_runs")
    go, apart = ranked.filter("way = 0"), ranked.filter("way > 0")
    # of each way the largest documents, of all ways the largest one: at most eight keys a range
    firsts = apart.filter(F.col("place") <= least).select("h1", "h2", "doc").distinct()
    firsts = firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("first")).filter(F.col("n") >= least)
    cut = apart.join(F.broadcast(firsts), ["h1", "h2"]).filter("doc < first")
    return go.select("doc", "tie", "pos").unionByName(cut.select("doc", "tie", "pos"))


def _bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, tie, n_dropped, words, keeps) from the dropped lines."""
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = dropped.groupBy("doc", "tie", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    by = words.groupBy("doc", "tie").agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("keep")))).alias("found"))
    return by.select("doc", "tie", "n_dropped", F.col("found.word").alias("words"), F.col("found.keep").alias("keeps"))


def keep_bitmaps(docs: DataFrame, id: str = "doc_id", text: str = "text", least_chars: int = 40, least: int = 5) -> DataFrame:
    """(doc_id, tie, n_dropped, words, keeps) of the documents that lose lines; tie is xxhash64 of the text.

    keeps[i] is the bitmap of the lines from 64 * words[i] on, the lowest bit first, 1 for those that stay; words in
    which all stay are left out.
    """
    found = _bitmaps(dropped_lines(_keyed(docs, id, text), least_chars, least))
    return found.withColumn("doc", F.when(F.col("doc") != NO_ID, F.col("doc"))).withColumnRenamed("doc", "doc_id")


def _applied(docs: DataFrame, id: str, text: str, least_chars: int, least: int) -> DataFrame:
    """(row, n_lines, n_dropped, kept): every row of docs with its lines that stay."""
    keyed = _keyed(docs, id, text)
    both = keyed.join(_bitmaps(dropped_lines(keyed, least_chars, least)), ["doc", "tie"], "left")
    lines = F.split("text", "\n")
    both = both.withColumn("n_lines", F.size(lines).cast("long"))
    dense = F.transform(F.sequence(F.lit(0), F.expr("cast((n_lines - 1) div 64 as int)")), lambda w: F.coalesce(F.get("keeps", (F.array_position("words", w) - 1).cast("int")), F.lit(-1).cast("long")))
    flags = F.flatten(F.transform(dense, lambda x: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(x, b))))
    kept = F.array_join(F.zip_with(lines, flags, lambda line, flag: F.when(flag == 1, line)), "\n")  # nulls are skipped
    return both.select("row", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("words").isNull(), F.col("text")).otherwise(kept).alias("kept"))


def remove_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least_chars: int = 40, least: int = 5) -> DataFrame:
    """docs with the repeated lines gone from text: keys of at least least_chars code points in at least `least` documents.

    A null text stays null; all other columns stay as they are.
    """
    out = _applied(docs, id, text, least_chars, least)
    return out.select(*[F.when(F.col("row")[text].isNotNull(), F.col("kept")).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def line_digest(docs: DataFrame, id: str = "doc_id", text: str = "text", least_chars: int = 40, least: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row."""
    out = _applied(docs.select(id, text), id, text, least_chars, least)
    return out.select(F.col("row")[id].alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
