"""Exam analytics: ratings, item choice for open sessions, findings, recommendations and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.columns import class_eig, let, lookup, pass_probability, tie_key
from .bayes import belief_exposure, item_eig, labels, likelihood_table, normalise
from .shared import broadcast_if_small, changes, chunked, numbered, written


def elo_trajectory(log: DataFrame, start: float = C.ELO_START, by=("exam_id", "sector")) -> DataFrame:
    """log (by…, seq, difficulty, passed, bonus) to (by…, seq, theta) after each item.

    Not associative: a key's items are sorted and one number goes from item to item, in time linear in their number.
    """
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, t = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            new, last = changes(batch.columns[:n], last)
            first, rating, passed = (batch.column(n + i).to_numpy(zero_copy_only=False).astype(float).tolist() for i in (1, 2, 3))
            out = []
            for i, fresh in enumerate(new.tolist()):
                t = first[i] if fresh else t
                t += C.ELO_K * (passed[i] - 1 / (1 + 10 ** ((rating[i] - t) / 400)))
                out.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(out, pa.float64(), from_pandas=True)], [*by, "seq", "theta"])

    order = W.partitionBy(*by).orderBy("seq", F.col("difficulty").asc_nulls_last(), F.col("passed").asc_nulls_last())
    bonus = F.max("bonus").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    first = F.lit(float(start)) + F.when(bonus, float(C.ELO_BONUS)).otherwise(0.0)
    rating = lookup(F.col("difficulty"), {k: float(v) for k, v in C.ELO_ITEM.items()})
    rows = log.select(*by, "seq", first.alias("first"), rating.cast("double").alias("rating"), F.col("passed").cast("double").alias("passed"))
    kind = dict(log.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kind[c]}" for c in (*by, "seq")) + ", theta double")


def exam_updates(answers: DataFrame, exposure: DataFrame) -> DataFrame:
    """Knowledge events of an exam's coding items: (learner_id, class, ts, seq, kind, correct, exposure, exam).

    answers: (learner_id, item_id, ts, seq, passed, diagnosed, latent); exposure: (item_id, class, exposure). Targets are
    the classes exposed enough, the one diagnosed in a failure and the latent one of a pass. A failed item of the
    diagnosed class is a signature failure, a passed one of the latent class a latent pass, all others exam_code
    answers. A failure with enough exposure counts as a failed ghost for a settled class (see mastery_fold).
    """
    own = F.when(F.col("passed"), F.col("latent")).otherwise(F.col("diagnosed"))
    told = answers.withColumn("told", F.when(own.isin(C.MISCONCEPTIONS), own))
    hit = told.join(exposure.filter(F.col("exposure") >= C.EXAM_MIN_EXPOSURE), "item_id")
    low = exposure.filter(F.col("exposure") < C.EXAM_MIN_EXPOSURE).withColumnRenamed("class", "told")
    enough = exposure.filter(F.col("exposure") >= C.EXAM_MIN_EXPOSURE).select("item_id", F.col("class").alias("told"))
    extra = told.filter("told is not null").join(enough, ["item_id", "told"], "left_anti").join(low, ["item_id", "told"], "left").withColumn("class", F.col("told"))
    rows = hit.unionByName(extra.select(*hit.columns))
    named = F.col("class").eqNullSafe(F.col("told"))
    kind = F.when(named & ~F.col("passed"), "signature_failure").when(named, "latent_pass").otherwise("exam_code")
    return rows.select("learner_id", "class", "ts", "seq", kind.alias("kind"), F.col("passed").alias("correct"), "exposure", F.lit(True).alias("exam"))


def exam_trace_updates(answers: DataFrame, items: DataFrame) -> DataFrame:
    """Knowledge events of an exam's choice items: (learner_id, class, ts, seq, kind, correct, exposure, exam, p_answer).

    answers: (learner_id, item_id, ts, seq, answer); items: (item_id, options, correct, belief). Each class exposed
    enough gets an exam_trace answer; p_answer is how likely a believer was to give it.
    """
    table = likelihood_table(items).select("item_id", F.col("label").alias("class"), F.col("option").alias("answer"), F.col("p").alias("p_answer"))
    cells = belief_exposure(items).filter(F.col("exposure") >= C.EXAM_MIN_EXPOSURE).join(items.select("item_id", F.col("correct").alias("right")), "item_id")
    rows = answers.join(broadcast_if_small(cells), "item_id").join(broadcast_if_small(table), ["item_id", "class", "answer"], "left")
    return rows.select("learner_id", "class", "ts", "seq", F.lit("exam_trace").alias("kind"), (F.col("answer") == F.col("right")).alias("correct"), "exposure", F.lit(True).alias("exam"), F.coalesce("p_answer", F.lit(0.0)).alias("p_answer"))


#: Kinds of items that one row of a tile has at most, and items of a kind that one row of a chunk has.
TILE, CHUNK = 256, 4096


def _kinds(pool: DataFrame, within: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items by what their score depends on: tiles (within…, tile, tiles, kinds) and chunks (alike, chunk, ids in order)."""
    extra = [c for c in ("sector",) if c in pool.columns]
    exposed = pool.filter((F.col("exposure") >= C.EXAM_MIN_EXPOSURE) & F.col("class").isNotNull())
    cells = F.array_sort(F.collect_list(F.struct("class", F.col("exposure").cast("double").alias("exposure"))))
    of = exposed.groupBy("item_id", *within).agg(*[F.first(c).alias(c) for c in ("kind", "difficulty", *extra)], cells.alias("cells"))
    of = written(of.withColumn("alike", F.xxhash64(*within, "kind", "difficulty", *extra, "cells")), "kinds")
    kinds = of.groupBy("alike", *within).agg(*[F.first(c).alias(c) for c in ("kind", "difficulty", *extra, "cells")])
    at = numbered(kinds, tuple(within), ["alike"], "place").withColumn("tile", F.floor((F.col("place") - 1) / TILE))
    tiles = written(at.groupBy(*within, "tile").agg(F.collect_list(F.struct("alike", "kind", "difficulty", *extra, "cells")).alias("kinds")), "tiles")
    if within:
        tiles = tiles.join(broadcast_if_small(tiles.groupBy(*within).agg(F.count(F.lit(1)).alias("tiles"))), within)
    else:
        tiles = tiles.withColumn("tiles", F.lit(tiles.count()))
    chunks = chunked(of, "alike", size=CHUNK)
    return tiles, chunks


def score_kinds(sessions: DataFrame, pool: DataFrame, within: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores by kinds of items that are worth the same to every session, and the kinds' items: what score_candidates holds, in short.

    ((exam_id, alike, difficulty, where the pool has it sector, score, eig), (alike, chunk, ids ARRAY)). Sessions meet the
    kinds, in tiles; a session is one row and its rows stay dealt by exam_id. within: a column of both, in which a
    session (always with one value) and its items agree.
    """
    by = [within] if within else []
    tiles, chunks = _kinds(pool, by)
    own = F.struct("class", "p", "covered", "theta", F.array_contains("ghosts", F.col("class")).alias("ghost"))
    at = sessions.groupBy("exam_id").agg(*[F.first(c).alias(c) for c in by], F.collect_list(own).alias("own"))
    if within:
        n = tiles.groupBy(*by).agg(F.first("tiles").alias("tiles"))
        at = at.join(broadcast_if_small(n), by).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).drop("tiles")
    else:
        at = at.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles.count() - 1)))) if not tiles.isEmpty() else at.withColumn("tile", F.lit(0).cast("long"))
    met = at.join(broadcast_if_small(tiles.drop("tiles")), [*by, "tile"])

    def scored(x):
        cost = F.when(x["kind"] == "coding", C.EXAM_COST["coding"]).otherwise(C.EXAM_COST["trace"])
        mine = lambda c: F.transform(F.filter("own", lambda o: o["class"] == c["class"]), lambda o: F.struct(class_eig(o["p"], c["exposure"], inside=True).alias("bits"), o["covered"].alias("covered"), o["theta"].alias("theta"), o["ghost"].alias("ghost")))
        total = lambda rows, value: F.aggregate(rows, F.lit(0.0), lambda a, r: a + F.coalesce(value(r), F.lit(0.0)))

        def of(rows):
            eig = total(rows, lambda r: r["bits"] / cost)
            coverage = total(rows, lambda r: (~r["covered"]).cast("double")) / F.nullif(F.size(F.filter(rows, lambda r: r["covered"].isNotNull())), F.lit(0))
            off = F.abs(pass_probability(x["difficulty"], F.get(rows, F.lit(0))["theta"]) - C.EXAM_TARGET_PASS)
            ghost = F.exists(rows, lambda r: r["ghost"]).cast("double")
            rest = C.EXAM_W_COVERAGE * coverage - C.EXAM_W_DIFFICULTY * off + C.EXAM_W_GHOST * ghost
            return let(eig, lambda e: F.struct(x["alike"].alias("alike"), x["difficulty"].alias("difficulty"), *([x["sector"].alias("sector")] if "sector" in pool.columns else []), (e + rest).alias("score"), e.alias("eig"), F.size(rows).alias("n")))

        return let(F.flatten(F.transform(x["cells"], mine)), of)

    gains = met.select("exam_id", F.inline(F.transform("kinds", scored))).filter("n > 0").drop("n")
    return gains, chunks


def score_candidates(sessions: DataFrame, pool: DataFrame, within: str | None = None, digits: int | None = None) -> DataFrame:
    """(exam_id, item_id, score, eig): bits for the cost, unseen classes covered, nearness to the target pass rate, ghosts.

    sessions: (exam_id, class, p, covered, theta, ghosts ARRAY); pool: (item_id, kind, difficulty, class, exposure).
    Each session with each item that shares a class with it: scored by kinds, none of these rows is shuffled while the
    items fit a broadcast. digits: what score and eig are rounded to, once for a kind.
    """
    gains, chunks = score_kinds(sessions, pool, within)
    gains = gains.select("exam_id", "alike", *[(F.round(c, digits) if digits is not None else F.col(c)).alias(c) for c in ("score", "eig")])
    return gains.join(broadcast_if_small(chunks.select("alike", "ids")), "alike").select("exam_id", F.explode("ids").alias("item_id"), "score", "eig")


def eligible(candidates: DataFrame, session: DataFrame, per_sector: int = C.RECOMMENDATIONS, consecutive: bool = False, coverage: bool = True) -> DataFrame:
    """Unused items of the plan's sectors, within the quota of their kind and the cap of coding items of their sector.

    Unless `consecutive`, not of the last sector; with `coverage`, only if the slots left after the item still reach all
    sectors that would be uncovered (where the plan has a slot for each sector at all).
    candidates: (exam_id, item_id, kind, sector); session: (exam_id, used ARRAY, left MAP kind to number, by_sector MAP of
    coding items, last_sector, and where present sectors ARRAY, covered ARRAY, slots, the plan's items).
    """
    has = set(session.columns)
    rows = candidates.join(session, "exam_id")
    ok = ~F.array_contains("used", F.col("item_id")) & (F.coalesce(F.element_at("left", F.col("kind")), F.lit(0)) > 0)
    ok = ok & ((F.col("kind") != "coding") | (F.coalesce(F.element_at("by_sector", F.col("sector")), F.lit(0)) < per_sector))
    if not consecutive:
        ok = ok & ~F.col("sector").eqNullSafe(F.col("last_sector"))
    if "sectors" in has:
        ok = ok & F.array_contains("sectors", F.col("sector"))
        if coverage:
            after = F.aggregate(F.map_values("left"), F.lit(0).cast("long"), lambda a, x: a + x) - 1
            uncovered = F.size(F.array_except("sectors", F.array_append("covered", F.col("sector"))))
            ok = ok & ((F.col("slots") < F.size("sectors")) | (uncovered <= after))
    return rows.filter(ok).select(*candidates.columns)


def recommend_exam_item(gains: DataFrame, chunks: DataFrame) -> DataFrame:
    """The best item of each open session, by the kinds of score_kinds; ties by hash, of which a chunk tells its best."""
    top = F.max(F.round("score", 9)).over(W.partitionBy("exam_id"))
    best = gains.withColumn("top", top).filter(F.round("score", 9) == F.col("top"))
    key = lambda i: tie_key(F.col("exam_id").cast("string"), i.cast("string"))
    first = F.array_min(F.transform("ids", lambda i: F.struct(key(i).alias("key"), i.alias("item_id"))))
    tied = best.join(broadcast_if_small(chunks.select("alike", "ids")), "alike").select("exam_id", "score", first.alias("f"))
    return tied.groupBy("exam_id").agg(F.min(F.struct("f.key", "f.item_id", "score")).alias("b")).select("exam_id", "b.item_id", "b.score")


def _alike(pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items by what their worth depends on: (item_id, alike, ...), and tiles of the different kinds of a sector.

    A tile is (sector, tile, tiles, kinds): at most TILE kinds as an array, and how many tiles its sector has.
    """
    cells = F.array_sort(F.transform(F.map_entries("exposure"), lambda e: F.struct(e["key"].alias("class"), e["value"].cast("double").alias("exposure"))))
    extra = [F.col("name")] if "name" in pool.columns else [F.lit(None).cast("string").alias("name")]
    of = pool.select("item_id", "kind", "difficulty", "sector", cells.alias("cells"), *extra)
    of = written(of.withColumn("alike", F.xxhash64("kind", "difficulty", "sector", "cells")), "alike")
    kinds = of.groupBy("alike", "sector").agg(F.first("kind").alias("kind"), F.first("difficulty").alias("difficulty"), F.first("cells").alias("cells"), F.count(F.lit(1)).alias("n_items"))
    at = numbered(kinds, ("sector",), ["alike"], "place").withColumn("tile", F.floor((F.col("place") - 1) / TILE))
    tiles = at.groupBy("sector", "tile").agg(F.collect_list(F.struct("alike", "kind", "difficulty", "n_items", "cells")).alias("kinds"))
    tiles = written(tiles, "tiles")
    n = tiles.groupBy("sector").agg(F.count(F.lit(1)).alias("tiles"))
    return of, tiles.join(broadcast_if_small(n), "sector")


def _bits(cell: Column, p: Column) -> Column:
    """Bits of a cell for a session's P by class; 0 below the least exposure, of a class without a P, and of other labels."""
    counts = cell["class"].isin(C.MISCONCEPTIONS) & (cell["exposure"] >= C.EXAM_MIN_EXPOSURE)
    return F.when(counts, let(F.coalesce(F.element_at(p, cell["class"]), F.lit(0.0)), lambda x: class_eig(x, cell["exposure"], inside=True))).otherwise(0.0)


def recommend_next(sessions: DataFrame, pool: DataFrame, names: dict | None = None, sectors: dict | None = None, per_sector: int = C.RECOMMENDATIONS) -> DataFrame:
    """(exam_id, item_id, sector, score, eig, reason): the next item of each open exam; exams that no item fits have no row.

    sessions: (exam_id, learner_id, p MAP by class, theta MAP by sector, covered ARRAY of sectors, tested ARRAY of
    classes, states MAP by class, used ARRAY of items, left MAP of slots by kind, by_sector MAP of coding items by
    sector, last_sector, sectors ARRAY of the plan, slots, and where present stable_since MAP by class);
    pool: (item_id, kind, difficulty, sector, exposure MAP by class, and where present name).

    An exam without used items opens with an easy coding item of the sector in which such an item gives the most bits.
    Later ones take the best score under the plan: slots left of the kind, coding items of the sector, not the last
    sector, and the other sectors still within reach. The score is bits for the cost, a bonus for a sector not yet
    covered, nearness of the pass rate to its target, and the exposure of stable classes that were not tested again.
    Ties go by hash, between scores and between bits that agree in nine digits.

    Sessions meet the different kinds of items of the sectors that are open to them, in tiles; items come in only for
    the kinds that are best, so that nothing is joined by class.
    """
    of, tiles = _alike(pool)
    used = sessions.select("exam_id", F.explode(F.array_distinct("used")).alias("item_id")).join(of.select("item_id", "alike"), "item_id")
    used = used.groupBy("exam_id", "alike").agg(F.count(F.lit(1)).alias("n")).groupBy("exam_id").agg(F.map_from_entries(F.collect_list(F.struct("alike", "n"))).alias("used_of"))
    since = F.col("stable_since") if "stable_since" in sessions.columns else F.lit(None).cast("map<string,string>")
    at = sessions.join(used, "exam_id", "left").withColumn("stable_since", since).withColumn("opening", F.size("used") == 0)
    at = at.withColumn("sector", F.explode(F.array_distinct("sectors")))
    after = F.aggregate(F.map_values("left"), F.lit(0).cast("long"), lambda a, x: a + x) - 1
    uncovered = F.size(F.array_except("sectors", F.array_append("covered", F.col("sector"))))
    fits = ~F.col("sector").eqNullSafe(F.col("last_sector")) & ((F.col("slots") < F.size("sectors")) | (uncovered <= after))
    at = at.filter(F.col("opening") | fits)
    at = at.withColumn("coding", F.coalesce(F.element_at("by_sector", F.col("sector")), F.lit(0)) < per_sector)
    n = tiles.groupBy("sector").agg(F.first("tiles").alias("tiles"))
    at = at.join(broadcast_if_small(n), "sector").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).drop("tiles")
    met = at.join(broadcast_if_small(tiles.drop("tiles")), ["sector", "tile"])

    stable = lambda c: (c["exposure"] > 0) & F.coalesce(F.element_at("states", c["class"]) == "STABLE", F.lit(False)) & ~F.array_contains("tested", c["class"])
    theta = F.coalesce(F.element_at("theta", F.col("sector")), F.lit(float(C.ELO_START)))
    bonus = F.when(F.array_contains("covered", F.col("sector")), 0.0).otherwise(C.EXAM_W_COVERAGE)

    def open_to(x):
        free = x["n_items"] > F.coalesce(F.element_at("used_of", x["alike"]), F.lit(0))
        slot = F.coalesce(F.element_at("left", x["kind"]), F.lit(0)) > 0
        first = (x["kind"] == "coding") & (x["difficulty"] == 1)
        return F.when(F.col("opening"), first).otherwise(free & slot & ((x["kind"] != "coding") | F.col("coding")))

    def scored(x):
        bits = F.greatest(F.aggregate(x["cells"], F.lit(0.0), lambda a, c: a + _bits(c, F.col("p"))), F.lit(0.0))
        ghost = F.aggregate(x["cells"], F.lit(0.0), lambda a, c: a + F.when(stable(c), c["exposure"]).otherwise(0.0))
        rest = bonus - C.EXAM_W_DIFFICULTY * F.abs(pass_probability(x["difficulty"], theta) - C.EXAM_TARGET_PASS) + C.EXAM_W_GHOST * ghost
        cost = F.when(x["kind"] == "coding", C.EXAM_COST["coding"]).otherwise(C.EXAM_COST["trace"])
        return let(bits, lambda b: F.struct((b / cost + rest).alias("score"), b.alias("eig"), x["alike"].alias("alike")))

    met = met.withColumn("gains", F.transform(F.filter("kinds", open_to), scored)).filter(F.size("gains") > 0).drop("kinds")
    # of a tile only its best kinds go on
    met = met.withColumn("score", F.array_max(F.transform("gains", lambda g: F.round(g["score"], 9)))).withColumn("bits", F.array_max(F.transform("gains", lambda g: F.round(g["eig"], 9))))
    met = met.select("exam_id", "learner_id", "opening", "sector", "score", "bits", F.filter("gains", lambda g: F.round(g["score"], 9) == F.col("score")).alias("gains"))
    reverse = lambda *c: F.translate(tie_key(*[F.col(x).cast("string") for x in c]), "0123456789abcdef", "fedcba9876543210")
    by = W.partitionBy("exam_id")
    first = F.max(F.when(F.col("opening"), F.struct("bits", reverse("learner_id", "exam_id", "sector").alias("k"), "sector"))).over(by)["sector"]
    met = met.withColumn("first", first).filter(~F.col("opening") | (F.col("sector") == F.col("first")))
    met = met.withColumn("top", F.max("score").over(by)).filter(F.col("score") == F.col("top"))
    best = met.select("exam_id", "learner_id", F.inline("gains"))
    # of a chunk of a kind's items the first unused one by hash goes on
    chunks = chunked(of, "alike", size=CHUNK)
    ids = dict(chunks.dtypes)["ids"]
    free = F.array_except("ids", F.coalesce(F.col("used").cast(ids), F.array().cast(ids)))
    key = lambda i: tie_key(F.col("learner_id").cast("string"), F.col("exam_id").cast("string"), i.cast("string"))
    tied = best.join(sessions.select("exam_id", "used"), "exam_id").join(broadcast_if_small(chunks.select("alike", "ids")), "alike")
    tied = tied.select("exam_id", "score", "eig", F.array_min(F.transform(free, lambda i: F.struct(key(i).alias("key"), i.alias("item_id")))).alias("f")).filter("f is not null")
    picked = tied.groupBy("exam_id").agg(F.min(F.struct("f.key", "f.item_id", "score", "eig")).alias("b")).select("exam_id", "b.item_id", "b.score", "b.eig")
    picked = picked.join(of.select("item_id", "sector", "kind", "name", "cells"), "item_id")
    rows = picked.join(sessions.withColumn("stable_since", since).select("exam_id", "p", "covered", "tested", "states", "stable_since"), "exam_id")
    return rows.select("exam_id", "item_id", "sector", "score", "eig", _reason(stable, names or {}, sectors or {}).alias("reason"))


def _reason(stable, names: dict, sectors: dict) -> Column:
    """Why an item: its two classes of the most bits, those to be checked again marked, then what else speaks for it."""
    named = lambda key, table: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), key) if table else key
    counted = F.filter("cells", lambda c: c["class"].isin(C.MISCONCEPTIONS) & (c["exposure"] >= C.EXAM_MIN_EXPOSURE))
    ranked = F.slice(F.array_sort(F.transform(counted, lambda c: F.struct((-F.round(_bits(c, F.col("p")), 9)).alias("k"), c["class"].alias("class"), stable(c).alias("stable")))), 1, 2)

    def label(r):
        since = F.element_at("stable_since", r["class"])
        again = F.when(since.isNull() | (since == ""), " (stable \u2192 recheck)").otherwise(F.concat(F.lit(" (stable since "), since, F.lit(" \u2192 recheck)")))
        return F.concat(named(r["class"], names), F.when(r["stable"], again).otherwise(""))

    said = F.transform(ranked, label)
    about = F.when(F.size(said) == 0, "no class above the exposure floor").otherwise(F.array_join(said, " and "))
    covers = F.when(~F.array_contains("covered", F.col("sector")), F.concat(F.lit("covers "), named(F.col("sector"), sectors)))
    other = F.when(F.exists("cells", stable) & ~F.exists(ranked, lambda r: r["stable"]), "rechecks a stable misconception")
    why = F.concat_ws("; ", covers, other)
    head = F.when((F.col("kind") == "coding") & (F.coalesce("name", F.lit("")) != ""), F.concat_ws(" ", F.col("item_id").cast("string"), "name")).otherwise(F.col("item_id").cast("string"))
    return F.concat(head, F.lit(" \u2014 most informative about "), about, F.lit("; "), F.when(why == "", "highest information per minute").otherwise(why), F.lit("."))


def opening(gains: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of each session the easiest items' sector with the most bits, then the best item of it; by the kinds of score_kinds."""
    easy = gains.filter("difficulty = 1 and sector is not null")
    sector = F.max(F.struct(F.round("eig", 9).alias("eig"), "sector")).over(W.partitionBy("exam_id"))["sector"]
    return recommend_exam_item(easy.withColumn("first", sector).filter(F.col("sector") == F.col("first")).drop("first"), chunks)


def first_items(gains: DataFrame, chunks: DataFrame, k: int = C.DEFERRED_PROBES) -> DataFrame:
    """(exam_id, item_id, score, eig) of the first k items of each kind: enough to choose k of all by score or eig and item."""
    ids = chunks.filter("chunk = 0").select("alike", F.slice("ids", 1, k).alias("ids"))
    return gains.join(broadcast_if_small(ids), "alike").select("exam_id", F.explode("ids").alias("item_id"), "score", "eig")


def starting_p(rows: DataFrame) -> DataFrame:
    """Adds p0, what an exam starts from: the given P, else the D-classes' exam prior while UNSEEN, else the population's.

    rows: (class, p_active, state), p_active null where nothing is known.
    """
    unseen = F.col("class").isin(C.DSA_CLASSES) & (F.coalesce("state", F.lit("UNSEEN")) == "UNSEEN")
    return rows.withColumn("p0", F.coalesce(F.col("p_active"), F.when(unseen, C.EXAM_DSA_PRIOR).otherwise(C.POPULATION_PRIOR)))


def findings(state: DataFrame) -> DataFrame:
    """(exam_id, class, status, twin): NOT_TESTED, RELAPSED, HELD, NEW or UNCERTAIN; classes without a finding are left out.

    state: (exam_id, class, tested, ambiguous, state0, state, p0, p). ambiguous is the twin set that the answers left
    open, or null. An uncertain class without one gets the first twin set with another uncertain member.
    """
    was_new = (F.col("state0") == "UNSEEN") | (F.col("p0") <= C.BAND_LOW)
    status = (
        F.when(~F.col("tested") & F.col("ambiguous").isNull(), "NOT_TESTED")
        .when(F.col("state") == "RELAPSED", "RELAPSED")
        .when(F.col("state") == "MASTERED", "HELD")
        .when(was_new & (F.col("p") >= C.ACTIVE_P), "NEW")
        .when(F.col("ambiguous").isNotNull() | F.col("p").between(C.BAND_LOW, C.BAND_HIGH), "UNCERTAIN")
    )
    rows = state.withColumn("status", status).filter("status is not null")
    open_ = F.collect_set(F.when(F.col("status") == "UNCERTAIN", F.col("class"))).over(W.partitionBy("exam_id"))  # 17 at most
    rows = rows.withColumn("open", open_)
    partner = F.coalesce(*[F.when(((F.col("class") == x) & F.array_contains("open", y)) | ((F.col("class") == y) & F.array_contains("open", x)), k) for k, (x, y) in C.TWIN_SETS.items()])
    return rows.select("exam_id", "class", "status", F.coalesce("ambiguous", F.when(F.col("status") == "UNCERTAIN", partner)).alias("twin"))


def recommendations(found: DataFrame, problems: DataFrame, used: DataFrame, n: int = C.RECOMMENDATIONS) -> DataFrame:
    """(exam_id, class, problem_id, rank): the first unused problems of a finding's transfer families."""
    from ..functions.constants import TRANSFER_FAMILIES

    fam = F.map_from_arrays(F.lit(list(TRANSFER_FAMILIES)), F.array(*[F.lit(v) for v in TRANSFER_FAMILIES.values()]))
    rows = found.filter("status in ('NEW', 'RELAPSED')").withColumn("family", F.explode(fam[F.col("class")]))
    rows = rows.join(problems.select("problem_id", "family"), "family").join(used, ["exam_id", "problem_id"], "left_anti").select("exam_id", "class", "problem_id").distinct()
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("exam_id", "class").orderBy("problem_id"))).filter(F.col("rank") <= n)


def deferred_probes(eig: DataFrame, k: int = C.DEFERRED_PROBES) -> DataFrame:
    """(exam_id, item_id, rank): up to k probes worth asking later."""
    rank = F.row_number().over(W.partitionBy("exam_id").orderBy(F.desc(F.round("eig_bits", 9)), "item_id"))
    return eig.filter(F.col("eig_bits") >= C.EIG_MIN_BITS).withColumn("rank", rank).filter(F.col("rank") <= k).select("exam_id", "item_id", "eig_bits", "rank")


def knowledge_simplex(knowledge: DataFrame, by=("exam_id",)) -> DataFrame:
    """(by…, label, p): P of each class, floored, as shares; CORRECT and OTHER at the floor. knowledge: (by…, class, p)."""
    each = labels(knowledge.select(*by).distinct())
    rows = each.join(knowledge.select(*by, F.col("class").alias("label"), F.col("p").alias("__k")), [*by, "label"], "left")
    raw = F.when(F.col("label").isin(C.MISCONCEPTIONS), F.greatest(F.coalesce("__k", F.lit(C.POPULATION_PRIOR)), F.lit(C.PRIOR_FLOOR))).otherwise(C.PRIOR_FLOOR)
    return normalise(rows, by, raw).select(*by, "label", "p")


def probes_for_uncertain(found: DataFrame, knowledge: DataFrame, probes: DataFrame, k: int = C.DEFERRED_PROBES) -> DataFrame:
    """(exam_id, item_id, eig_bits, rank, for_class): up to k probes about an exam's UNCERTAIN findings, on the simplex of its knowledge.

    for_class: of the uncertain classes that the probe tells about the one with the highest P (ties by class).
    """
    open_ = found.filter("status = 'UNCERTAIN'").select("exam_id", "class")
    beliefs = broadcast_if_small(probes.select("item_id", F.explode(F.map_keys("belief")).alias("class")).distinct())
    about = open_.join(beliefs, "class").join(knowledge.select("exam_id", "class", "p"), ["exam_id", "class"], "left")
    best = F.min_by("class", F.struct(-F.coalesce("p", F.lit(0.0)), "class"))
    asks = about.groupBy("exam_id", "item_id").agg(best.alias("for_class"))
    simplex = knowledge_simplex(knowledge.join(open_.select("exam_id").distinct(), "exam_id", "left_semi"))
    bits = item_eig(simplex, asks.select("exam_id", "item_id"), likelihood_table(probes), ("exam_id",))
    return deferred_probes(bits, k).join(asks, ["exam_id", "item_id"])


def adaptivity_log(administered: DataFrame) -> DataFrame:
    """(exam_id, log): an exam's items in order, each with sector, bits, reason and outcome. administered: (exam_id, seq, item_id, sector, eig_bits, reason, outcome)."""
    e = F.struct("seq", "item_id", "sector", F.round("eig_bits", 6).alias("eig_bits"), "reason", "outcome")
    log = F.transform(F.array_sort(F.collect_list(e)), lambda x, i: F.struct((i + 1).alias("order"), x["item_id"].alias("item_id"), x["sector"].alias("sector"), x["eig_bits"].alias("eig_bits"), x["reason"].alias("reason"), x["outcome"].alias("outcome")))
    return administered.groupBy("exam_id").agg(log.alias("log"))


def sector_rollup(log: DataFrame) -> DataFrame:
    """(exam_id, sector, items, passed, first, last): items in order, and the ratings before and after."""
    t = log.groupBy("exam_id", "sector").agg(F.array_sort(F.collect_list(F.struct("seq", "item_id"))).alias("l"), F.sum(F.col("passed").cast("long")).alias("passed"), F.min_by("theta", "seq").alias("first"), F.max_by("theta", "seq").alias("last"))
    return t.select("exam_id", "sector", F.array_join(F.transform("l", lambda x: x["item_id"].cast("string")), ",").alias("items"), "passed", "first", "last")


def exam_report(rollup: DataFrame, found: DataFrame) -> DataFrame:
    """One nested row for each exam."""
    s = rollup.groupBy("exam_id").agg(F.array_sort(F.collect_list(F.struct("sector", "items", "passed", "first", "last"))).alias("sectors"))
    f = found.groupBy("exam_id").agg(F.array_sort(F.collect_list(F.struct("class", "status", "twin"))).alias("findings"))
    return s.join(f, "exam_id", "left")


def trial_sectors(log: DataFrame) -> DataFrame:
    """(exam_id, sector, items, passed, rating_before, rating_after) of the sectors that were attempted.

    log: (exam_id, seq, sector, item_id, outcome pass, fail or skip). From 1400: +40 for a pass, -30 for a failure, -20
    for a skip; a loss does not go below 1100.
    """
    past = log.groupBy("exam_id", "sector").agg(F.array_sort(F.collect_list(F.struct("seq", "item_id", "outcome"))).alias("h"), F.count_if(F.col("outcome") == "pass").alias("passed"))
    step = lambda s, e: F.when(e["outcome"] == "pass", s + C.TRIAL_PASS).otherwise(F.greatest(F.lit(C.TRIAL_FLOOR), s - F.when(e["outcome"] == "skip", C.TRIAL_SKIP).otherwise(C.TRIAL_FAIL)))
    return past.select("exam_id", "sector", F.transform("h", lambda e: e["item_id"]).alias("items"), "passed", F.lit(C.TRIAL_START).alias("rating_before"), F.aggregate("h", F.lit(C.TRIAL_START), step).alias("rating_after"))


def trial_findings(log: DataFrame) -> DataFrame:
    """(exam_id, class, status, p_active, item_id, sector): the first finding of each class.

    log as in trial_sectors, and top, top_p (the diagnosis) and asked (the class that the item's question tests, M01 if
    null). A skipped item leaves that class UNRESOLVED; a diagnosed class is ACTIVE even if the code passed; a failure
    that nothing explains counts for the class asked about.
    """
    asked = F.coalesce("asked", F.lit("M01"))
    plain = F.col("top").isin("CORRECT", "OTHER")
    skipped = F.col("outcome") == "skip"
    found = F.when(skipped, asked).when(plain & (F.col("outcome") == "fail"), asked).when(~plain, F.col("top"))
    rows = log.withColumn("class", found).filter("class is not null")
    one = F.struct(F.when(skipped, "UNRESOLVED").otherwise("ACTIVE").alias("status"), F.when(skipped, C.UNRESOLVED_P).otherwise(F.col("top_p")).alias("p_active"), "item_id", "sector")
    return rows.groupBy("exam_id", "class").agg(F.min_by(one, "seq").alias("f")).select("exam_id", "class", "f.*")


def trial_debrief(log: DataFrame) -> DataFrame:
    """(exam_id, items_total, items_passed, score_pct, sectors, findings, review): one nested row for each exam.

    review: the sectors that nothing was passed in or that a finding comes from.
    """
    total = log.groupBy("exam_id").agg(F.count(F.lit(1)).alias("items_total"), F.count_if(F.col("outcome") == "pass").alias("items_passed"))
    sectors, found = trial_sectors(log), trial_findings(log)
    s = sectors.groupBy("exam_id").agg(F.array_sort(F.collect_list(F.struct("sector", "items", "passed", "rating_before", "rating_after"))).alias("sectors"))
    f = found.groupBy("exam_id").agg(F.array_sort(F.collect_list(F.struct("class", "status", "p_active", "item_id", "sector"))).alias("findings"))
    out = total.join(s, "exam_id").join(f, "exam_id", "left").withColumn("findings", F.coalesce("findings", F.array().cast(f.schema["findings"].dataType)))
    weak = F.filter("sectors", lambda x: (x["passed"] == 0) | F.exists("findings", lambda y: y["sector"] == x["sector"]))
    return out.select("exam_id", "items_total", "items_passed", F.bround(100 * F.col("items_passed") / F.col("items_total")).cast("int").alias("score_pct"), "sectors", "findings", F.transform(weak, lambda x: x["sector"]).alias("review"))


def attach_remediation(found: DataFrame, guide: DataFrame, default: str = "REVIEW") -> DataFrame:
    """(exam_id, class, advice): the first finding of each class with its guide row, or the default; MASTERY for exams without."""
    hit = found.filter("status in ('NEW', 'RELAPSED')")
    rows = hit.select("exam_id", "class").distinct().join(broadcast_if_small(guide), "class", "left").select("exam_id", "class", F.coalesce("advice", F.lit(default)).alias("advice"))
    none = found.select("exam_id").distinct().join(hit.select("exam_id").distinct(), "exam_id", "left_anti")
    return rows.unionByName(none.select("exam_id", F.lit(None).cast("string").alias("class"), F.lit("MASTERY").alias("advice")))


def changed_classes(log: DataFrame) -> DataFrame:
    """(exam_id, seq, class) where the evidence of a class grew."""
    before = F.coalesce(F.lag("evidence").over(W.partitionBy("exam_id", "class").orderBy("seq")), F.lit(0))
    return log.withColumn("before", before).filter("evidence > before").select("exam_id", "seq", "class")
