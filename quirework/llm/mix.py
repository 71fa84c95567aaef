"""Mixing sources to target weights by entropy balancing.

Of all rates that give each source its target tokens, those closest to the base rates in relative entropy are taken,
with a second, soft set of constraints: each group of languages keeps the tokens it had, as far as a ridge on its
multiplier allows. A document's rate is its base rate times exp(lambda of its source + mu of its languages), at most
`cap`. Sources and languages overlap, so their multipliers depend on each other: each Newton step on the convex dual
sums rates over distinct (source, languages, base rate) cells, eliminates the sources (their block of the Hessian is
diagonal) and solves the rest, one row a group of languages. A last solve by source makes the targets exact whatever
the languages want. Rates are then rounded into whole copies so that running sums follow their targets from the
largest documents to the smallest.

Edge cases: a null text has size 0 and is never taken. A null source is a source of its own, the last; null languages
are a language of their own. Rows with equal doc_ids are mixed as separate rows. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.llm.scratch import if_small, running_total, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3.0
TOLERANCE = 1e-9
MAX_STEPS = 60
#: A source whose rounded sum misses its target by more than this share is mended with small documents.
MEND = 0.002
MEND_ROUNDS = 3
#: Languages are constrained in so many groups of a hash; RIDGE is the share of all tokens that a group may miss at mu = 1.
LANGUAGE_GROUPS = 64
RIDGE = 0.05
MOST_MU = 3.0
BALANCE_STEPS, BALANCE_TOLERANCE = 10, 1e-4
#: Rows of one source and size that a task orders at most, about.
_BLOCK_ROWS = 1 << 18


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _set_hash(*columns: Column) -> Column:
    """A hash of values that tells nulls from others."""
    return F.xxhash64(*[part for c in columns for part in (c.isNull(), c)])


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, group (of languages), size in words and a key of what makes rows differ for the mix."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    doc_id = F.col("doc_id").cast("long")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    group = F.pmod(_set_hash(lang), F.lit(LANGUAGE_GROUPS)).cast("int")
    return docs.select(doc_id.alias("doc_id"), source.alias("source"), group.alias("group"), size.alias("size"), row_key(docs).alias("key"))


def row_key(docs: DataFrame) -> Column:
    columns = [F.col(c).cast("string") for c in ("source", "lang", "text") if c in docs.columns]
    return _set_hash(F.col("doc_id").cast("long"), *columns)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, weight, target: one row a source.

    The targets are min(cap * size, weight * level) with the level that makes them add up; it is where the sources
    in order of cap * size / weight stop being full.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    full = rows.withColumn("_most", F.col("source_size") * F.lit(cap)).withColumn("_turn", F.col("_most") / F.col("weight"))
    by_turn = Window.orderBy("_turn", F.col("source").asc_nulls_last())
    upto = by_turn.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_turn.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("_most").over(upto), F.lit(0.0))) / F.sum("weight").over(rest)
    full = full.withColumn("_level", level)
    # The first source in this order that the level of the rest doesn't fill sets the level for all.
    level = F.min(F.when(F.col("_level") <= F.col("_turn"), F.struct("_turn", "_level"))).over(Window.partitionBy())["_level"]
    return full.select("source", "source_size", "weight", F.coalesce(F.least(F.col("_most"), F.col("weight") * level), F.col("_most")).alias("target"))


def _of_group(values: dict[int, float], group: Column) -> Column:
    """A group's value, 0 for others: an array over all groups."""
    return F.get(F.array(*[F.lit(values.get(g, 0.0)) for g in range(LANGUAGE_GROUPS)]), group)


def balance(cells: DataFrame, targets: DataFrame, cap: float = CAP) -> dict[int, float]:
    """mu by group of languages: joint Newton steps over cells (source, group, base, size) and the sources' targets.

    The driver holds one number a group and the groups' part of the Hessian; sources stay in tables.
    """
    held = {g: float(n) for g, n in cells.groupBy("group").agg(F.sum("size")).collect() if n}
    total = sum(held.values())
    if len(held) < 2:
        return {}
    groups = sorted(held)
    place = {g: k for k, g in enumerate(groups)}
    mu = np.zeros(len(groups))
    lam = targets.where("target > 0").select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.log(F.col("target") / F.col("source_size")).alias("lam"))
    lam = written(lam, "dual")
    for _ in range(BALANCE_STEPS):
        of_group = _of_group({g: float(mu[k]) for g, k in place.items()}, F.col("group"))
        tilted = F.col("base") * F.exp(F.col("lam") + of_group)
        rows = cells.join(lam, _same("source", "_s")).withColumn("rate", F.least(F.lit(cap), tilted) * F.col("size"))
        rows = rows.withColumn("free", F.when(tilted < cap, F.col("rate")).otherwise(0.0))
        by_cell = rows.groupBy("_s", "_t", "lam", "group").agg(F.sum("rate").alias("rate"), F.sum("free").alias("free"))
        sources = by_cell.groupBy("_s", "_t", "lam").agg(F.sum("rate").alias("g"), F.sum("free").alias("h"), F.collect_list(F.struct("group", "rate", "free")).alias("by_group"))
        # A source all of whose cells are full can't rise; a little curvature keeps its step finite.
        sources = written(sources.withColumn("gap", F.col("_t") - F.col("g")).withColumn("d", F.greatest("h", F.col("_t") * 1e-6)), "sources")
        # The groups' gradient and Hessian after the sources are eliminated: sums over pairs of a source's groups.
        one = sources.select(F.explode("by_group").alias("x"), "by_group", "gap", "d", (F.abs("gap") / F.col("_t")).alias("off"))
        first = one.groupBy(F.col("x.group").alias("i")).agg(F.sum("x.rate"), F.sum("x.free"), F.sum(F.col("x.free") * F.col("gap") / F.col("d")), F.max("off"))
        rate, free, shift = np.zeros(len(groups)), np.zeros(len(groups)), np.zeros(len(groups))
        far = 0.0
        for i, a, b, c, off in first.collect():
            rate[place[i]], free[place[i]], shift[place[i]], far = a, b, c, max(far, off)
        both = one.where("x.free > 0").select(F.col("x.group").alias("i"), F.col("x.free").alias("f"), "d", F.explode("by_group").alias("y"))
        hessian = np.diag(free + RIDGE * total)
        for i, j, v in both.where("y.free > 0").groupBy("i", F.col("y.group").alias("j")).agg(F.sum(F.col("f") * F.col("y.free") / F.col("d"))).collect():
            hessian[place[i], place[j]] -= v
        gap = np.array([held[g] for g in groups]) - rate - RIDGE * total * mu
        step = np.clip(np.linalg.solve(hessian, gap - shift), -0.5, 0.5)
        moved = np.clip(mu + step, -MOST_MU, MOST_MU)
        step, mu = moved - mu, moved
        steps = {g: float(step[k]) for g, k in place.items()}
        pull = F.aggregate("by_group", F.lit(0.0), lambda s, x: s + x["free"] * _of_group(steps, x["group"]))
        change = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("gap") - pull) / F.col("d")))
        if np.abs(step).max() <= BALANCE_TOLERANCE and far <= BALANCE_TOLERANCE:
            break
        lam = written(sources.select("_s", "_t", (F.col("lam") + F.when(F.col("h") > 0, change).otherwise(F.when(F.col("gap") < 0, -0.5).otherwise(0.0))).alias("lam")), "dual")
    return {g: float(mu[k]) for g, k in place.items()}


def solve(cells: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """source, lam: Newton steps on the dual over cells (source, base, size), until every source meets its target."""
    start = F.when(F.col("target") > 0, F.log(F.col("target") / F.col("source_size"))).otherwise(0.0)
    lam = written(targets.select(F.col("source").alias("_s"), F.col("target").alias("_t"), start.alias("lam"), F.lit(1.0).alias("off")), "dual")
    rate = F.least(F.lit(cap), F.col("base") * F.exp("lam"))
    for _ in range(MAX_STEPS):
        if not lam.agg(F.max("off")).first()[0] or lam.where(F.col("off") > TOLERANCE).isEmpty():
            break
        both = cells.join(lam, _same("source", "_s"))
        sums = both.groupBy("_s", "_t", "lam").agg(F.sum(F.col("size") * rate).alias("g"), F.sum(F.when(F.col("base") * F.exp("lam") < cap, F.col("size") * rate).otherwise(0.0)).alias("h"))
        gap = F.col("_t") - F.col("g")
        step = F.when(F.col("h") > 0, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), gap / F.col("h")))).otherwise(F.when(gap < 0, -0.5).otherwise(0.0))
        off = F.when((F.col("h") == 0) & (gap >= 0), 0.0).otherwise(F.abs(gap) / F.greatest(F.col("_t"), F.lit(1e-300)))
        done = (F.col("_t") <= 0) | (off <= TOLERANCE)
        lam = written(sums.select("_s", "_t", F.when(done, F.col("lam")).otherwise(F.col("lam") + step).alias("lam"), F.when(done, 0.0).otherwise(off).alias("off")), "dual")
    else:
        raise ArithmeticError(f"{lam.where(F.col('off') > TOLERANCE).count()} sources are off their targets after {MAX_STEPS} steps")
    return lam.select(F.col("_s").alias("source"), "lam")


def _by_size(rows: DataFrame, salts: int) -> DataFrame:
    """Blocks from large documents to small ones, salted so that no block holds a large part of a source."""
    grade = F.floor(F.log2(F.col("size") + 1.0) * 8).cast("long")
    return rows.withColumn("_block", F.pmod(F.xxhash64("key"), F.lit(salts)) - grade * salts)


def _order() -> list[Column]:
    return [F.col("size").desc(), F.xxhash64("key"), F.col("key")]


def copies(rated: DataFrame, salts: int) -> DataFrame:
    """Round rate into n_copies: floor or ceiling, such that running sums of copies follow those of rates."""
    near = F.round("rate", 9)
    rated = rated.withColumn("_whole", F.floor(near)).withColumn("_part", F.greatest(near - F.floor(near), F.lit(0.0)))
    # A fixed-point share keeps the running sums exact in any order of adding.
    rated = rated.withColumn("_part", F.round(F.col("_part") * (1 << 30)).cast("long"))
    rated = running_total(_by_size(rated, salts), ["source"], "_block", _order(), F.col("_part"), "_sum")
    half = 1 << 29
    extra = F.floor((F.col("_sum") + F.col("_part") + half) / (1 << 30)) - F.floor((F.col("_sum") + half) / (1 << 30))
    return rated.withColumn("n_copies", (F.col("_whole") + extra).cast("long")).drop("_sum", "_block")


def mend(rows: DataFrame, salts: int) -> DataFrame:
    """Add or take back single copies where a source's sum misses its target, largest fitting documents first."""
    for _ in range(MEND_ROUNDS):
        gaps = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("n_copies") * F.col("size"))).alias("_gap"), F.first("target").alias("_goal"))
        gaps = written(gaps.where(F.abs("_gap") > F.col("_goal") * MEND).select(F.col("source").alias("_s"), "_gap"), "gaps")
        if gaps.isEmpty():
            break
        same = F.col("source").eqNullSafe(F.col("_s"))
        up = F.col("_gap") > 0
        fits = (F.col("_part") > 0) & (F.col("size") > 0) & (F.col("size") <= F.abs("_gap")) & F.when(up, F.col("n_copies") == F.col("_whole")).otherwise(F.col("n_copies") > F.col("_whole"))
        joined = rows.join(F.broadcast(gaps) if gaps.count() <= 100_000 else gaps, same, "left").withColumn("_fits", F.coalesce(fits, F.lit(False)))
        some = running_total(_by_size(joined.where("_fits"), salts), ["source"], "_block", _order(), F.col("size"), "_sum").drop("_block")
        take = F.col("_sum") + F.col("size") <= F.abs("_gap")
        some = some.withColumn("n_copies", F.col("n_copies") + F.when(take, F.when(up, 1).otherwise(-1)).otherwise(0)).drop("_sum")
        rows = written(some.unionByName(joined.where("not _fits")).drop("_s", "_gap", "_fits"), "mended")
    return rows


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, key, source_size, target, rate, n_copies of rows (doc_id, source, group, size, key[, base])."""
    if "base" not in sized.columns:
        sized = sized.withColumn("base", F.lit(1.0))
    sized = written(sized, "sized")
    salts = 64 + sized.count() // _BLOCK_ROWS
    targets = written(source_targets(sized, weights, cap), "targets")
    cells = written(sized.groupBy("source", "group", "base").agg(F.sum("size").cast("double").alias("size")), "cells")
    mu = balance(cells, targets, cap)
    tilt = F.col("base") * F.exp(_of_group(mu, F.col("group")))
    lam = solve(cells.withColumn("base", tilt), targets, cap).join(targets.select(F.col("source").alias("_s"), "source_size", "target"), _same("source", "_s")).select("_s", "source_size", "target", "lam")
    lam = written(lam, "rates")
    few = F.broadcast(lam) if lam.count() <= 100_000 else lam
    rated = sized.join(few, _same("source", "_s")).drop("_s")
    rated = rated.withColumn("rate", F.when(F.col("target") > 0, F.least(F.lit(cap), tilt * F.exp("lam"))).otherwise(0.0)).drop("lam", "base", "group")
    return mend(written(copies(rated, salts), "copies"), salts).drop("_whole", "_part")


def taken(size: str = "size", n: str = "n_copies") -> Column:
    return (F.col(size) * F.col(n)).cast("long")


def mix_digest(docs: DataFrame) -> DataFrame:
    return mix(sizes(docs)).select("doc_id", "size", "source_size", "target", taken().alias("taken"))


BROADCAST_ROWS = 1_000_000


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns."""
    plan = mix(sizes(docs)).groupBy(F.col("key").alias("_k")).agg(F.sum("n_copies").alias("_n"), F.count("*").alias("_rows")).where("_n > 0")
    plan = written(plan, "plan")
    # The input's columns travel as one, so that their names can't clash with the plan's.
    rows = docs.select(F.struct("*").alias("_row"), row_key(docs).alias("_key")).join(if_small(plan, BROADCAST_ROWS), F.col("_key") == F.col("_k"))
    out = rows.where("_rows = 1").select("_row", "_n")
    if not plan.where("_rows > 1").isEmpty():
        # Rows that the mix can't tell apart share their copies: the first ones get those that are left over.
        alike = rows.where("_rows > 1").select("_row", "_k", "_n", "_rows", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
        alike = running_total(written(alike, "alike"), ["_k"], "_part", [F.col("_at")], F.lit(1), "_place")
        share = F.floor(F.col("_n") / F.col("_rows")) + F.when(F.col("_place") < F.col("_n") % F.col("_rows"), 1).otherwise(0)
        out = out.unionByName(alike.select("_row", share.alias("_n")).where("_n > 0"))
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy")).select("_row.*")
