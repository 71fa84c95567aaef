"""Sharding by balanced label propagation over equal texts.

Documents are nodes, each with a label, the shard it stands for. Equal texts are linked by an edge table: the documents
of a group, or of a part of a group too large for one shard, are linked to one of them, its hub, and hubs of one group
to each other, so no group gives all its pairs. A link between two labels is a cut.

Each round joins the edges to the labels. Hubs that aren't settled see their neighbours' labels and take the one that
holds most bytes, if its shard's quota lets in the whole star; shards admit stars by running sums, large ones first.
Documents then take the label of their hub, and the cuts are counted: they fall from round to round. Once nothing moves,
stars that fit nowhere are taken apart into smaller ones. Documents without links, and copies that still fit nowhere,
then fill the shards up to equal bytes, large ones first and the smallest last.

Edge cases: a null text has size 8 and equals an empty one. Null and repeated doc_ids are rows like others. Fewer
rows than shards leave shards empty. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.scratch import running_total, written

SHARDS = 24
OVERHEAD = 8
#: A group is split into parts of at most about the first share of a shard; parts that fit nowhere are split again.
GROUP_SHARES = (0.25, 0.05, 0.01)
#: Documents above each share of a shard are placed before smaller ones.
FILL_SHARES = (0.02, 0.002, 0.0)
#: Rows of a block in which running sums are ordered; the number of blocks grows with the rows.
_BLOCK_ROWS = 1 << 17


def _blocks(rows: int) -> int:
    return 64 + rows // _BLOCK_ROWS


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, a key of equal texts, and a number of the row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("text_key"), F.monotonically_increasing_id().alias("row"))


def edges_of(linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (src, dst) of linked rows (row, doc_id, text_key, unit, size): from each to its unit's hub, and from hubs to
    the first of their group; and the stars (unit, hub, bytes)."""
    first = F.min(F.struct(F.xxhash64("doc_id", "text_key").alias("_h"), "row"))["row"]
    hubs = written(linked.groupBy("text_key", "unit").agg(first.alias("hub"), F.sum("size").alias("bytes")), "hubs")
    tops = hubs.groupBy("text_key").agg(F.min(F.struct(F.xxhash64("unit").alias("_h"), "hub"))["hub"].alias("top"), F.count("*").alias("_n")).where("_n > 1")
    between = hubs.join(tops, "text_key").where("hub <> top").select(F.col("hub").alias("src"), F.col("top").alias("dst"))
    stars = linked.join(hubs.select(F.col("unit").alias("_u"), "hub"), F.col("unit") == F.col("_u")).where("row <> hub").select(F.col("row").alias("src"), F.col("hub").alias("dst"))
    return written(stars.unionByName(between), "edges"), hubs.select("unit", "hub", "bytes")


def count_cuts(edges: DataFrame, labels: DataFrame) -> int:
    """Links whose ends have different labels."""
    one = labels.select(F.col("row").alias("_a"), F.col("label").alias("_la"))
    other = labels.select(F.col("row").alias("_b"), F.col("label").alias("_lb"))
    ends = edges.join(one, F.col("src") == F.col("_a")).join(other, F.col("dst") == F.col("_b"))
    return ends.where("_la <> _lb").count()


def propagate(linked: DataFrame, edges: DataFrame, stars: DataFrame, room: list[float], loads: dict[int, float], cuts: list[int] | None = None) -> DataFrame:
    """shard of linked rows (row, doc_id, size, unit, ...), null for those whose star fits no quota; room and loads follow.

    What leaves each round for the driver is at most one row a shard, and the number of cuts, which cuts takes.
    """
    n_shards = len(room)
    labels = written(linked.select("row", "unit", "size", F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int").alias("label"), F.lit(False).alias("settled")), "labels")
    waiting = stars
    n_blocks = _blocks(labels.count())
    if cuts is not None:
        cuts.append(count_cuts(edges, labels))
    k = 0
    while True:
        free = F.array(*[F.lit(float(r)) for r in room])
        # A hub's own label counts with those of its neighbours; settled hubs of its group pull with all of their star.
        heavy = stars.select(F.col("hub").alias("_h"), F.col("bytes").alias("_star"))
        pulls = labels.join(heavy, F.col("row") == F.col("_h"), "left").select(F.col("row").alias("_r"), "label", F.when(F.col("settled"), F.coalesce("_star", "size")).otherwise(F.col("size")).alias("pull"))
        near = edges.select(F.col("dst").alias("_w"), F.col("src").alias("_o")).unionByName(edges.select(F.col("src").alias("_w"), F.col("dst").alias("_o"))).unionByName(waiting.select(F.col("hub").alias("_w"), F.col("hub").alias("_o")))
        seen = near.join(waiting.select("hub", "unit"), F.col("hub") == F.col("_w")).join(pulls, F.col("_o") == F.col("_r"))
        votes = seen.groupBy("unit", "label").agg(F.sum("pull").alias("_mass"))
        # Equal masses: a hash decides, so that ties don't all go to one shard.
        held = F.struct(F.col("_mass"), F.xxhash64("unit", "label").alias("_tie"), F.col("label"))
        wants = waiting.join(votes.groupBy("unit").agg(F.collect_list(held).alias("labels")), "unit", "left")
        fits = lambda x: F.element_at(free, x["label"] + 1) >= F.col("bytes")
        own = F.array_max(F.filter("labels", fits))["label"]
        others = F.filter(F.array(*[F.struct(F.xxhash64("unit", F.lit(s), F.lit(k)).alias("_tie"), F.lit(s).alias("label")) for s in range(n_shards)]), fits)
        wants = wants.withColumn("_to", F.coalesce(own, F.array_max(others)["label"])).drop("labels").where("_to is not null")
        grade = F.floor(F.log2("bytes") * 8).cast("long")
        wants = wants.withColumn("_block", F.pmod(F.xxhash64("unit"), F.lit(n_blocks)) - grade * n_blocks)
        wants = running_total(wants, ["_to"], "_block", [F.xxhash64("unit", F.lit(k)), F.col("unit")], F.col("bytes"), "_sum").drop("_block")
        wants = written(wants.withColumn("_in", F.col("_sum") + F.col("bytes") <= F.element_at(free, F.col("_to") + 1)).drop("_sum"), "wants")
        moved = wants.where("_in").groupBy("_to").agg(F.sum("bytes")).collect()
        if not moved:
            break
        for s, n in moved:
            room[s] -= n
            loads[s] = loads.get(s, 0) + n
        # Documents take the label of the hub that their edge leads to.
        came = wants.where("_in").select(F.col("hub").alias("_hub"), F.col("unit").alias("_u"), F.col("_to"))
        along = edges.join(came, F.col("dst") == F.col("_hub")).select(F.col("src").alias("_row"), "_u", "_to").unionByName(came.select(F.col("_hub").alias("_row"), "_u", "_to"))
        new = labels.join(along, (F.col("row") == F.col("_row")) & (F.col("unit") == F.col("_u")), "left")
        labels = written(new.select("row", "unit", "size", F.coalesce("_to", "label").alias("label"), (F.col("settled") | F.col("_to").isNotNull()).alias("settled")), "labels")
        if cuts is not None:
            cuts.append(count_cuts(edges, labels))
        # A star that fits nowhere now never will: rooms only shrink.
        waiting, k = wants.where("not _in").drop("_to", "_in"), k + 1
    shard = labels.select(F.col("row").alias("_row"), F.when(F.col("settled"), F.col("label")).alias("shard"))
    return linked.join(shard, F.col("row") == F.col("_row")).drop("_row")


def fill(rows: DataFrame, loads: dict[int, float], n_shards: int, capacity: float) -> DataFrame:
    """Give unlinked rows shards so that all loads come to capacity: large rows first, each level mends the one before."""
    out, above = [], None
    n_blocks = _blocks(rows.count())
    for share in FILL_SHARES:
        level = rows.where(F.col("size") > capacity * share)
        if above is not None:
            level = level.where(F.col("size") <= above)
        above = capacity * share
        total = level.agg(F.sum("size")).first()[0]
        if not total:
            continue
        room = [max(0.0, capacity - loads.get(s, 0)) for s in range(n_shards)]
        scale = total / sum(room) if sum(room) else 0.0
        ends, end = [], 0.0
        for r in room[:-1]:
            end += r * scale if scale else total / n_shards
            ends.append(end)
        grade = F.floor(F.log2("size") * 8).cast("long")
        level = level.withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)) - grade * n_blocks)
        level = running_total(level, [], "_block", [F.xxhash64("doc_id"), F.col("doc_id").asc_nulls_first(), F.col("text_key")], F.col("size"), "_sum")
        middle = F.col("_sum") + F.col("size") / 2
        level = level.withColumn("shard", F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= middle)).cast("int") if ends else F.lit(0))
        level = written(level.drop("_sum", "_block"), "filled")
        for s, n in level.groupBy("shard").agg(F.sum("size")).collect():
            loads[s] = loads.get(s, 0) + n
        out.append(level)
    done = rows.withColumn("shard", F.lit(0)).limit(0)
    for level in out:
        done = done.unionByName(level)
    return done


def assign(docs: DataFrame, n_shards: int = SHARDS, cuts: list[int] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard of every row. cuts takes the number of cut links before and after each round."""
    base = written(sized(docs), "sized")
    total = base.agg(F.sum("size")).first()[0] or 0
    capacity = total / n_shards
    groups = base.groupBy("text_key").agg(F.count("*").alias("_n"), F.sum("size").alias("_bytes"))
    # Groups are joined back as they are; AQE splits a group that holds much of a partition.
    linked_keys = written(groups.where("_n > 1").withColumnRenamed("text_key", "_key"), "groups")
    alone = written(base.join(linked_keys, F.col("text_key") == F.col("_key"), "left_anti"), "alone")
    loads: dict[int, float] = {}
    large = F.col("size") > capacity * FILL_SHARES[0]
    out = [fill(alone.where(large), loads, n_shards, capacity)]
    rest = base.join(linked_keys, F.col("text_key") == F.col("_key")).drop("_key", "_n")
    for share in GROUP_SHARES:
        parts = F.greatest(F.ceil(F.col("_bytes") / F.lit(max(1.0, capacity * share))), F.lit(1))
        rest = written(rest.withColumn("unit", F.xxhash64("text_key", F.pmod(F.xxhash64("doc_id"), parts))), "linked")
        if rest.isEmpty():
            break
        room = [max(0.0, capacity - loads.get(s, 0)) for s in range(n_shards)]
        edges, stars = edges_of(rest)
        rows = written(propagate(rest, edges, stars, room, loads, cuts), "placed").drop("unit")
        out.append(rows.where("shard is not null").drop("_bytes"))
        rest = rows.where("shard is null").drop("shard")
    out.append(fill(alone.where(~large).unionByName(rest.drop("_bytes", "unit")), loads, n_shards, capacity))
    done = out[0]
    for rows in out[1:]:
        done = done.unionByName(rows)
    return done.drop("text_key", "row")


def with_slots(rows: DataFrame) -> DataFrame:
    """slot: the row's place in its shard, counted over blocks of a hash."""
    n_blocks = _blocks(rows.count())
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)))
    return running_total(rows, ["shard"], "_block", [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], F.lit(1), "slot").drop("_block").withColumn("slot", F.col("slot").cast("long"))


def shard_digest(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """Sizes are kept near equal (law `bytes`)."""
    rows = with_slots(assign(docs, n_shards))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
