"""Sharding by a k-d tree over metadata.

A node is cut at the weighted (by bytes) median along its widest dimension, level by level, until leaves reach
the target bytes. Medians are found for all nodes of a level together, by histograms that narrow down to one key. A
key is the dimension's grid step, then the text's hash: equal texts share it, so a group of copies stays whole, unless
keeping it whole would leave the halves uneven along every dimension. Nodes, histograms and cuts are tables; the driver
holds a few numbers of a level. DataFrame functions only; texts are read once, and rows of a few numbers are all that
moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm.common import parts, table, written

#: Grid steps of a dimension (bits); rows of a level's histograms, about; bytes by which a cut may miss, as a share of a
#: leaf; rows in a numbering range, about.
GRID_BITS, HISTOGRAM_ROWS, SLACK, RANGE_ROWS = 20, 1 << 18, 0.01, 4096
HASH_BITS = 62 - GRID_BITS


def text_dimensions() -> list[Column]:
    """What a text says about itself: its bytes, bytes per character, characters per line."""
    size, chars = F.octet_length("text"), F.length("text")
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return [F.log2(size + F.lit(1.0)), (size + 1) / (chars + 1), F.log2(F.lit(1.0) + chars / lines)]


def _search(rows: DataFrame, goals: DataFrame, count: int) -> DataFrame:
    """rows: node, dim, key, size. goals: node, dim, goal; about count of them. node, dim, key, before, own: for every
    goal the key at which the running sum of sizes, in key order, passes it (the last key, if none does), the sum
    before it and its own sum."""
    bins = max(16, min(1024, HISTOGRAM_ROWS // max(1, count)))
    state = goals.select("node", "dim", "goal", F.lit(0).cast("long").alias("lo"), F.lit((1 << 63) - 1).alias("hi"), F.lit(0.0).alias("before"))
    here, found = Window.partitionBy("node", "dim").orderBy("bin"), None
    while True:
        step = F.floor(F.col("hi") / bins - F.col("lo") / bins).cast("long") + 1
        seen = rows.join(state.withColumn("step", step), ["node", "dim"]).where("key BETWEEN lo AND hi")
        seen = seen.groupBy("node", "dim", "goal", "before", F.expr("(key - lo) DIV step").alias("bin")).agg(F.sum("size").alias("own"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        seen = seen.withColumn("upto", F.col("before") + F.sum("own").over(here)).withColumn("last", F.lead("bin").over(here).isNull())
        first = seen.where("upto >= goal OR last").groupBy("node", "dim").agg(F.min(F.struct("bin", "goal", "lo", "hi", "upto", "own")).alias("s"))
        now = written(first.select("node", "dim", "s.goal", "s.lo", "s.hi", (F.col("s.upto") - F.col("s.own")).alias("before"), F.col("s.own").cast("double").alias("own")), "narrowed")
        ready = now.where("lo = hi").select("node", "dim", F.col("lo").alias("key"), "before", "own")
        found = ready if found is None else found.unionByName(ready)
        state = now.where("lo < hi").drop("own")
        if state.isEmpty():
            return found


def keyed(docs: DataFrame, dims: list[Column] | None = None) -> tuple[DataFrame, list[str]]:
    """rid, doc_id, size, text_crc32 and a key for each dimension, a row per row of docs; the keys' names. rid numbers
    the rows; a key orders by the dimension's grid step (upper bits), then by the text's hash."""
    dims = dims or text_dimensions()
    d = docs.withColumn("text", F.coalesce("text", F.lit("")))
    light = d.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"),
        F.xxhash64("text").alias("th"), *(F.coalesce(x.cast("double"), F.lit(0.0)).alias(f"x{k}") for k, x in enumerate(dims)),
    )
    light = written(light, "rows")
    ends = light.agg(*(f(f"x{k}") for k in range(len(dims)) for f in (F.min, F.max))).first()
    low = F.shiftrightunsigned("th", 64 - HASH_BITS)
    for k in range(len(dims)):
        lo, hi = ends[2 * k] or 0.0, ends[2 * k + 1] or 0.0
        step = F.floor((F.col(f"x{k}") - lo) / ((hi - lo) or 1.0) * ((1 << GRID_BITS) - 1)).cast("long")
        light = light.withColumn(f"k{k}", step * (1 << HASH_BITS) + low)
    keys = [f"k{k}" for k in range(len(dims))]
    return light.select("rid", "doc_id", "size", "text_crc32", *keys), keys


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: list[Column] | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot: a row per row of docs; other columns are left out.

    Give the number of shards or the bytes of one. dims: numeric columns over docs (null: 0); text_dimensions() by default.
    Null text: no bytes, checksum of none. slot numbers a shard's rows from 0 without gaps. Equal texts share a shard
    unless a cut must go through their group, which then is dealt by row; so are rows that repeat. A text longer than a
    shard makes its shard larger. An empty table gives no rows; with fewer rows than shards some shards stay empty.
    """
    light, keys = keyed(docs, dims)
    rows, total = light.agg(F.count("*"), F.sum("size")).first()
    shards = shards or parts(total or 0, target_bytes)
    return _numbered(leaves(light, keys, shards, SLACK * (total or 0) / shards).withColumnRenamed("node", "shard"), rows)


def leaves(rows: DataFrame, keys: list[str], shards: int, slack: float) -> DataFrame:
    """rows of keyed() with their leaf: node, a leaf's number. slack: bytes by which a cut may miss its goal before
    other dimensions, and last rows in place of keys, are cut."""
    level, count = rows.withColumns({"node": F.lit(0), "leaves": F.lit(shards)}), 1
    while count < shards and not rows.isEmpty():
        level, count = _split(level, keys, slack, count), 2 * count
    return level.drop("leaves")


def _split(level: DataFrame, keys: list[str], slack: float, count: int) -> DataFrame:
    """One level further; a node is named by its first leaf. leaves: leaves below a node, the larger half to the left."""
    open_ = level.where("leaves > 1")
    grid = lambda f, k: f(F.shiftright(k, HASH_BITS))
    nodes = open_.groupBy("node").agg(F.sum("size").alias("s"), F.first("leaves").alias("leaves"), F.array(*(grid(F.max, k) - grid(F.min, k) for k in keys)).alias("widths"))
    goal = (F.col("s") * F.floor((F.col("leaves") + 1) / 2) / F.col("leaves")).cast("double")
    by_width = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("width"), "dim"))
    goals = nodes.select("node", goal.alias("goal"), F.posexplode("widths").alias("dim", "width")).withColumn("rank", by_width)
    goals = written(goals.select("node", "dim", "goal", "rank"), "goals")
    stacked = open_.select("node", "size", F.posexplode(F.array(*keys)).alias("dim", "key"))
    cuts = _search(stacked, goals, count * len(keys)).join(goals, ["node", "dim"])
    # Before the key or behind it, whichever misses less; the widest dimension that misses by no more than slack, else the best.
    ways = F.array(F.struct(F.abs(F.col("before") - F.col("goal")).alias("miss"), F.col("key").alias("cut")), F.struct(F.abs(F.col("before") + F.col("own") - F.col("goal")).alias("miss"), (F.col("key") + 1).alias("cut")))
    cuts = written(cuts.withColumn("way", F.array_min(ways)), "cuts")
    choice = F.struct((F.col("way.miss") > slack).alias("over"), F.when(F.col("way.miss") > slack, F.col("way.miss")).otherwise(0.0).alias("miss"), "rank", "dim", "way.cut")
    plan = cuts.groupBy("node").agg(F.min(choice).alias("p"))
    plan = written(plan.select("node", "p.over", "p.dim", "p.cut", F.lit(-1).cast("long").alias("cut_rid")), "plan")
    if not plan.where("over").isEmpty():  # along every dimension the cut falls into one large group: it is cut by row
        torn = cuts.where("rank = 1").join(plan.where("over").select("node"), "node").select("node", "dim", "key", (F.col("goal") - F.col("before")).alias("goal"))
        inside = open_.join(torn, "node").where(F.element_at(F.array(*keys), F.col("dim") + 1) == F.col("key")).select("node", F.lit(0).alias("dim"), F.col("rid").alias("key"), "size")
        rids = _search(inside, torn.withColumn("dim", F.lit(0)), count).select("node", F.col("key").alias("rid"), "before", "own")
        cut_rid = F.when(F.col("goal") - F.col("before") > F.col("own") / 2, F.col("rid") + 1).otherwise(F.col("rid"))
        torn = torn.join(rids, "node").select("node", F.lit(True).alias("over"), "dim", F.col("key").alias("cut"), cut_rid.alias("cut_rid"))
        plan = written(plan.where("NOT over").unionByName(torn), "plan")
    key = F.element_at(F.array(*keys), F.coalesce("dim", F.lit(0)) + 1)
    right = F.coalesce((key > F.col("cut")) | ((key == F.col("cut")) & (F.col("rid") >= F.col("cut_rid"))), F.lit(False))
    left = F.floor((F.col("leaves") + 1) / 2).cast("int")
    out = level.join(plan, "node", "left")
    node, below = F.when(right, F.col("node") + left).otherwise(F.col("node")), F.when(right, F.col("leaves") - left).otherwise(left)
    return written(out.select("rid", "doc_id", "size", "text_crc32", *keys, node.alias("node"), below.alias("leaves")), "level")


def _numbered(rows: DataFrame, count: int) -> DataFrame:
    """Add slot: ranges of rows by a hash of their number, sums of whole ranges first, places in a range second."""
    n = parts(count, RANGE_ROWS)
    rows = rows.withColumn("range", F.pmod(F.xxhash64("rid"), F.lit(n)))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("shard", "range").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("shard", "range").orderBy("rid")) - 1)
    out = placed.join(sums.select("shard", "range", "before"), ["shard", "range"])
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("place")).cast("long").alias("slot"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
