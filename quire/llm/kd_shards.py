"""Shards of near-equal bytes by k-d tree partitioning.

Equal texts are one point, weighing all their bytes, in the space of the metadata (language, source, length, id).
The tree splits recursively: along the dimension whose range in the node is widest, at the weighted quantile that
gives both sides the bytes their shards have room for, until a leaf is one shard. A quantile is found by counting
bytes per bucket of the dimension and counting again inside the bucket it falls in; only bucket sums reach the
driver, at most ``BUCKETS`` per node. Points heavier than a small part of a shard (so few that they can be listed) are
placed first, each whole while a shard has room for it, else cut by hash buckets of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import order_id, save

#: Sums per node and pass; hash buckets of a cut point and of a shard's slots.
BUCKETS = 4096
BITS, SPREAD = 40, 22
#: A point is heavy from this part of a shard on: at most ``HEAVY`` times the shards can be.
HEAVY = 64


def _ordinal(column: str) -> Column:
    """A string's place in code point order, by its first six bytes."""
    return F.conv(F.rpad(F.substring(F.hex(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), 1, 12), 12, "0"), 16, 10).cast("double")


def _cut(points: DataFrame, key: str, goals: dict[int, float], slack: float) -> dict[int, int]:
    """Per node the key up to which points go left, so that their weight comes nearest to the goal."""
    low = {n: 0 for n in goals}
    below = {n: 0.0 for n in goals}
    shift, open_nodes, cut = BITS + SPREAD, set(goals), {n: (1 << BITS + SPREAD) for n in goals}
    while open_nodes and shift > 0:
        step = min(12, shift)
        shift -= step
        inside = F.lit(False)
        for n in open_nodes:
            inside = inside | ((F.col("node") == n) & (F.shiftright(key, shift + step) == low[n]))
        sums: dict[int, list] = {n: [] for n in open_nodes}
        for r in points.where(inside).groupBy("node", F.shiftright(key, shift).alias("bucket")).agg(F.sum("weight").alias("w")).collect():
            sums[r["node"]].append((r["bucket"], r["w"]))
        for n in list(open_nodes):
            if not sums[n]:
                open_nodes.discard(n)
                continue
            for bucket, w in sorted(sums[n]):
                last = bucket, w
                if below[n] + w >= goals[n]:
                    break
                below[n] += w
            bucket, w = last
            low[n] = bucket
            if w <= slack or shift == 0:
                take = goals[n] - below[n] >= w / 2
                cut[n] = (bucket + take) << shift
                open_nodes.discard(n)
    return cut


def _place_heavy(heavy: list[tuple], shards: int, room: list[float], pieces) -> list[tuple]:
    """(group, first bucket, bucket after the last, shard) of heavy points; ``room`` is used up."""
    out = []
    for group, weight in sorted(heavy, key=lambda x: (-x[1], x[0])):
        best = max(range(shards), key=lambda s: (room[s], -s))
        if weight <= room[best]:
            room[best] -= weight
            out.append((*group, 0, BUCKETS, best))
            continue
        start = 0
        parts = pieces(group)
        for i, (bucket, w) in enumerate(parts):
            if room[best] < w / 2 and bucket > start:
                out.append((*group, start, bucket, best))
                start, best = bucket, max(range(shards), key=lambda s: (room[s], -s))
            room[best] -= w
        out.append((*group, start, BUCKETS, best))
    return out


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per row of ``docs``: its id, ``size`` (UTF-8 bytes of the text, plus 1), ``text_crc32``, ``law`` (bytes), ``shard`` and ``slot``.

    Shards hold near-equal bytes. Rows of equal text share a shard, but for a text whose copies fit in no shard, which
    is cut by ids. Slots number a shard's rows from 0 without gaps. ``categories`` not among the columns are left out.
    A null text has size 1 and is a text of its own; a null id comes last; equal rows get neighbouring slots. Fewer
    texts than shards leave shards empty; an empty table gives an empty one. Reruns agree. ``shards`` is a power of two.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    text = F.col(text_col)
    named = [c for c in categories if c in docs.columns]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h1"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), text.isNull().alias("missing"), *[F.col(c).alias(f"c_{c}") for c in named])
    rows = save(rows, "rows")
    group = ["h1", "text_crc32", "size", "missing"]
    points = rows.groupBy(*group).agg(F.sum("size").cast("double").alias("weight"), F.min(order_id("id")).cast("double").alias("d_id"), *[F.min(_ordinal(f"c_{c}")).alias(f"d_{c}") for c in named])
    points = save(points.withColumn("d_length", F.log2(F.col("size").cast("double"))), "points")
    total = points.agg(F.sum("weight")).first()[0] or 0.0
    goal = total / shards
    heavy_rows = points.where(F.col("weight") > goal / HEAVY).select(*group, "weight").collect()  # at most HEAVY * shards, by their weight

    def pieces(key: tuple) -> list[tuple[int, float]]:
        own = rows.where((F.col("h1") == key[0]) & (F.col("text_crc32") == key[1]) & (F.col("size") == key[2]) & (F.col("missing") == F.lit(key[3])))
        return sorted((r["b"], float(r["w"])) for r in own.groupBy(_bucket().alias("b")).agg(F.sum("size").alias("w")).collect())

    room = [goal] * shards
    placed = _place_heavy([(tuple(r[c] for c in group), r["weight"]) for r in heavy_rows], shards, room, pieces)
    light = points.where(F.col("weight") <= goal / HEAVY)

    dims = [c for c in points.columns if c.startswith("d_")]
    whole = light.agg(*[f(c).alias(f"{n}{c}") for c in dims for n, f in (("a", F.min), ("b", F.max))]).first()
    spread = F.pmod(F.xxhash64(F.lit(3), "h1", "size"), F.lit(1 << SPREAD))
    keyed = []
    for c in dims:
        a, b = whole[f"a{c}"], whole[f"b{c}"]
        part = (F.col(c) - F.lit(a)) / F.lit(b - a) if a is not None and b > a else F.lit(0.0)
        keyed.append((F.shiftleft(F.floor(part * F.lit(float((1 << BITS) - 1))).cast("long"), SPREAD) + spread).alias(f"k{c}"))
    tree = save(light.select(*group, "weight", *keyed), "tree").withColumn("node", F.lit(0))
    width = shards
    while width > 1:
        nodes = range(shards // width)
        spans = {r["node"]: r for r in tree.groupBy("node").agg(*[(F.max(f"k{c}") - F.min(f"k{c}")).alias(c) for c in dims]).collect()}
        chosen = {n: max(dims, key=lambda c: spans[n][c]) for n in nodes if n in spans}
        goals = {n: max(0.0, sum(room[n * width:n * width + width // 2])) for n in chosen}
        # What the leaves below hold decides the share of the node's bytes that goes left.
        held = {r["node"]: r["w"] for r in tree.groupBy("node").agg(F.sum("weight").alias("w")).collect()}
        goals = {n: held[n] * g / max(1e-9, g + max(0.0, sum(room[n * width + width // 2:(n + 1) * width]))) for n, g in goals.items()}
        key = F.lit(0).cast("long")
        for n, c in chosen.items():
            key = F.when(F.col("node") == n, F.col(f"k{c}")).otherwise(key)
        cuts = _cut(tree.withColumn("key", key), "key", goals, goal * 1e-4)
        right = F.lit(False)
        for n, x in cuts.items():
            right = right | ((F.col("node") == n) & (key >= F.lit(x)))
        tree = save(tree.withColumn("node", F.col("node") * 2 + right.cast("int")), "tree")
        width //= 2
    spark = docs.sparkSession
    schema = "h1 long, text_crc32 long, size long, missing boolean, low int, high int, shard int"
    leaves = tree.select(*group, F.lit(0).alias("low"), F.lit(BUCKETS).alias("high"), F.col("node").cast("int").alias("shard"))
    where = save(leaves.unionByName(spark.createDataFrame(placed, schema)), "places")
    out = rows.withColumn("b", _bucket()).join(where, group).where("b >= low AND b < high")
    out = save(out.select("id", "h1", "size", "text_crc32", "missing", "shard"), "sharded")
    out = out.withColumn("b", F.pmod(F.xxhash64(F.lit(5), "id", "h1"), F.lit(BUCKETS)))
    counts = out.groupBy("shard", "b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = save(counts.select("shard", "b", before.alias("before")), "offsets")
    slot = F.row_number().over(Window.partitionBy("shard", "b").orderBy(order_id("id"), "h1", "size", "missing")) - 1 + F.col("before")
    out = out.join(offsets, ["shard", "b"]).withColumn("slot", slot.cast("long"))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")


def _bucket() -> Column:
    return F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(BUCKETS)).cast("int")
