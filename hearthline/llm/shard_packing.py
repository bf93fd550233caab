"""Best-fit-decreasing packing of indivisible groups into shards of one capacity.

Rows with the same text form a group, which stays in one shard. Sizes are summed by group in Spark. Packing needs the
large groups one by one, and there are few of them: at most shards / LIGHT groups can hold LIGHT of a shard each. All
lighter groups go whole into a fixed number of bundles by their hash, and a bundle is packed like a group. So the packing
sees a bounded list at any input size, which is sorted by size and put item by item into the fullest shard that still has
room, found in a balanced tree of remaining capacities. `fewest_bins` packs into as few shards of a given capacity as
best fit needs; `level_bins` searches the smallest capacity for which a given number of shards is enough, so that their
sizes are near equal.

A group with more bytes than a shard's share stays whole and has a shard to itself, as its copies cannot be divided.
Defined results: a null text is the empty text, of size 16; repeated rows are placed each; ties are packed in order of the
group's hash, so shards depend on the rows only. Texts are read once; afterwards a row is four numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import columns_only, materialise

#: A group above this share of a shard's mean size is packed alone; smaller ones are bundled.
LIGHT = 1 / 250
#: Bundles of light groups, for each shard.
BUNDLES = 128
OVERHEAD = 16
#: Rows numbered together.
RUN_ROWS = 200_000


@dataclass(frozen=True)
class Item:
    key: int
    size: int


class RoomTree:
    """An AVL tree of (room, shard): adds an entry, or takes out the smallest one of at least some room, in log n."""

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _node(key: tuple[int, int], left: tuple | None, right: tuple | None) -> tuple:
        return key, left, right, 1 + max(left[3] if left else 0, right[3] if right else 0)

    def _balanced(self, key: tuple[int, int], left: tuple | None, right: tuple | None) -> tuple:
        deep = lambda n: n[3] if n else 0
        node = self._node
        if deep(left) > deep(right) + 1:
            k, a, b, _ = left
            if deep(a) >= deep(b):
                return node(k, a, node(key, b, right))
            return node(b[0], node(k, a, b[1]), node(key, b[2], right))
        if deep(right) > deep(left) + 1:
            k, a, b, _ = right
            if deep(b) >= deep(a):
                return node(k, node(key, left, a), b)
            return node(a[0], node(key, left, a[1]), node(k, a[2], b))
        return node(key, left, right)

    def add(self, key: tuple[int, int]) -> None:
        def put(n: tuple | None) -> tuple:
            if n is None:
                return self._node(key, None, None)
            return self._balanced(n[0], put(n[1]), n[2]) if key < n[0] else self._balanced(n[0], n[1], put(n[2]))

        self.root = put(self.root)

    def take(self, least: int) -> tuple[int, int] | None:
        found, n = None, self.root
        while n:
            found, n = (n[0], n[1]) if n[0][0] >= least else (found, n[2])
        if found is None:
            return None

        def without_first(n: tuple) -> tuple[tuple[int, int], tuple | None]:
            if n[1] is None:
                return n[0], n[2]
            key, left = without_first(n[1])
            return key, self._balanced(n[0], left, n[2])

        def cut(n: tuple) -> tuple | None:
            if found < n[0]:
                return self._balanced(n[0], cut(n[1]), n[2])
            if found > n[0]:
                return self._balanced(n[0], n[1], cut(n[2]))
            if n[1] is None or n[2] is None:
                return n[1] or n[2]
            key, right = without_first(n[2])
            return self._balanced(key, n[1], right)

        self.root = cut(self.root)
        return found


def best_fit(items: list[Item], capacity: int, most: int | None = None) -> dict[int, int] | None:
    """Shard of each item: items in decreasing size go where the least room is left over. An item above the capacity opens
    a shard that then counts as full. None if more than `most` shards are needed."""
    rooms, placed, opened = RoomTree(), {}, 0
    for item in sorted(items, key=lambda x: (-x.size, x.key)):
        found = rooms.take(item.size)
        if found is None:
            if opened == most:
                return None
            found = (max(capacity, item.size), opened)
            opened += 1
        placed[item.key] = found[1]
        rooms.add((found[0] - item.size, found[1]))
    return placed


def fewest_bins(items: list[Item], capacity: int) -> dict[int, int]:
    """As few shards of the capacity as best fit needs."""
    return best_fit(items, capacity)


def level_bins(items: list[Item], shards: int) -> dict[int, int]:
    """The packing into at most `shards` shards with the smallest capacity that best fit finds."""
    if not items:
        return {}
    total = sum(i.size for i in items)
    low, high = -(-total // shards), -(-total // shards) + max(i.size for i in items)
    best = best_fit(items, high, shards)
    while low < high:
        middle = (low + high) // 2
        found = best_fit(items, middle, shards)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    return best


def group_key() -> Column:
    """64 bits of the text; two texts that agree here share a shard, which breaks no rule."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shard_rows(docs: DataFrame, shards: int = 40, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard). With a capacity, as few shards as it allows; else exactly
    `shards` of near equal bytes. Slots number the rows of a shard from 0."""
    text = F.coalesce("text", F.lit(""))
    slim = columns_only(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group_key().alias("grp"))
    slim = materialise(slim)
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    share = capacity or -(-total["bytes"] // shards) or 1
    bundles = BUNDLES * max(1, -(-total["bytes"] // share))
    groups = materialise(slim.groupBy("grp").agg(F.sum("size").alias("size")))
    light = F.col("size") < F.lit(share * LIGHT)
    bundle = F.pmod(F.xxhash64("grp"), F.lit(bundles))
    heavy = [Item(r["grp"], r["size"]) for r in groups.where(~light).collect()]  # at most bytes / (share * LIGHT) rows
    packs = [Item(r["bundle"], r["size"]) for r in groups.where(light).groupBy(bundle.alias("bundle")).agg(F.sum("size").alias("size")).collect()]
    items = [Item(k, i.size) for k, i in enumerate([*heavy, *packs])]
    shard_of = fewest_bins(items, capacity) if capacity else level_bins(items, shards)
    spark = docs.sparkSession
    own = spark.createDataFrame([(h.key, shard_of[k]) for k, h in enumerate(heavy)], "grp long, own int")
    bundled = spark.createDataFrame([(p.key, shard_of[len(heavy) + k]) for k, p in enumerate(packs)], "bundle long, bundled int")
    placed = slim.join(F.broadcast(own), "grp", "left").withColumn("bundle", bundle).join(F.broadcast(bundled), "bundle", "left")
    placed = placed.select("doc_id", "size", "text_crc32", "grp", F.coalesce("own", "bundled").alias("shard"))
    return number_rows(placed, total["rows"], shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def number_rows(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard: rows are numbered in runs of bounded size, and each run starts where the
    runs before it end. The table of runs is small, one row for some thousands of rows."""
    runs = max(16, -(-rows // (shards * RUN_ROWS)))
    placed = placed.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(runs)).cast("int"))
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "size", "text_crc32", "grp")
    numbered = placed.withColumn("place", F.row_number().over(within))
    return numbered.join(starts, ["shard", "run"]).withColumn("slot", (F.col("start") + F.col("place") - 1).cast("long"))
