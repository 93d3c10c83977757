"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends from the root to a region, a rack and a shard.  At each level
every child draws an exponential variate from the hash of the row's key and the
child's path, divided by the child's weight, and the smallest wins; a child wins
in proportion to its weight.  Weight that is added later is a draw of its own
("epoch") down to the shard it was added for: rows that it wins go to that shard
and all other rows stay where they are, so movement is confined to the subtree
whose weight changed.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import ensure

#: Blocks of a shard in which slots are numbered; the offsets table has shards x BLOCKS rows at most.
BLOCKS = 1024


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0
    epoch: int = 0


def fleet(shards: int, base: int = 8) -> list[Shard]:
    """``base`` shards laid out at once, two a rack and two racks a region; each further one in an epoch of its own, placed in turn."""
    return [Shard(i // 4 if i < base else i % 2, i // 2 if i < base else i % 4, i, 1.0, max(0, i - base + 1)) for i in range(shards)]


def children(tree: list[Shard]) -> dict[str, list[tuple[str, float]]]:
    """Path of each inner node to its children and their weights, epochs apart."""
    weights: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for s in tree:
        if s.weight > 0:
            path = ""
            for name in (f"{s.region}@{s.epoch}", f"{s.rack}@{s.epoch}", f"{s.shard}"):
                weights[path][name] += s.weight
                path = f"{path}/{name}"
    return {path: sorted(kids.items()) for path, kids in weights.items()}


def _literal(tree: dict[str, list[tuple[str, float]]]) -> Column:
    pairs = []
    for path, kids in sorted(tree.items()):
        pairs += [F.lit(path), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in kids])]
    return F.create_map(*pairs)


def draw(key: Column, path: Column, weight: Column) -> Column:
    """Exponential variate of rate ``weight`` from the upper 53 bits of a hash of key and path."""
    u = (F.shiftrightunsigned(F.xxhash64(key, path), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def _winner(key: Column, path: Column, table: Column) -> Column:
    """The child of ``path`` with the smallest draw, ties by name."""
    return F.array_min(
        F.transform(
            F.element_at(table, path),
            lambda c: F.struct(draw(key, F.concat(path, F.lit("/"), c["name"]), c["weight"]).alias("score"), c["name"].alias("name")),
        )
    )


def place(key: Column, tree: list[Shard]) -> Column:
    """The shard (int) of each key.  Null keys all go to one shard."""
    table = _literal(children(tree))
    path = F.lit("")
    for _ in range(3):
        path = F.concat(path, F.lit("/"), _winner(key, path, table)["name"])
    return F.element_at(F.split(path, "/"), -1).cast("int")


def shard(docs: DataFrame, shards: int = 8, base: int = 8, blocks: int = BLOCKS) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus one (null: one), ``text_crc32`` its
    unsigned CRC-32 (null: of the empty text).  ``slot`` numbers a shard's rows
    from 0 without gaps, by hash block, doc_id, CRC and size; repeated rows get
    slots of their own.  ``grown_shard`` is the shard with one more in the fleet.
    Slots are numbered within 1,024 hash blocks of id and text a shard and moved by the sizes of
    the blocks before, so no task holds a shard.
    """
    docs = ensure(docs, "doc_id", "text")
    key = F.col("doc_id")
    block = F.pmod(F.xxhash64(key, "text", F.lit("block")), F.lit(blocks)).cast("int")  # the text parts rows whose id is null or repeated
    sizes = docs.select(place(key, fleet(shards, base)).alias("shard"), block.alias("block")).groupBy("shard", "block").count()
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        place(key, fleet(shards, base)).alias("shard"), place(key, fleet(shards + 1, base)).alias("grown_shard"), block.alias("block"),
    )
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("n", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("n")).cast("long").alias("slot"), "grown_shard"
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
