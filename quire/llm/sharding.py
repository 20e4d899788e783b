"""Sharding by a hierarchical weighted hash tree.

Shards stand in racks and racks in regions. A row descends from the top: at each level every child draws ln(u) / weight,
u being a hash of the row's key and the child's name, and the largest draw wins. A child's draw depends on the key, the
child and its weight alone, so a change of weights below a node only moves rows into or out of the subtrees whose
weights change. A grown tree gets each further shard as a region of its own, so that rows move into that shard only.

Defined results: rows with equal keys, null too, go to one shard. Null text has size 16 and the checksum of no bytes.
Repeated rows take a slot each; in a part of a shard, slots follow doc_id, checksum and size, so rows alike in these are
alike in all that is told. Of a text only its size and checksum are read, however long it is. Other columns are kept, but for those named like an output column, which are replaced,
and `_part` and `_start`, which are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import sized, staged

#: Racks in a region and shards in a rack of the planned tree.
RACKS, SHARDS = 2, 4
#: Parts of each shard in which its slots are counted, at least, and rows that a part holds about, from which there are more.
SLOT_PARTS, PART_ROWS = 64, 50_000


@dataclass(frozen=True)
class Node:
    """A shard if it has no children."""

    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int = -1


def plan(shards: int, base: int | None = None, racks: int = RACKS, per_rack: int = SHARDS) -> Node:
    """A tree of `shards` shards: regions of full racks up to base of them, then a region for each further one."""
    base = shards if base is None else base
    leaf = lambda i: Node(f"shard-{i}", 1.0, (), i)
    group = lambda name, nodes: Node(name, sum(n.weight for n in nodes), tuple(nodes))
    regions, size = [], racks * per_rack
    for at in range(0, min(base, shards), size):
        held = [leaf(i) for i in range(at, min(at + size, base, shards))]
        regions.append(group(f"region-{at // size}", [group(f"rack-{at // size}-{r}", held[r * per_rack : (r + 1) * per_rack]) for r in range(racks) if held[r * per_rack :]]))
    regions += [group(f"region-of-{i}", [group(f"rack-of-{i}", [leaf(i)])]) for i in range(base, shards)]
    return group("all", regions)


def reweighted(tree: Node, weights: dict[int, float]) -> Node:
    """The tree with other weights of some shards, and of all that stands above them."""
    if not tree.children:
        return Node(tree.name, weights.get(tree.shard, tree.weight), (), tree.shard)
    children = tuple(reweighted(c, weights) for c in tree.children)
    return Node(tree.name, sum(c.weight for c in children), children)


def _draw(key: Column, node: Node) -> Column:
    """ln(u) / weight, u in (0, 1) from 52 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 12)
    return F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(node.weight)


def shard_of(key: Column, tree: Node) -> Column:
    """The shard of a key; draws are made on the way down only."""
    if not tree.children:
        return F.lit(tree.shard)
    live = [c for c in tree.children if c.weight > 0]
    if len(live) == 1:
        return shard_of(key, live[0])
    won = F.array_max(F.array(*[F.struct(_draw(key, c).alias("draw"), F.lit(-i).alias("i")) for i, c in enumerate(live)]))["i"]

    def below(w: Column) -> Column:
        out = shard_of(key, live[-1])
        for i, child in reversed(list(enumerate(live[:-1]))):
            out = F.when(w == -i, shard_of(key, child)).otherwise(out)
        return out

    # the winner is bound to a name, so that its draws stand in the plan once
    return F.transform(F.array(won), below)[0]


def shard_rows(docs: DataFrame, shards: int, base: int | None = None, order: tuple[str, str] | None = None) -> DataFrame:
    """The columns of docs, then size, text_crc32, law, shard, slot and grown_shard.

    Slots follow a hash, or two columns that order names and that are dropped: a part of a bounded number of rows, and a
    place inside it.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rest = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard", "_start", *(() if order else ("_part",)))
    rows = rest.withColumn("size", (F.octet_length(text) + 16).cast("long")).withColumn("text_crc32", F.crc32(text)).withColumn("law", F.lit("key"))
    base = shards if base is None else base
    key = F.col("doc_id")
    rows = rows.withColumn("shard", shard_of(key, plan(shards, base)).cast("int")).withColumn("grown_shard", shard_of(key, plan(shards + 1, base)).cast("int"))
    if order:
        rows = rows.withColumn("_part", F.col(order[0]))
    else:
        parts = max(SLOT_PARTS, -(-docs.count() // (shards * PART_ROWS)))
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int"))
    # at most a row for each shard and part
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(counts.select("shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")), "slots")
    inside = Window.partitionBy("shard", "_part").orderBy(*([order[1]] if order else []), "doc_id", "text_crc32", "size")
    placed = rows.join(sized(starts), ["shard", "_part"]).withColumn("slot", F.col("_start") + F.row_number().over(inside) - 1)
    return placed.select(*[c for c in rest.columns if c not in (order or ())], "size", "text_crc32", "law", "shard", "slot", "grown_shard")
