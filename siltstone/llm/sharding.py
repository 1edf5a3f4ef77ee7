"""Sharding by a hierarchical weighted hash tree.

A topology has three levels: regions hold racks, racks hold shards. A key descends from the root; at each
level every child draws ``ln(u) / weight``, where ``u`` in (0, 1) is hashed from the key and the child's
name, and the largest draw wins. A child's weight is the sum of the shard weights below it. Each child's
chance is thus its share of the weight, and a draw depends on nothing but the key, the child's name and
its weight: if a weight rises, keys move only into the subtree that holds it; if it falls, only out of it.

``grow`` adds one shard in a region and a rack of its own. The draws of all other regions stay as they
were, so every key that moves goes into the new shard. (Adding the shard to an existing rack would confine
movement to that rack's region, but would also deal the region's arrivals to the rack's neighbours.)

A node of weight 0 takes no keys; negative weights, and a tree without any weight, raise ValueError.

Null keys hash as one fixed string. Equal rows share a shard and take neighbouring slots.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

NULL_KEY = "null"


@dataclass(frozen=True)
class Node:
    """A region, a rack or, with ``shard`` set, a shard."""

    name: str
    weight: float = 0.0
    children: tuple["Node", ...] = ()
    shard: int | None = None

    @property
    def total(self) -> float:
        return self.weight if self.shard is not None else sum(c.total for c in self.children)


def rack(name: str, shards: Sequence[tuple[int, float]]) -> Node:
    return Node(name, children=tuple(Node(f"s{i}", w, shard=i) for i, w in shards))


def topology(n_shards: int, regions: int = 4, racks: int = 2, weight: float = 1.0) -> Node:
    """Shards 0 to n_shards - 1 dealt evenly over regions x racks, in order. Empty racks are left out."""
    cells = regions * racks
    ids = [[(i, weight) for i in range(n_shards) if i * cells // n_shards == cell] for cell in range(cells)]
    tops = []
    for r in range(regions):
        below = tuple(rack(f"r{r}k{k}", ids[r * racks + k]) for k in range(racks) if ids[r * racks + k])
        if below:
            tops.append(Node(f"r{r}", children=below))
    return Node("root", children=tuple(tops))


def grow(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The topology with one more shard, in a new region and rack whose names no other region has."""
    names = {top.name for top in root.children}
    top = next(f"r{i}" for i in itertools.count(len(names)) if f"r{i}" not in names)
    return Node(root.name, children=(*root.children, Node(top, children=(rack(f"{top}k0", [(shard, weight)]),))))


def _cell(name: str, weight: float, place: int) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(place).alias("place"))


def _children(groups: Sequence[Sequence[Node]]) -> Column:
    """For each parent, its children as an array of (name, weight, place in the level below)."""
    place, rows = 0, []
    for group in groups:
        cells = []
        for child in group:
            if child.total > 0:
                cells.append(_cell(child.name, child.total, place if child.shard is None else child.shard))
            place += 1
        rows.append(F.array(*(cells or [_cell("", 1.0, 0)])))  # no key comes to a group without weight
    return F.array(*rows)


def _draw(key: Column, children: Column) -> Column:
    """The winning child's place. A tie of draws, one in 2**52, goes to the smaller place."""
    draws = F.transform(children, lambda c: F.struct((F.ln(C.md5_unit(F.concat(key, F.lit("/"), c["name"]))) / c["weight"]).alias("draw"), (-c["place"]).alias("order")))
    return -F.array_max(draws)["order"]


def place(key: Column, root: Node) -> Column:
    """The shard of a key (a string column): three draws, from the root's regions down to a rack's shards."""
    racks = [r for top in root.children for r in top.children]
    if min([shard.weight for r in racks for shard in r.children], default=0.0) < 0 or not root.total > 0:
        raise ValueError("shard weights must not be negative, and one must be positive")
    region = _draw(key, F.element_at(_children([root.children]), 1))
    chosen = _draw(key, F.element_at(_children([top.children for top in root.children]), region + 1))
    return _draw(key, F.element_at(_children([r.children for r in racks]), chosen + 1))


def key_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(NULL_KEY))


def with_slots(df: DataFrame, shard: str, key: str, order: Sequence[str], slices: int = 64, n_shards: int | None = None) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each shard.

    A shard may hold a billion rows, so it is cut into ``slices`` by a hash of the key and the row's order
    columns: rows are numbered within a slice, and the slices' counts, shards x slices rows at most,
    give each slice its first slot. Ties of all order columns are equal rows, which may swap slots.
    """
    cut = C.md5_long(F.concat_ws("/", F.lit("slot"), key_of(F.col(key)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order))) % slices
    sliced = df.withColumn("__slice", cut.cast("int"))
    counts = sliced.groupBy(shard, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(shard).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select(F.col(shard).alias("__shard"), F.col("__slice").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = W.partitionBy(shard, "__slice").orderBy(F.col(key).asc_nulls_first(), *order)
    numbered = sliced.withColumn("__row", F.row_number().over(within).cast("long") - 1)
    joined = numbered.join(F.broadcast(firsts), (F.col(shard) == F.col("__shard")) & (F.col("__slice") == F.col("__of")))
    return joined.withColumn("slot", (F.col("__first") + F.col("__row")).cast("long")).drop("__slice", "__row", "__shard", "__of", "__first")


def shard_documents(docs: DataFrame, n_shards: int = 40, root: Node | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot and the shard with one more.

    Null text: 16 bytes of size and the CRC of the empty string. Empty table: no rows. Other columns of the
    input are not read. The text itself is not shuffled: size and CRC replace it before the numbering.
    """
    root = root or topology(n_shards)
    key, text = key_of(F.col(id_col)), F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, root).cast("int").alias("shard"),
        place(key, grow(root, n_shards)).cast("int").alias("grown_shard"),
    )
    return with_slots(placed, "shard", "doc_id", ["size", "text_crc32", "grown_shard"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def query(spark, sf_dir: str) -> DataFrame:
    return shard_documents(C.table(spark, sf_dir, "documents"))
