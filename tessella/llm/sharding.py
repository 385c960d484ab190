"""Sharding by balanced label propagation, in DataFrame joins only.

Documents with equal texts are linked through a node for the text, so a group of thousands has as many links as
members. Every document starts in a shard drawn from its id. In each round a text node counts its members by shard
(partial counts before the shuffle) and names the shard that most of them are in; members elsewhere ask to move there.
A shard admits what its quota leaves room for: if more ask, an equal share of the asking groups, chosen by hash, moves
whole; groups too large for a shard move document by document. Rounds end when no document moves, or after `ROUNDS`.
At last sizes are made even exactly: what a shard holds beyond its share leaves it, documents without links first,
then members of the largest groups, and fills the places that are free elsewhere.

Ranks inside a shard come from counts of 3 * `CELLS` cells to a shard and a sort inside each cell, so no task holds a
whole shard; the table of cells has a fixed bound. What is cut at the end is what even sizes force: a group is whole
unless it fits no shard or its shard's surplus is not covered by documents without links and by larger groups;
cut_links() counts it. Defined results: null texts count as empty, and are linked with empty ones; repeated rows and
rows with a null doc_id count as rows; an empty table gives no rows; fewer rows than shards leave shards empty; texts
are only hashed, whatever their length; columns but doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unstage

#: Rounds of propagation at most; cells to a shard and kind; a group of so many rows is broken up before smaller ones
#: when sizes are made even; what a shard may hold over its share while labels move.
ROUNDS, CELLS, LARGE, SLACK = 8, 1024, 1000, 0.5


def _unit(*columns: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def _by_number(values: list, of: Column, otherwise) -> Column:
    """values[of]; as many values as shards."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), of + 1) if values else F.lit(otherwise)


def _sizes(nodes: DataFrame, shards: int, label: str = "shard") -> list[int]:
    got = {r[0]: r[1] for r in nodes.groupBy(label).count().collect()}  # a row for each shard
    return [got.get(k, 0) for k in range(shards)]


def propagate(nodes: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """nodes (doc_id, link, group, ...) with the shard that label propagation ends in; sizes are near even."""
    nodes = stage(nodes.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int")), "shards")
    linked = nodes.filter("group > 1")
    sizes = _sizes(nodes, shards)
    room = -(-sum(sizes) // shards)
    limit = room + max(1, int(SLACK * room))
    for k in range(rounds):
        count = linked.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("c"))
        best = stage(count.groupBy("link").agg(F.max_by("shard", F.struct("c", F.xxhash64("link", "shard"))).alias("to")), "best")  # so that AQE can split a hot link
        ask = linked.join(best, "link").filter("shard <> to")
        asked = _sizes(ask, shards, "to")
        share = [min(1.0, max(0, limit - s) / a) if a else 0.0 for s, a in zip(sizes, asked, strict=True)]
        drawn = F.when(F.col("group") <= room, _unit(F.col("link"), F.lit(k))).otherwise(_unit(F.col("doc_id"), F.lit(k)))
        move = (F.col("shard") != F.col("to")) & (drawn < _by_number(share, F.col("to"), 0.0))
        moved = stage(linked.join(best, "link").withColumn("was", F.col("shard")).withColumn("shard", F.when(move, F.col("to")).otherwise(F.col("shard"))).drop("to"), "moved")
        n = moved.filter("was <> shard").count()
        unstage(best)
        linked = moved.drop("was")
        free = nodes.filter("group = 1")
        sizes = [a + b for a, b in zip(_sizes(linked, shards), _sizes(free, shards), strict=True)]
        if not n:
            break
    return nodes.filter("group = 1").unionByName(linked)


def settle(nodes: DataFrame, shards: int) -> DataFrame:
    """Exactly even counts, and each row's slot in its shard."""
    rank = F.when(F.col("group") == 1, 2 * CELLS).when(F.col("group") > LARGE, CELLS).otherwise(0)
    by = F.when((F.col("group") == 1) | (F.col("group") > LARGE), F.xxhash64("doc_id", F.lit(2))).otherwise(F.xxhash64("link", F.lit(2)))
    nodes = nodes.withColumn("cell", (rank + F.pmod(by, F.lit(CELLS))).cast("int"))
    cells = nodes.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("c"))  # at most shards * 3 * CELLS rows
    before = cells.withColumn("before", F.sum("c").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).drop("c")
    before = stage(before, "cells")
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("link", "doc_id"))
    ranked = nodes.withColumn("inside", inside).join(F.broadcast(before), ["shard", "cell"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    sizes = _sizes(nodes, shards)
    total = sum(sizes)
    share = [total // shards] * shards
    for k in sorted(range(shards), key=lambda k: (-sizes[k], k))[: total % shards]:
        share[k] += 1
    over, free, at = [], [], 0
    for s, q in zip(sizes, share, strict=True):
        over.append(at - q)  # a row of rank r >= q leaves as number at + r - q
        at += max(0, s - q)
    to, slot, at = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    number = F.col("rank") + _by_number(over, F.col("shard"), 0)
    for k in range(shards):
        if share[k] > sizes[k]:
            fits = (number >= at) & (number < at + share[k] - sizes[k])
            to = F.when(fits, k).otherwise(to)
            slot = F.when(fits, number - at + sizes[k]).otherwise(slot)
            at += share[k] - sizes[k]
    stays = F.col("rank") < _by_number(share, F.col("shard"), 0)
    return ranked.withColumn("slot", F.when(stays, F.col("rank")).otherwise(slot).cast("long")).withColumn("shard", F.when(stays, F.col("shard")).otherwise(to).cast("int")).drop("cell", "inside", "before", "rank")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null: growing moves rows under this law)."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.lit(7)).alias("h"))
    base = stage(base.select("doc_id", "size", "text_crc32", F.xxhash64("h", "text_crc32", "size").alias("link")), "documents")
    groups = stage(base.groupBy("link").agg(F.count(F.lit(1)).alias("group")).filter("group > 1"), "groups")  # so that AQE can split a hot link
    nodes = base.join(groups, "link", "left").withColumn("group", F.coalesce("group", F.lit(1)))
    out = settle(propagate(nodes, shards), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_links(sharded: DataFrame) -> DataFrame:
    """One row: groups of equal texts (by size and crc32), groups whose members are in several shards, and the members that
    are not in the shard that most of their group are in (the links to the group's text that are cut)."""
    c = sharded.groupBy("text_crc32", "size", "shard").agg(F.count(F.lit(1)).alias("c"))
    g = c.groupBy("text_crc32", "size").agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.count(F.lit(1)).alias("shards")).filter("n > 1")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.count(F.when(F.col("shards") > 1, 1)).alias("split_groups"), F.coalesce(F.sum(F.col("n") - F.col("top")), F.lit(0)).alias("cut_links"))
