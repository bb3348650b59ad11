"""Minimax contiguous sharding of documents, with DataFrame functions only.

Equal texts form a group that is never split.  Groups are gathered in
``2 ** unit_bits`` ranges of the hash of their text: the atomic units, whose number
does not grow with the data.  The sequence begins with the units larger than an equal
share of what is left, the largest first, and goes on in the order of hashes.  No
capacity lets one of the former share a shard with less than all it needs, so each is
cut off alone, at any size of the data; left in the order of hashes, one unit of a
third of all bytes would set the capacity for all, and fill three or four shards of 24.
For the others the smallest feasible capacity is found by binary search, each trial
filling shards greedily, and the sequence is cut where that capacity overflows.

The search folds over one row of at most ``2 ** unit_bits`` sums.  Documents are
only ever grouped by (shard, hash of the id), so a large group of copies is
spread over as many tasks as any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.plans import written


def _oversized(units: Column, total: Column, n_shards: int) -> Column:
    """Fold over the largest units: those above an equal share of the rest, and what remains."""
    largest = F.slice(F.sort_array(F.transform(units, lambda u: F.struct(u["size"], u["unit"])), asc=False), 1, n_shards)
    start = F.struct(
        total.alias("left"), F.lit(n_shards).cast("long").alias("shards"),
        F.array().cast("array<int>").alias("alone"), F.lit(True).alias("open"),
    )

    def step(state: Column, unit: Column) -> Column:
        large = state["open"] & (state["shards"] > 1) & (unit["size"] * state["shards"] > state["left"])
        return F.when(
            large,
            F.struct(
                (state["left"] - unit["size"]).alias("left"), (state["shards"] - 1).alias("shards"),
                F.concat(state["alone"], F.array(unit["unit"])).alias("alone"), F.lit(True).alias("open"),
            ),
        ).otherwise(F.struct(state["left"].alias("left"), state["shards"].alias("shards"), state["alone"].alias("alone"), F.lit(False).alias("open")))

    return F.aggregate(largest, start, step)


def _shards_needed(sizes: Column, capacity: Column) -> Column:
    """Shards that a greedy filling opens under ``capacity``."""
    return F.aggregate(
        sizes,
        F.struct(F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("held")),
        lambda s, x: F.when(s["held"] + x <= capacity, F.struct(s["n"].alias("n"), (s["held"] + x).alias("held"))).otherwise(
            F.struct((s["n"] + 1).alias("n"), x.alias("held"))
        ),
        lambda s: s["n"],
    )


def _smallest_capacity(sizes: Column, left: Column, shards: Column) -> Column:
    """Binary search; a greedy filling never fails at an equal share plus the largest unit."""
    largest = F.coalesce(F.array_max(sizes), F.lit(0).cast("long"))
    least = F.greatest(largest, F.ceil(left / shards).cast("long"))
    start = F.struct(least.alias("lo"), (least + largest).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        return F.when(
            s["lo"] < s["hi"],
            F.when(_shards_needed(sizes, middle) <= shards, F.struct(s["lo"].alias("lo"), middle.alias("hi"))).otherwise(
                F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))
            ),
        ).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(62)), start, halve, lambda s: s["hi"])


def _cuts(units: Column, capacity: Column) -> Column:
    """First unit of every shard after the first."""
    return F.aggregate(
        units,
        F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("cuts")),
        lambda s, u: F.when(s["held"] + u["size"] <= capacity, F.struct((s["held"] + u["size"]).alias("held"), s["cuts"].alias("cuts"))).otherwise(
            F.struct(u["size"].alias("held"), F.concat(s["cuts"], F.array(u["unit"])).alias("cuts"))
        ),
        lambda s: s["cuts"],
    )


def minimax_cuts(unit_sizes: DataFrame, n_shards: int) -> DataFrame:
    """One row (alone, cuts, capacity) for a table (unit int, size long) of distinct units.

    ``alone`` lists the units with a shard of their own, ``cuts`` the units at which
    the shards of the others begin.  No units give empty lists and capacity 0.
    """
    one = unit_sizes.agg(
        F.sort_array(F.collect_list(F.struct("unit", "size"))).alias("units"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total"),
    )
    one = one.withColumn("big", F.transform(F.array(F.struct("units", "total")), lambda r: _oversized(r["units"], r["total"], n_shards))[0])
    one = one.select("big", F.filter("units", lambda u: ~F.array_contains(F.col("big.alone"), u["unit"])).alias("rest"))
    found = F.transform(
        F.array(F.struct("rest", F.transform("rest", lambda u: u["size"]).alias("sizes"), "big")),
        lambda r: F.struct(r["rest"].alias("rest"), r["big"]["alone"].alias("alone"), _smallest_capacity(r["sizes"], r["big"]["left"], r["big"]["shards"]).alias("capacity")),
    )
    return one.select(F.explode(found).alias("f")).select("f.alone", _cuts(F.col("f.rest"), F.col("f.capacity")).alias("cuts"), "f.capacity")


def shard_documents(
    docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", unit_bits: int = 16, slot_buckets: int = 1024
) -> DataFrame:
    """Deal documents into ``n_shards`` shards of nearly equal bytes, equal texts together.

    Returns doc_id, size (UTF-8 bytes + 8), text_crc32 (unsigned), law = ``bytes``,
    shard, slot (gapless from 0 in each shard) and grown_shard (always null under
    this law).  A null text counts as the empty one, so both are one group.  Null
    and repeated ids are kept, one row each; rows that tie in id and text get
    neighbouring slots in any order.  Other columns are not read.  An empty table
    gives an empty result; with fewer units than shards some shards stay empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    unit = F.shiftrightunsigned(F.xxhash64(text), 64 - unit_bits).cast("int")
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), unit.alias("unit"),
        ),
        "shard-rows",
    )
    plan = written(minimax_cuts(rows.groupBy("unit").agg(F.sum("size").alias("size")), n_shards), "shard-cuts")
    # One row of at most n_shards numbers.
    placed = rows.crossJoin(F.broadcast(plan.select("alone", "cuts"))).select(
        "doc_id", "size", "text_crc32",
        F.coalesce(
            F.nullif(F.array_position("alone", F.col("unit")), F.lit(0)) - 1,
            F.size("alone") + F.size(F.filter("cuts", lambda c: c <= F.col("unit"))),
        ).cast("int").alias("shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slot_buckets)).cast("int").alias("bucket"),
    )
    before = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = before.select(
        "shard", "bucket",
        (F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"),
    )
    # At most n_shards * slot_buckets rows.
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("within", within).join(F.broadcast(before), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("within") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
