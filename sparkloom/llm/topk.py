"""Exact top-k inner products by branch-and-bound over vertical blocks of dimensions.

Vectors become integers, floor(256 * x).  A stated set of queries meets all rows in
blocks: candidates are dealt by hash into cells of about ``cell_rows`` vectors,
queries into groups of about ``group_rows``.  Cells and groups are stored once in the
shared folder, and every (cell, group) pair is one row of a task, which reads the two
from there: no vector is copied for the sake of another.

Inside it vectors lie dimension by dimension, those first in which they vary most.  A
bar for each query comes from a few candidates taken in full.  Inner products grow
block by block of dimensions; what the remaining dimensions can still add is bounded by
the product of the remaining norms (Cauchy-Schwarz).  A candidate whose best possible
score is below a query's bar is dropped for that query, and survivors are compacted
before the next block: to fewer candidates, or to single pairs when few are left.
Only k rows a query leave a cell, so merging them is small beside the search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.llm import arrays
from sparkloom.plans.stored import new_path, written


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>); rows without a wholly finite vector or an id are left out."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(finite)


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 * x): doubles, or whole numbers of any size where doubles would not hold them."""
    if float(np.abs(x).max(initial=0)) < 2.0**44:
        return np.floor(x * 256)
    return np.array([[int(y) * 256 if abs(y) >= 2.0**53 else math.floor(y * 256) for y in r] for r in x.tolist()], dtype=object).reshape(x.shape)


def _dtype(q: np.ndarray, c: np.ndarray) -> type:
    """The narrowest type in which every partial sum is a whole number held exactly."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


class Work:
    """How many products of single components a search would take and took."""

    def __init__(self) -> None:
        self.all = self.done = 0


def _best(score: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """The k best of one query's candidates, ties to the smaller row."""
    if score.dtype != object and len(score) > k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return near[np.lexsort((row[near], -score[near]))[:k]]
    return np.array(sorted(range(len(score)), key=lambda j: (-score[j], row[j]))[:k], dtype=np.int64)


def branch_and_bound(
    q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, block: int = 16, rows: int = 64, taken: int = 256, work: Work | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of every query's k best candidates, ties to the smaller id; own ids don't count.

    ``q`` and ``c`` hold a vector a row, of one length, with whole numbers.  ``taken``
    candidates are scored in full for the first bar.
    """
    work = work or Work()
    kind = object if q.dtype == object or c.dtype == object else _dtype(q, c)
    if kind is object:  # beyond what doubles hold exactly: whole numbers of any size
        q, c = (np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) for m in (q, c))
    order = np.argsort(c_ids, kind="stable")
    c, c_ids = c[order], c_ids[order]
    weight = np.square(q.astype(np.float64)).sum(0) * np.square(c.astype(np.float64)).sum(0) if len(c) else np.zeros(q.shape[1])
    dims = np.argsort(-weight, kind="stable")
    q, vertical = q[:, dims].astype(kind), np.ascontiguousarray(c[:, dims].T.astype(kind))
    starts = list(range(0, len(dims), block)) or [0]
    q_left = [np.sqrt(np.square(q[:, s:].astype(np.float64)).sum(1)) for s in [*starts, len(dims)]]
    c_left = [np.sqrt(np.square(vertical[s:].astype(np.float64)).sum(0)) for s in [*starts, len(dims)]]
    few = np.linspace(0, len(c_ids) - 1, taken).astype(np.int64) if len(c_ids) > 4 * taken else np.empty(0, dtype=np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), rows):
        part, alive = slice(at, min(at + rows, len(q))), np.arange(len(c_ids))
        n, own = part.stop - at, q_ids[part][:, None] == c_ids[None, :]
        bar = np.full(n, -np.inf)
        if len(few):
            sums = np.where(own[:, few], -np.inf, (q[part] @ vertical[:, few]).astype(np.float64))
            bar = np.partition(sums, len(few) - k, axis=1)[:, len(few) - k]
            work.done += n * len(few) * len(dims)
        work.all += n * len(alive) * len(dims)
        held, pairs = np.zeros((n, len(alive)), dtype=kind), None
        for number, s in enumerate(starts):
            width = min(block, len(dims) - s)
            if pairs is None:
                held = held + q[part, s : s + block] @ vertical[s : s + block][:, alive]
                work.done += n * len(alive) * width
            else:
                i, j, sums = pairs
                for d in range(s, s + width):
                    sums = sums + q[at + i, d] * vertical[d, j]
                pairs = i, j, sums
                work.done += len(i) * width
            if number + 1 == len(starts):
                continue
            # Half a unit over the bound covers rounding in the norms.
            left, its = q_left[number + 1][part], c_left[number + 1]
            if pairs is not None:
                i, j, sums = pairs
                live = sums.astype(np.float64) + left[i] * its[j] * (1 + 1e-9) + 0.5 >= bar[i]
                pairs = i[live], j[live], sums[live]
                continue
            slack, sums = left[:, None] * its[alive][None, :] * (1 + 1e-9) + 0.5, held.astype(np.float64)
            if len(alive) > k:
                certain = np.where(own[:, alive], -np.inf, sums - slack)
                bar = np.maximum(bar, np.partition(certain, len(alive) - k, axis=1)[:, len(alive) - k])
            live = (sums + slack >= bar[:, None]) & ~own[:, alive]
            if live.mean() < 0.3:
                i, j = np.nonzero(live)
                pairs = i, alive[j], held[i, j]
            elif (keep := live.any(0)).mean() < 0.9:
                alive, held = alive[keep], held[:, keep]
        if pairs is None:
            i, j = np.nonzero(~own[:, alive])
            pairs = i, alive[j], held[i, j]
        i, j, sums = pairs
        for begin, end, query in zip(np.searchsorted(i, np.arange(n)), np.searchsorted(i, np.arange(n), "right"), range(at, part.stop), strict=True):
            best = begin + _best(sums[begin:end], j[begin:end], k)
            out.append((np.full(len(best), query), order[j[best]], sums[best]))
    return tuple(np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (zip(*out, strict=True) if out else ([], [], [])))


def _saved(folder: str, side: str):
    """Stores the vectors of a cell or group, a pair of arrays for each length."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        number, rows = int(group["number"].iloc[0]), []
        lengths = group["v"].map(len)
        for length in sorted(set(lengths)):
            some = group[lengths == length]
            arrays.save(folder, f"{side}-{number}-{length}-ids", some[["vec_id", "query_key"]].to_numpy(dtype="<i8"))
            arrays.save(folder, f"{side}-{number}-{length}-v", np.array(some["v"].tolist(), dtype="<f8"))
            rows.append((number, length))
        return pd.DataFrame(rows, columns=["number", "length"])

    return run


def _search(folder: str, k: int, block: int):
    def loaded(side: str, number: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.array(arrays.load(folder, f"{side}-{number}-{length}-ids", "<i8")).reshape(-1, 2)
        x = np.array(arrays.load(folder, f"{side}-{number}-{length}-v", "<f8")).reshape(len(ids), length)
        return ids[:, 0], ids[:, 1], quantised(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, group, length in zip(batch["cell"].tolist(), batch["group"].tolist(), batch["length"].tolist(), strict=True):
                q_ids, q_keys, q = loaded("group", group, length)
                c_ids, _, c = loaded("cell", cell, length)
                i, j, score = branch_and_bound(q, q_ids, c, c_ids, k, block)
                yield pd.DataFrame({"query_id": q_ids[i], "query_key": q_keys[i], "vec_id": c_ids[j], "score": np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in score], dtype=np.int64)})

    return run


def top_k_inner_products(
    table: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
    cell_rows: int = 8192, group_rows: int = 4096, block: int = 16,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: every query's k highest integer inner products.

    Queries are the rows whose id is divisible by ``query_every``; candidates are all
    rows whose id isn't the query's own.  Ties go to the smaller id; fewer
    candidates give fewer rows.  Vectors that are null, or hold a null or non-finite
    component, and rows without an id take no part; vectors are compared only with
    those of their own length.  Scores beyond 64 bits are held at the
    largest or smallest long.  Repeated
    candidate rows count once each; equal repeated query rows are answered once.  Other
    columns are not read.
    """
    vectors = written(usable(table, id_col, vector_col).withColumn("query_key", F.xxhash64("v")), "topk-vectors")
    queries = vectors.filter(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id", "query_key"])
    sizes = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("vec_id") % query_every == 0).cast("long")), F.lit(0))).first()
    cells, groups = -(-sizes[0] // cell_rows) or 1, -(-sizes[1] // group_rows) or 1
    folder = new_path(table.sparkSession, "topk")
    dealt = lambda rows, n, side, *by: rows.withColumn("number", F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")).groupBy("number").applyInPandas(_saved(folder, side), "number int, length int")
    left = written(dealt(queries, groups, "group", "vec_id"), "topk-groups").withColumnRenamed("number", "group")
    right = written(dealt(vectors, cells, "cell", "vec_id", "v"), "topk-cells").withColumnRenamed("number", "cell")
    # A row of three numbers for each cell and group, spread over tasks.
    tasks = left.join(right, "length").select("cell", "group", "length").repartition(min(100_000, cells * groups), "cell", "group")
    near = tasks.mapInPandas(_search(folder, k, block), "query_id long, query_key long, vec_id long, score long")
    order = W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
