"""Outlier flags and imputation from neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions.missing import number
from sparkloom.plans import sliding, with_ordinal, written


def outlier_iqr(df: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    """Adds ``<value>_outlierIQR``: beyond the quartiles by k times their distance.

    Quartiles are medians of the lower and the upper half, a middle value belonging to
    neither.  With fewer than two numbers nothing is an outlier; missing values never are.
    Only the few ranks next to the quartiles come to the driver.
    """
    out = f"{value}_outlierIQR"
    x = number(df, value)
    rows = with_ordinal(df.select(x.alias("x")).filter("x is not null"), ["x"], "i")
    n = rows.count()
    if n < 2:
        return df.withColumn(out, F.lit(False))
    half = n // 2
    ranks = {(half - 1) // 2, half // 2, n - half + (half - 1) // 2, n - half + half // 2}
    at = {r["i"]: r["x"] for r in rows.filter(F.col("i").isin(sorted(ranks))).collect()}
    low, high = (at[(half - 1) // 2] + at[half // 2]) / 2, (at[n - half + (half - 1) // 2] + at[n - half + half // 2]) / 2
    reach = k * (high - low)
    return df.withColumn(out, F.coalesce((x < low - reach) | (x > high + reach), F.lit(False)))


def outlier_zscore(df: DataFrame, value: str, threshold: float = 3.0) -> DataFrame:
    """Adds ``<value>_outlierZ``: over ``threshold`` population deviations from the mean; false where there are none."""
    x = number(df, value)
    n, mean, std = df.agg(F.count(x), F.avg(x), F.stddev_pop(x)).first()
    found = F.abs((x - F.lit(mean)) / F.lit(std)) > threshold if n and n > 1 and std else F.lit(False)
    return df.withColumn(f"{value}_outlierZ", F.coalesce(found, F.lit(False)))


def _distance(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Euclidean over the features present on both sides; null if there is none."""
    squares = [(a - b) * (a - b) for a, b in zip(left, right, strict=True)]
    shared = squares[0].isNotNull()
    for s in squares[1:]:
        shared = shared | s.isNotNull()
    total = F.coalesce(squares[0], F.lit(0.0))
    for s in squares[1:]:
        total = total + F.coalesce(s, F.lit(0.0))
    return F.when(shared, F.sqrt(total))


def _pairs(left: DataFrame, right: DataFrame, n_left: int, n_right: int) -> DataFrame:
    """Every row of ``left`` beside every row of ``right``, in tasks of about 40 million pairs whose number AQE leaves alone."""
    a, b = -(-n_left // 2000) or 1, -(-n_right // 20_000) or 1
    tasks = min(a * b, 4096)

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        place = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
        return df.withColumns({own: place, other: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))}).repartition(tasks, "__a", "__b")

    return dealt(left, "__a", a, "__b", b).join(dealt(right, "__b", b, "__a", a), ["__a", "__b"]).drop("__a", "__b")


def knn_impute(df: DataFrame, features: Sequence[str], targets: Sequence[str], k: int = 5, row_id: str | None = None, max_pairs: int | None = None) -> DataFrame:
    """Fills gaps of the targets with the mean of the k nearest rows that know them.

    Nearness is over features present in both rows; ties go to the smaller ``row_id``.
    Gaps of equal features have the same neighbours, and of known rows of equal features
    only the first k can be among them: so all different features of gaps are compared
    with those of known rows, k times at most.  More pairs than ``max_pairs`` are an error.
    """
    rows = df.withColumn("__id", F.col(row_id)) if row_id else with_ordinal(df, df.columns, "__id")
    rows = written(rows.withColumns({f"__f{i}": number(df, f) for i, f in enumerate(features)} | {f"__t{i}": number(df, t) for i, t in enumerate(targets)}), "knn-rows")
    f = [f"__f{i}" for i in range(len(features))]
    g = [f"{c}g" for c in f]
    result = rows
    for i, target in enumerate(targets):
        gaps = written(rows.filter(F.col(f"__t{i}").isNull()).select(*[F.col(c).alias(d) for c, d in zip(f, g, strict=True)]).distinct(), "knn-gaps")
        first = F.row_number().over(W.partitionBy(*f).orderBy("__id"))
        known = rows.filter(F.col(f"__t{i}").isNotNull()).select("__id", F.col(f"__t{i}").alias("__known"), *f)
        known = written(known.withColumn("__r", first).filter(F.col("__r") <= k).drop("__r"), "knn-known")
        n_gaps, n_known = gaps.count(), known.count()
        if max_pairs is not None and n_gaps * n_known > max_pairs:
            raise ValueError(f"{n_gaps} gaps and {n_known} known rows of {target} make more than {max_pairs} pairs")
        pairs = _pairs(gaps, known, n_gaps, n_known).withColumn("__d", _distance([F.col(c) for c in g], [F.col(c) for c in f])).filter("__d is not null")
        near = pairs.withColumn("__r", F.row_number().over(W.partitionBy(*g).orderBy("__d", "__id"))).filter(F.col("__r") <= k)
        means = near.groupBy(*g).agg(F.avg("__known").alias(f"__m{i}"))
        same = F.lit(True)
        for c, d in zip(f, g, strict=True):
            same = same & F.col(c).eqNullSafe(F.col(d))
        result = result.join(means, same, "left").drop(*g)
    filled = {t: F.coalesce(F.col(f"__t{i}"), F.col(f"__m{i}")) for i, t in enumerate(targets)}
    return result.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def _near_on_line(points: DataFrame, x: str, need: int, total: int) -> DataFrame:
    """(a, b, d, n, kdist): of every point of a line those within its ``need``-th distance, points counted ``n`` times.

    Each of the ``need`` places on either side counts once at least, so no further ones
    are nearer.  Where rounding makes even those tie with it, all points are compared.
    """
    both = sliding(points, [x], need, need, lambda w: {"__near": F.collect_list(F.struct(F.col(x).alias("b"), "n")).over(w)})
    spread = F.array_sort(F.transform("__near", lambda p: F.struct(F.abs(F.col(x) - p["b"]).alias("d"), p["b"].alias("b"), p["n"].alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("d"))
    reach = F.aggregate("__near", start, lambda s, p: F.when(s["seen"] < need, F.struct((s["seen"] + p["n"]).alias("seen"), p["d"].alias("d"))).otherwise(s), lambda s: s["d"])
    # On a side that has ``need`` others the last of them must be out of reach.
    sides = [F.filter("__near", lambda p: p["b"] < F.col(x)), F.filter("__near", lambda p: p["b"] > F.col(x))]
    tied = F.lit(False)
    for side in sides:
        tied = tied | ((F.size(side) >= need) & (F.element_at(side, -1)["d"] <= F.col("kdist")))
    found = written(both.withColumn("__near", spread).withColumn("kdist", reach).withColumn("tied", tied), "lof-line")
    near = found.filter("not tied").select(F.col(x).alias("a"), "kdist", F.explode(F.filter("__near", lambda p: p["d"] <= F.col("kdist"))).alias("p"))
    near = near.select("a", "p.b", "p.d", "p.n", "kdist")
    rest = found.filter("tied").select(F.col(x).alias("a"), "kdist")
    n_rest = rest.count()
    if not n_rest:
        return near
    pairs = _pairs(rest, points.select(F.col(x).alias("b"), "n"), n_rest, total).withColumn("d", F.abs(F.col("a") - F.col("b"))).filter("d <= kdist")
    return near.union(pairs.select("a", "b", "d", "n", "kdist"))


def _near_in_space(points: DataFrame, x: Sequence[str], need: int, total: int) -> DataFrame:
    """The same of points with several coordinates (a and b are structs): all distances, twice."""
    a, b = points.select(F.struct(*x).alias("a")), points.select(F.struct(*x).alias("b"), "n")
    d = _distance([F.col(f"a.{c}") for c in x], [F.col(f"b.{c}") for c in x])
    pairs = _pairs(a, b, total, total).withColumn("d", d)
    order = W.partitionBy("a").orderBy("d", "b")
    ranked = pairs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= need)
    ranked = ranked.withColumn("seen", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    reach = written(ranked.filter(F.col("seen") >= need).groupBy("a").agg(F.min("d").alias("kdist")), "lof-reach")
    return _pairs(reach, b, total, total).withColumn("d", d).filter("d <= kdist").select("a", "b", "d", "n", "kdist")


def local_outlier_factor(df: DataFrame, columns: Sequence[str], k: int = 20, row_id: str | None = None, max_rows: int | None = None) -> DataFrame:
    """Adds ``lof``: mean density of a row's neighbourhood over its own; NaN for rows with a gap.

    The neighbourhood holds all rows, the row itself among them, within the distance
    of the k-th other; ties stay.  Rows with the same values count as one point, as often
    as they occur; where all of a neighbourhood are equal its density is infinite.  One
    column is looked through in its order; of more, all distances of points are needed.
    Over ``max_rows`` rows is an error.  ``row_id`` isn't needed.
    """
    x = [f"__x{i}" for i in range(len(columns))]
    rows = df.withColumns({n: number(df, c) for n, c in zip(x, columns, strict=True)})
    whole = rows.select(*x)
    for n in x:
        whole = whole.filter(F.col(n).isNotNull())
    points = written(whole.groupBy(*x).agg(F.count(F.lit(1)).alias("n")), "lof-points")
    m, total = points.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if max_rows is not None and m > max_rows:
        raise ValueError(f"{m} rows; at most {max_rows}")
    need = max(1, min(k, m - 1) + 1)
    near = written(_near_on_line(points, x[0], need, total) if len(x) == 1 else _near_in_space(points, x, need, total), "lof-near")
    reach = near.groupBy("a").agg(F.first("kdist").alias("kb"))
    spread = near.join(reach.withColumnRenamed("a", "b"), "b")
    held, sum_ = F.sum("n"), F.sum(F.col("n") * F.greatest("kb", "d"))
    density = written(spread.groupBy("a").agg(F.when(sum_ == 0, F.lit(float("inf"))).otherwise(held / sum_).alias("lrd")), "lof-density")
    around = near.join(density.select(F.col("a").alias("b"), F.col("lrd").alias("lb")), "b").groupBy("a").agg((F.sum(F.col("n") * F.col("lb")) / F.sum("n")).alias("around"))
    factor = around.join(density, "a").select("a", F.try_divide("around", "lrd").alias("lof"))
    factor = factor.select(*[(F.col("a") if len(x) == 1 else F.col(f"a.{n}")).alias(n) for n in x], "lof")
    return rows.join(factor, x, "left").select(*df.columns, F.coalesce("lof", F.lit(float("nan"))).alias("lof"))
