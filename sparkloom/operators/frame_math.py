"""The operators as methods of a frame, by column label, in the order of its rows.

Methods that give a value for each row return the frame with a column added; rows
without a number in the column are left out where the operator leaves them out.
Methods that give a new table return a frame in that table's order, and statistics
return what their operators return.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import missing
from sparkloom.functions.aggs import Aggregate
from sparkloom.operators import group, linalg, outliers, signal, stats, timeseries, weighted, windows

if TYPE_CHECKING:
    from sparkloom.operators.frame import Frame

ORD, IX = "__ord", "__ix"
ORDER = [ORD]


class FrameMath:
    def _grown(self, df: DataFrame, *names: str, label: Any = None) -> Frame:
        """``df`` as a frame with the columns ``names`` after its own."""
        width = len(self.labels)
        kept = df.select(ORD, IX, *self.names, *[F.col(n).alias(f"c{width + j}") for j, n in enumerate(names)])
        labels = [label] if label is not None else list(names)
        return self._new(self._renumbered(kept), [*self.labels, *labels])

    def _made(self, df: DataFrame, order_by: Sequence[str]) -> Frame:
        return type(self).from_table(df, order_by)

    def _named(self, *labels: Any) -> DataFrame:
        """The columns under their labels as text, with the row number and label."""
        return self.df.select(ORD, IX, *[F.col(self.name(x)).alias(str(x)) for x in labels])

    # Groups and shapes

    def group_by(
        self, key: Any, value: Any, aggregate: Aggregate | None = None, transform: Aggregate | None = None, filter: Aggregate | None = None, keep: Callable[[Column], Column] | None = None  # noqa: A002
    ) -> Frame:
        """One of: a row a group in order of first appearance, all rows with their group's value, or rows of groups that ``keep``, group by group."""
        k, v = self.name(key), self.name(value)
        if aggregate is not None:
            rows = self._named(key, value)
            first = rows.groupBy(str(key)).agg(F.min(ORD).alias("__first"))
            found = group.group_aggregate(rows, str(key), str(value), aggregate).join(first, str(key))
            return self._made(found, ["__first"]).drop("__first", axis=1)
        if transform is not None:
            return self._grown(group.group_transform(self.df, k, v, transform), f"{v}_transformed", label=f"{value}_transformed")
        if filter is None or keep is None:
            raise ValueError("pass aggregate, transform, or filter with keep")
        rows = group.group_filter(self.df, k, v, filter, keep)
        first = rows.groupBy(F.col(k).alias("__k")).agg(F.min(ORD).alias("__first"))
        ordered = rows.join(first, rows[k].eqNullSafe(first["__k"])).withColumn("__was", F.struct("__first", ORD)).drop("__k", "__first", ORD)
        from sparkloom.plans import with_ordinal

        return self._new(with_ordinal(ordered, ["__was"], ORD).drop("__was"))

    def pivot_table(self, index: Any, columns: Any, values: Any, how: Aggregate = "sum") -> Frame:
        return self._made(group.pivot_table(self._named(index, columns, values), str(index), str(columns), str(values), how), [str(index)])

    def melt(self, id_vars: Sequence[Any], value_vars: Sequence[Any], var_name: str = "variable", value_name: str = "value") -> Frame:
        """Row by row, and within a row in the order of ``value_vars``."""
        rows = self._named(*id_vars, *value_vars)
        long = group.melt(rows, [ORD, *map(str, id_vars)], list(map(str, value_vars)), var_name, value_name)
        place = F.array_position(F.array(*[F.lit(str(v)) for v in value_vars]), F.col(var_name))
        return self._made(long.withColumn("__place", place).withColumnRenamed(ORD, "__row"), ["__row", "__place"]).drop("__row", axis=1).drop("__place", axis=1)

    def unstack(self, index: Any, var: Any, value: Any) -> Frame:
        rows = self._named(index, var, value)
        first = rows.groupBy(str(index)).agg(F.min(ORD).alias("__first"))
        wide = group.unstack(rows, str(index), str(var), str(value), ORDER)
        return self._made(wide.join(first, str(index)), ["__first"]).drop("__first", axis=1)

    # Missing values and single numbers

    def filter_nulls(self, label: Any, skip: bool = True) -> Frame:
        """Rows without a number dropped, or kept with 0.0."""
        n = self.name(label)
        return self._new(self._renumbered(missing.filter_missing(self.df, n))) if skip else self._new(missing.zero_filled(self.df, n))

    def count_nulls(self, label: Any) -> int:
        return missing.count_missing(self.df, self.name(label)).first()[0]

    def count_zeros(self, label: Any, zero_values: Collection = (0,)) -> int:
        return missing.count_zeros(self.df, self.name(label), zero_values).first()["n"]

    def stats(self, label: Any) -> dict[str, float]:
        """total, mean, smallest and largest of a column, in one pass."""
        return group.column_stats(self.df, self.name(label)).first().asDict()

    def sum(self, label: Any) -> float:
        return self.stats(label)["total"]

    def mean(self, label: Any) -> float:
        return self.stats(label)["mean"]

    def max(self, label: Any) -> float:
        return self.stats(label)["largest"]

    def min(self, label: Any) -> float:
        return self.stats(label)["smallest"]

    # Windows

    def rolling_sum(self, label: Any, width: int) -> Frame:
        return self._grown(windows.rolling_sum(self.df, self.name(label), width, ORDER), "rolling_sum")

    def rolling_mean(self, label: Any, width: int) -> Frame:
        return self._grown(windows.rolling_mean(self.df, self.name(label), width, ORDER), "rolling_mean")

    def rolling_std(self, label: Any, width: int) -> Frame:
        return self._grown(windows.rolling_std(self.df, self.name(label), width, ORDER), "rolling_std")

    def rolling_apply(self, label: Any, width: int, how: Aggregate) -> Frame:
        return self._grown(windows.rolling_apply(self.df, self.name(label), width, how, ORDER), "rolling_apply")

    def rolling_mad(self, label: Any, width: int) -> Frame:
        n = self.name(label)
        return self._grown(windows.rolling_mad(self.df, n, width, ORDER), f"{n}_rollingMAD", label=f"{label}_rollingMAD")

    def expanding_min(self, label: Any) -> Frame:
        return self._grown(windows.expanding_min(self.df, self.name(label), ORDER), "expanding_min")

    def expanding_max(self, label: Any) -> Frame:
        return self._grown(windows.expanding_max(self.df, self.name(label), ORDER), "expanding_max")

    def expanding_mean(self, label: Any) -> Frame:
        return self._grown(windows.expanding_mean(self.df, self.name(label), ORDER), "expanding_mean")

    def expanding_var(self, label: Any, ddof: int = 1) -> Frame:
        return self._grown(windows.expanding_var(self.df, self.name(label), ORDER, ddof=ddof), "expanding_var")

    def ewm_mean(self, label: Any, alpha: float) -> Frame:
        return self._grown(windows.ewm_mean(self.df, self.name(label), alpha, ORDER), "ewm_mean")

    def ewm_var(self, label: Any, alpha: float) -> Frame:
        return self._grown(windows.ewm_var(self.df, self.name(label), alpha, ORDER), "ewm_var")

    def ewm_cov(self, x: Any, y: Any, alpha: float, lagged_mean: bool = False) -> Frame:
        return self._grown(windows.ewm_cov(self.df, self.name(x), self.name(y), alpha, ORDER, lagged_mean=lagged_mean), "ewm_cov")

    def ewm_corr(self, x: Any, y: Any, alpha: float) -> Frame:
        return self._grown(windows.ewm_corr(self.df, self.name(x), self.name(y), alpha, ORDER), "ewm_corr")

    # Time series; the row labels are the times

    def resample(self, label: Any, seconds: float, how: Aggregate = "mean", interpolation: str = "linear") -> Frame:
        found = timeseries.resample(self._named(label), IX, str(label), seconds, how, interpolation)
        return type(self).from_table(found, [IX], index=IX)

    def autocorrelation(self, label: Any, max_lag: int) -> list[float]:
        return timeseries.autocorrelation(self.df, self.name(label), max_lag, ORDER)

    def partial_autocorrelation(self, label: Any, max_lag: int) -> list[float]:
        return timeseries.partial_autocorrelation(self.df, self.name(label), max_lag, ORDER)

    def seasonal_decompose(self, label: Any, period: int) -> Frame:
        return self._grown(timeseries.seasonal_decompose(self.df, self.name(label), period, ORDER), "trend", "seasonal", "residual")

    def exponential_smoothing(self, label: Any, period: int = 1, method: str = "ses", **how: Any) -> Frame:
        names = {"ses": ["level"], "holt": ["level", "trend"], "hw": ["level", "trend", "seasonal"]}.get(method, [])
        return self._grown(timeseries.exponential_smoothing(self.df, self.name(label), period, ORDER, method=method, **how), "observed", *names, "fitted")

    def interpolate(self, label: Any, method: timeseries.Method | str = "polynomial", degree: int = 3, precision: int | None = None) -> Frame:
        """Along the row labels, which are numbers or times."""
        return self._new(timeseries.interpolate(self.df, IX, self.name(label), (), method, degree, precision).select(ORD, IX, *self.names))

    # Outliers and gaps

    def outlier_iqr(self, label: Any, k: float = 1.5) -> Frame:
        n = self.name(label)
        return self._grown(outliers.outlier_iqr(self.df, n, k), f"{n}_outlierIQR", label=f"{label}_outlierIQR")

    def outlier_zscore(self, label: Any, threshold: float = 3.0) -> Frame:
        n = self.name(label)
        return self._grown(outliers.outlier_zscore(self.df, n, threshold), f"{n}_outlierZ", label=f"{label}_outlierZ")

    def local_outlier_factor(self, labels: Sequence[Any], k: int = 20) -> Frame:
        return self._grown(outliers.local_outlier_factor(self.df, [self.name(x) for x in labels], k, ORD), "lof")

    def knn_impute(self, features: Sequence[Any], targets: Sequence[Any], k: int = 5) -> Frame:
        return self._new(outliers.knn_impute(self.df, [self.name(x) for x in features], [self.name(x) for x in targets], k, ORD))

    # Statistics, matrices and signals

    def covariance_matrix(self, labels: Sequence[Any]) -> DataFrame:
        return stats.covariance_matrix(self._named(*labels), [str(x) for x in labels])

    def t_test(self, by: Any, value: Any) -> stats.TTest:
        return stats.t_test(self.df, self.name(by), self.name(value))

    def anova(self, by: Any, value: Any) -> stats.Anova:
        return stats.anova(self.df, self.name(by), self.name(value))

    def chi_square(self, x: Any, y: Any) -> stats.ChiSquare:
        return stats.chi_square(self.df, self.name(x), self.name(y))

    def bootstrap(self, label: Any, statistic: Aggregate = "mean", n_boot: int = 1000, seed: int = 0) -> stats.Bootstrap:
        return stats.bootstrap(self.df, self.name(label), statistic, n_boot, seed)

    def pca(self, labels: Sequence[Any], center: bool = True, scale: bool = False) -> linalg.PCA:
        return linalg.pca(self.df, [self.name(x) for x in labels], center, scale)

    def svd(self, labels: Sequence[Any]) -> linalg.SVD:
        return linalg.svd(self.df, [self.name(x) for x in labels])

    def fft(self, label: Any) -> DataFrame:
        return signal.fft(self._named(label), IX, str(label))

    def convolve(self, x: Any, y: Any) -> DataFrame:
        return signal.convolve(self.df, self.name(x), self.name(y), ORDER)

    def cross_correlate(self, x: Any, y: Any) -> DataFrame:
        return signal.cross_correlate(self.df, self.name(x), self.name(y), ORDER)

    def weighted_quantile(self, value: Any, weight: Any, qs: Sequence[float] = (0.5,)) -> DataFrame:
        return weighted.weighted_quantile(self.df, self.name(value), self.name(weight), qs)

    def weighted_histogram(self, value: Any, weight: Any, bins: int | None = None) -> DataFrame:
        return weighted.weighted_histogram(self.df, self.name(value), self.name(weight), bins)
