"""Principal components, singular values and eigenvectors, from one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.stats import complete


@dataclass(frozen=True)
class PCA:
    """Loadings (a row a column, a column a component), eigenvalues, and the scores PC1, PC2, ..."""

    loadings: np.ndarray
    variances: np.ndarray
    scores: DataFrame


@dataclass(frozen=True)
class SVD:
    """U as a table (U1, U2, ...), singular values from the largest, and V transposed."""

    u: DataFrame
    s: np.ndarray
    vt: np.ndarray


@dataclass(frozen=True)
class Eigen:
    value: float
    vector: np.ndarray


def dot(a: Sequence[float], b: Sequence[float]) -> float:
    return float(np.dot(a, b))


def transpose(matrix: Sequence[Sequence[float]]) -> list[list[float]]:
    return [list(r) for r in zip(*matrix, strict=True)]


def covariance(matrix: Sequence[Sequence[float]]) -> np.ndarray:
    """Sample covariance of the columns."""
    return np.atleast_2d(np.cov(np.asarray(matrix, dtype=float), rowvar=False))


def eigen_decomposition(matrix: Sequence[Sequence[float]]) -> list[Eigen]:
    """Eigenpairs of a symmetric matrix, largest value first, the largest entry of a vector positive."""
    values, vectors = np.linalg.eigh(np.asarray(matrix, dtype=float))
    return [Eigen(float(values[k]), _signed(vectors[:, k])) for k in np.argsort(values)[::-1]]


def singular_values(matrix: Sequence[Sequence[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """U, S and V transposed of a small matrix."""
    return np.linalg.svd(np.asarray(matrix, dtype=float), full_matrices=False)


def _signed(v: np.ndarray) -> np.ndarray:
    """The direction in which the first clearly nonzero entry is positive."""
    lead = next((x for x in v if abs(x) > 1e-9), 1.0)
    return v if lead > 0 else -v


def _combined(columns: Sequence[str], weights: np.ndarray) -> Column:
    total = F.lit(0.0)
    for c, w in zip(columns, weights.tolist(), strict=True):
        total = total + F.col(c) * F.lit(w)
    return total


def pca(df: DataFrame, columns: Sequence[str], center: bool = True, scale: bool = False, n_components: int | None = None) -> PCA:
    """Components of the complete rows, by sample covariance; scaling is by population deviation.

    Without centring the scores are not shifted.  Each component's first nonzero loading is positive.
    """
    rows, p = complete(df, columns), len(columns)
    x = [f"x{i}" for i in range(p)]
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.avg(c).alias(f"m_{c}") for c in x] + [F.stddev_pop(c).alias(f"s_{c}") for c in x]
    sums += [F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    row = rows.agg(*sums).first()
    if row["n"] < 2:
        raise ValueError("principal components need two complete rows")
    by = np.array([(row[f"s_{c}"] or 1.0) if scale else 1.0 for c in x])
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / np.outer(by, by)
    pairs = eigen_decomposition(cov)[: n_components or p]
    loadings = np.stack([_signed(e.vector) for e in pairs], axis=1)
    shifted = rows.select(*[((F.col(c) - F.lit(row[f"m_{c}"] if center else 0.0)) / F.lit(float(b))).alias(c) for c, b in zip(x, by, strict=True)])
    scores = shifted.select(*[_combined(x, loadings[:, k]).alias(f"PC{k + 1}") for k in range(len(pairs))])
    return PCA(loadings, np.array([e.value for e in pairs]), scores)


def svd(df: DataFrame, columns: Sequence[str]) -> SVD:
    """Of the complete rows as a tall matrix, by its Gram matrix; columns of U for vanishing values are 0."""
    rows, p = complete(df, columns), len(columns)
    x = [f"x{i}" for i in range(p)]
    row = rows.agg(*[F.sum(F.col(x[i]) * F.col(x[j])).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
    pairs = eigen_decomposition(gram)
    s = np.sqrt(np.maximum([e.value for e in pairs], 0.0))
    v = np.stack([_signed(e.vector) for e in pairs], axis=1)
    small = s[0] * 1e-8 if len(s) else 0.0
    u = rows.select(*[_combined(x, v[:, k] / s[k] if s[k] > small else np.zeros(p)).alias(f"U{k + 1}") for k in range(p)])
    return SVD(u, s, v.T)
