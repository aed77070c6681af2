"""Small dense solves on result-sized tables.

Each row carries one packed upper triangle (row-major, intercept first), so a
million segments are a million rows of a vectorised UDF: numpy factors a whole
Arrow batch of matrices in one call and no group is ever gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

# Eigenvalues of the correlation-scaled matrix under this share of the largest
# one are treated as exact collinearity.
RANK_TOLERANCE = 1e-12


def _layout(packed_length: int) -> tuple[int, np.ndarray]:
    size = int((np.sqrt(8.0 * packed_length + 1.0) - 1.0) / 2.0)
    index = np.zeros((size, size), dtype=int)
    upper = np.triu_indices(size)
    index[upper] = np.arange(packed_length)
    index[(upper[1], upper[0])] = np.arange(packed_length)
    return size, index


def _unpack(packed: np.ndarray) -> np.ndarray:
    _, index = _layout(packed.shape[1])
    return packed[:, index]


def _complete(*columns: pd.Series) -> np.ndarray:
    """Rows where every array column is present and finite."""
    keep = np.ones(len(columns[0]), dtype=bool)
    for column in columns:
        for i, value in enumerate(column):
            if value is None or (np.isscalar(value) and value != value):
                keep[i] = False
            elif not np.isscalar(value):
                array = np.asarray(value, dtype=float)
                keep[i] = keep[i] and array.size > 0 and bool(np.isfinite(array).all())
    return keep


def _stack(column: pd.Series, keep: np.ndarray) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column[keep]])


def _scatter(length: int, keep: np.ndarray, frame: pd.DataFrame) -> pd.DataFrame:
    frame.index = np.flatnonzero(keep)
    return frame.reindex(range(length)).astype(object).where(lambda f: f.notna(), None)


def _centred(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = gram[:, 0, 0]
    mean = gram[:, 0, 1:] / n[:, None]
    return n, mean, gram[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]


def _scaled_pinv(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pseudo-inverse after scaling to unit diagonal, with the scales and the rank."""
    diagonal = np.diagonal(matrix, axis1=1, axis2=2)
    usable = diagonal > 0
    scale = np.where(usable, 1.0 / np.sqrt(np.where(usable, diagonal, 1.0)), 0.0)
    scaled = matrix * scale[:, :, None] * scale[:, None, :]
    inverse = np.linalg.pinv(scaled, rcond=RANK_TOLERANCE, hermitian=True)
    rank = np.linalg.matrix_rank(scaled, tol=RANK_TOLERANCE * matrix.shape[1], hermitian=True)
    return inverse, scale, rank


def _solve_centred(cross: np.ndarray, cross_y: np.ndarray, total: np.ndarray):
    """Slopes, residual sum of squares, R-squared and rank of centred normal equations."""
    inverse, scale, rank = _scaled_pinv(cross)
    slope = scale * np.einsum("bij,bj->bi", inverse, scale * cross_y)
    # Explained sum of squares written as a quadratic form in the fitted slope.
    explained = np.einsum("bi,bij,bj->b", slope, cross, slope)
    residual = np.maximum(total - explained, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = np.where(total > 0, 1.0 - residual / total, 0.0)
    return slope, residual, r2, rank


def _fit_frame(coef, ssr, r2, rank) -> pd.DataFrame:
    return pd.DataFrame({"coef": list(coef), "ssr": ssr, "r2": r2, "rank": rank})


def _no_fit() -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype=object) for c in ("coef", "ssr", "r2", "rank")})


def fit_gram(gram: np.ndarray, rhs: np.ndarray, yty: np.ndarray):
    """Least squares with intercept for a stack of normal equations.

    Solved on the centred, unit-diagonal system, so features of very different
    magnitude do not fall below the rank cut-off. Collinear directions and
    constant features get the minimum-norm (scaled) solution.
    """
    n, mean, cross = _centred(gram)
    y_mean = rhs[:, 0] / n
    cross_y = rhs[:, 1:] - n[:, None] * mean * y_mean[:, None]
    slope, residual, r2, rank = _solve_centred(cross, cross_y, yty - n * y_mean**2)
    intercept = y_mean - np.einsum("bi,bi->b", slope, mean)
    return np.concatenate([intercept[:, None], slope], axis=1), residual, r2, rank


FIT_SCHEMA = StructType([
    StructField("coef", ArrayType(DoubleType())),
    StructField("ssr", DoubleType()),
    StructField("r2", DoubleType()),
    StructField("rank", IntegerType()),
])
SCORE_SCHEMA = StructType([StructField(c, DoubleType()) for c in ("sum_x", "sum_xx", "sum_yx")])
DISTANCE_SCHEMA = StructType([StructField("t2", DoubleType()), StructField("rank", IntegerType())])


@F.pandas_udf(FIT_SCHEMA)
def least_squares(gram: pd.Series, rhs: pd.Series, yty: pd.Series) -> pd.DataFrame:
    """OLS of y on [1, features] from X'X (packed), X'y and y'y."""
    keep = _complete(gram, rhs, yty)
    if not keep.any():
        return _scatter(len(keep), keep, _no_fit())
    fit = fit_gram(_unpack(_stack(gram, keep)), _stack(rhs, keep), yty[keep].to_numpy(dtype=float))
    return _scatter(len(keep), keep, _fit_frame(*fit))


@F.pandas_udf(FIT_SCHEMA)
def least_squares_within(
    gram_t: pd.Series, rhs_t: pd.Series, yty_t: pd.Series,
    gram_c: pd.Series, rhs_c: pd.Series, yty_c: pd.Series,
) -> pd.DataFrame:
    """One slope vector fitted to two arms that are each centred on their own means."""
    keep = _complete(gram_t, rhs_t, yty_t, gram_c, rhs_c, yty_c)
    if not keep.any():
        return _scatter(len(keep), keep, _no_fit())
    cross, cross_y, total = 0.0, 0.0, 0.0
    for gram, rhs, yty in ((gram_t, rhs_t, yty_t), (gram_c, rhs_c, yty_c)):
        b = _stack(rhs, keep)
        n, mean, own = _centred(_unpack(_stack(gram, keep)))
        y_mean = b[:, 0] / n
        cross = cross + own
        cross_y = cross_y + b[:, 1:] - n[:, None] * mean * y_mean[:, None]
        total = total + yty[keep].to_numpy(dtype=float) - n * y_mean**2
    slope, residual, r2, rank = _solve_centred(cross, cross_y, total)
    coef = np.concatenate([np.zeros((len(slope), 1)), slope], axis=1)
    return _scatter(len(keep), keep, _fit_frame(coef, residual, r2, rank))


@F.pandas_udf(SCORE_SCHEMA)
def linear_score_sums(coef: pd.Series, gram: pd.Series, rhs: pd.Series) -> pd.DataFrame:
    """Sums of a linear score over the rows behind a gram matrix.

    For s = coef . [1, f] these are sum(s), sum(s*s) and sum(y*s): a linear or
    quadratic form in sums already held, so no second pass over the rows.
    """
    keep = _complete(coef, gram, rhs)
    names = ("sum_x", "sum_xx", "sum_yx")
    if not keep.any():
        return _scatter(len(keep), keep, pd.DataFrame({c: pd.Series(dtype=object) for c in names}))
    beta, x, y = _stack(coef, keep), _unpack(_stack(gram, keep)), _stack(rhs, keep)
    out = pd.DataFrame({
        "sum_x": np.einsum("bi,bi->b", beta, x[:, 0, :]),
        "sum_xx": np.einsum("bi,bij,bj->b", beta, x, beta),
        "sum_yx": np.einsum("bi,bi->b", beta, y),
    })
    return _scatter(len(keep), keep, out)


@F.pandas_udf(DISTANCE_SCHEMA)
def hotelling_distance(gram_t: pd.Series, gram_c: pd.Series) -> pd.DataFrame:
    """Two-sample Hotelling T-squared from the two arms' gram matrices."""
    keep = _complete(gram_t, gram_c)
    if not keep.any():
        return _scatter(len(keep), keep,
                        pd.DataFrame({c: pd.Series(dtype=object) for c in ("t2", "rank")}))
    n_t, mean_t, cross_t = _centred(_unpack(_stack(gram_t, keep)))
    n_c, mean_c, cross_c = _centred(_unpack(_stack(gram_c, keep)))
    total = n_t + n_c
    with np.errstate(divide="ignore", invalid="ignore"):
        pooled = (cross_t + cross_c) / (total - 2.0)[:, None, None]
    pooled = np.nan_to_num(pooled, nan=0.0, posinf=0.0, neginf=0.0)
    inverse, scale, rank = _scaled_pinv(pooled)
    gap = scale * (mean_t - mean_c)
    t2 = n_t * n_c / total * np.einsum("bi,bij,bj->b", gap, inverse, gap)
    return _scatter(len(keep), keep, pd.DataFrame({"t2": t2, "rank": rank}))
