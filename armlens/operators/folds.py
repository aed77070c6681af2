"""Deterministic cross-fitting folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import ExperimentSpec

FOLD = "_fold"


def fold_column(spec: ExperimentSpec, hash_columns: Sequence[str] | None = None) -> Column:
    """Fold number of a row in [0, n_folds).

    A named fold column is used as given. Otherwise the row's features are
    hashed, so identical rows share a fold and the fold does not depend on the
    arm or the outcome; pass ``hash_columns`` to hash something else.
    """
    if spec.fold:
        return F.col(spec.fold).cast("int")
    names = list(hash_columns or spec.features)
    return F.pmod(F.hash(*[F.col(c) for c in names]), F.lit(spec.n_folds))


def with_fold(
    df: DataFrame, spec: ExperimentSpec, hash_columns: Sequence[str] | None = None
) -> DataFrame:
    return df.withColumn(FOLD, fold_column(spec, hash_columns))
