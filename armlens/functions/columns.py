"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL, not an error, on a zero denominator."""
    return F.try_divide(numerator, denominator)


def above_zero(column: Column) -> Column:
    """The value when it is positive, else NULL; guards logs and denominators."""
    return F.when(column > 0, column)


def quoted(name: str) -> str:
    """A column name as a SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def expressions(items: Mapping[str, str]) -> list[Column]:
    """SQL text per output name as columns; one call each, which matters for wide tables."""
    return [F.expr(f"{text} AS {quoted(name)}") for name, text in items.items()]


def packed_gram(features: Sequence[str]) -> Column:
    """Upper triangle of [1, f]'[1, f], row by row, from flat cell columns."""
    names = [f"sum_{f}" for f in features]
    names += [f"sum_{a}_{b}" for i, a in enumerate(features) for b in features[i:]]
    return F.expr(f"array(CAST(n AS DOUBLE), {', '.join(map(quoted, names))})")


def packed_rhs(features: Sequence[str]) -> Column:
    """[1, f]'y from flat cell columns."""
    names = ["sum_y"] + [f"sum_{f}_y" for f in features]
    return F.expr(f"array({', '.join(map(quoted, names))})")


def linear_score(coef: str, features: Sequence[str]) -> Column:
    """intercept + sum(coef[i] * feature[i]) as plain arithmetic, so it stays in codegen.

    ``features`` are SQL texts; ``coef`` names an array column, intercept first.
    """
    terms = [f"get({quoted(coef)}, {i}) * {text}" for i, text in enumerate(features, start=1)]
    return F.expr(" + ".join([f"get({quoted(coef)}, 0)", *terms]))


def stack_rows(frame: DataFrame, keep: Sequence[str], rows: Sequence[Column]) -> DataFrame:
    """One output row per struct in ``rows``: a narrow unpivot without a join or union."""
    return frame.select(*keep, F.explode(F.array(*rows)).alias("_row")).select(*keep, "_row.*")


def on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-key tables on ``keys``, where NULL is a key like any other.

    Without keys ``right`` has one row, which is attached as a scalar: more rows
    are an error instead of a silent product, and none gives NULLs.
    """
    others = [c for c in right.columns if c not in keys]
    if not keys:
        if not others:
            return left
        row = right.select(F.struct(*[F.col(quoted(c)) for c in others]).alias("_row")).scalar()
        held = left.withColumn("_row", row)
        return held.select(*[F.col(quoted(c)) for c in left.columns], *[F.col(f"_row.{quoted(c)}") for c in others])
    named = right.select(*[F.col(quoted(k)).alias(f"_key_{k}") for k in keys], *[F.col(quoted(c)) for c in others])
    same = F.lit(True)
    for i, k in enumerate(keys):
        equal = F.col(quoted(k)).eqNullSafe(F.col(quoted(f"_key_{k}")))
        same = same & equal if i else equal
    return left.join(named, same, how).drop(*[f"_key_{k}" for k in keys])
