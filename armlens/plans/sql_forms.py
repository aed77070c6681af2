"""The two core aggregates as SQL over any source relation.

``{source}`` is bound by Spark to a DataFrame, so the statements read a table,
a view or a file scan alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.columns import quoted
from ..operators.suffstats import complete_text
from ..spec import ExperimentSpec


def sufficient_stats_statement(spec: ExperimentSpec) -> str:
    """Counts, outcome sums and feature-outcome products per arm (no feature-feature terms).

    The same rows count as in the DataFrame form: none with a NULL or NaN in a used column.
    """
    y = quoted(spec.metric)
    columns = ["COUNT(*) AS n", f"SUM({y}) AS sum_y", f"SUM({y} * {y}) AS sum_yy"]
    if spec.post_covariate:
        x = quoted(spec.post_covariate)
        columns += [f"SUM({x}) AS sum_xn", f"SUM({x} * {x}) AS sum_xnxn", f"SUM({y} * {x}) AS sum_yxn"]
    if spec.exposure:
        columns.append(f"SUM({quoted(spec.exposure)}) AS sum_exposure")
    for f in spec.features:
        x = quoted(f)
        columns += [f"SUM({x}) AS {quoted(f'sum_{f}')}", f"SUM({x} * {y}) AS {quoted(f'sum_{f}_y')}"]
    group = ", ".join(map(quoted, [*spec.keys, spec.arm]))
    body = ",\n       ".join(columns)
    return (f"SELECT {group},\n       {body}\nFROM {{source}}\nWHERE {complete_text(spec)}\n"
            f"GROUP BY {group}\nORDER BY {group}")


def sufficient_stats_sql(df: DataFrame, spec: ExperimentSpec) -> DataFrame:
    return df.sparkSession.sql(sufficient_stats_statement(spec), source=df)


def balance_statement(spec: ExperimentSpec) -> str:
    """Standardised mean differences as one statement: one aggregate, then unpivoted."""
    stats = ",\n         ".join(
        f"AVG({quoted(f)}) FILTER (WHERE {quoted(spec.arm)} = {v}) AS {quoted(f'm{v}_{f}')}, "
        f"VAR_SAMP({quoted(f)}) FILTER (WHERE {quoted(spec.arm)} = {v}) AS {quoted(f'v{v}_{f}')}"
        for f in spec.features
        for v in (1, 0)
    )
    rows = ", ".join(
        "'" + f.replace("'", "\\'") + "', " + ", ".join(quoted(f"{s}_{f}") for s in ("m1", "m0", "v1", "v0"))
        for f in spec.features
    )
    keys = ", ".join(map(quoted, spec.keys))
    lead = f"{keys}, " if keys else ""
    group = f"\n  GROUP BY {keys}" if keys else ""
    return f"""WITH arm_stats AS (
  SELECT {lead}{stats}
  FROM {{source}}
  WHERE {complete_text(spec)}{group}
), features AS (
  SELECT {lead}stack({len(spec.features)}, {rows}) AS (feature, m1, m0, v1, v0) FROM arm_stats
)
SELECT {lead}feature, m1 - m0 AS difference,
       try_divide(m1 - m0, SQRT((v1 + v0) / 2)) AS smd
FROM features
ORDER BY {lead}ABS(smd) DESC"""


def balance_sql(df: DataFrame, spec: ExperimentSpec) -> DataFrame:
    return df.sparkSession.sql(balance_statement(spec), source=df)
