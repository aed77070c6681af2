"""The named queries restated as plain SQL, straight from the rows.

Nothing here shares code with the operators: means, variances and slopes come
from the engine's own aggregates over rows where the operators use sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..spec import ExperimentSpec
from .catalog import (
    AA_REPLICATES, FEATURES, FEW, N_LOOKS, RANDOM_FACTOR, RANDOM_PRIME, SAMPLE_SIZE, sum_digits,
)

# Normal quantiles at 0.975, 0.8, 0.9995 and 0.505.
Z = "1.9599639845400536"
Z_POWER = "0.8416212335729144"
Z_SRM = "3.2905267314919255"
Z_CLOSE = "0.012533469508069278"
Z_IMBALANCE = Z_SRM

TREATED = "l_orderkey % 20 < 17"
COLUMNS = {
    "f0": "l_quantity::DOUBLE", "f1": "l_extendedprice::DOUBLE", "f2": "l_discount::DOUBLE",
    "f3": "l_tax::DOUBLE", "f4": "l_linenumber::DOUBLE", "f5": "o_totalprice::DOUBLE",
    "f6": "c_acctbal::DOUBLE", "f7": "p_size::DOUBLE", "f8": "p_retailprice::DOUBLE",
    "f9": "s_acctbal::DOUBLE", "f10": "date_diff('day', o_orderdate, l_shipdate)::DOUBLE",
    "f11": "c_nationkey::DOUBLE",
    "treatment": f"({TREATED})::INT",
    "visit": "(l_returnflag IN ('R', 'A'))::INT",
    "conversion": f"(l_returnflag = 'R' AND NOT (NOT ({TREATED}) AND l_partkey % 5 = 0))::INT",
    "exposure": f"({TREATED} AND l_linestatus = 'F')::INT",
    "fold": "(l_partkey % 2)::INT", "fold5": "(l_partkey % 5)::INT",
    "segment": "o_orderpriority", "segment_null": "nullif(o_orderpriority, '1-URGENT')", "market": "c_mktsegment",
    "treatment_skewed": f"({TREATED} AND l_quantity <= 45)::INT",
}


def log(name: str = "log") -> str:
    """CTE with every column of the experiment log."""
    columns = ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items())
    return (
        f"{name} AS (SELECT {columns} FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        "JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey "
        "JOIN supplier ON l_suppkey = s_suppkey)"
    )


COARSE_COLUMNS = "treatment, conversion, visit, exposure, f0, f2, f3"
ASSIGNED = (
    "assigned AS (SELECT * EXCLUDE (treatment), 'designed' AS assignment, treatment FROM log "
    "UNION ALL SELECT * EXCLUDE (treatment), 'skewed', treatment_skewed FROM log)"
)
COLLAPSED = (
    f"collapsed AS (SELECT {COARSE_COLUMNS}, count(*)::BIGINT AS multiplicity FROM log "
    f"GROUP BY ALL)"
)
COLLAPSED_16 = (
    f"collapsed AS (SELECT {', '.join(FEATURES)}, treatment, conversion, visit, exposure, "
    "count(*)::BIGINT AS multiplicity FROM log GROUP BY ALL)"
)
WEIGHTED = (
    "weighted AS (SELECT *, 'all' AS spec, multiplicity AS w FROM collapsed "
    "UNION ALL SELECT *, 'dedup', 1 FROM collapsed "
    "UNION ALL SELECT *, 'singleton', 1 FROM collapsed WHERE multiplicity = 1)"
)


def r(expression: str, alias: str, digits: int = 8) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {alias}"


def chi2_tail(x: str, df: str) -> str:
    """Upper tail of chi-square for a whole number of degrees of freedom, as a finite sum."""
    half = f"(CASE WHEN {df} % 2 = 1 THEN 0.5 ELSE 0 END)"
    terms = f"[pow({x} / 2, i + {half}) * exp(-{x} / 2) / gamma(i + {half} + 1) FOR i IN range({df} // 2)]"
    return f"CASE WHEN {df} % 2 = 1 THEN 1 - {central(f'sqrt({x})')} ELSE 0 END + coalesce(list_sum({terms}), 0)"


def central(z: str) -> str:
    """P(|Z| <= |z|) for a standard normal, by its power series; 1 to fifteen digits from 8 on."""
    x = f"greatest(abs({z}), 1e-300)"
    return (
        f"(CASE WHEN abs({z}) >= 8 THEN 1.0::DOUBLE ELSE 2 * list_sum([exp((2 * i + 1) * ln({x}) - {x} * {x} / 2 "
        "- (i + 1.5) * ln(2) - lgamma(i + 1.5)) FOR i IN range(200)]) END)"
    )


def two_sided(z: str) -> str:
    return f"(1 - {central(z)})"


def _keys(keys: Sequence[str]) -> str:
    return "".join(f"{k}, " for k in keys)


def _group(keys: Sequence[str], *more: str) -> str:
    names = [*keys, *more]
    return "GROUP BY " + ", ".join(names) if names else ""


def arms(source: str, keys: Sequence[str] = (), x: str | None = None) -> str:
    """CTEs ``a`` (moments per arm) and ``p`` (both arms side by side, plus pooled)."""
    moments = "count(*)::DOUBLE AS n, avg(conversion) AS my, var_samp(conversion) AS vy"
    whole = "count(*)::DOUBLE AS n"
    names = ["n", "my", "vy"]
    if x:
        moments += f", avg({x}) AS mx, var_samp({x}) AS vx, covar_samp(conversion, {x}) AS cyx"
        whole += (
            f", avg({x}) AS mx_p, var_samp({x}) AS vx_p, covar_samp(conversion, {x}) AS cyx_p, "
            f"var_samp(conversion) AS vy_p"
        )
        names += ["mx", "vx", "cyx"]
    exposure = ", avg(exposure) AS ex, sum(exposure) AS exn"
    names += ["ex", "exn"]
    picks = ", ".join(
        f"max({c}) FILTER (WHERE treatment = {v}) AS {c}_{s}"
        for c in names for v, s in ((1, "t"), (0, "c"))
    )
    k = _keys(keys)
    join = f"JOIN w USING ({', '.join(keys)})" if keys else "CROSS JOIN w"
    return (
        f"a AS (SELECT {k}treatment, {moments}{exposure} FROM {source} {_group(keys, 'treatment')}), "
        f"w AS (SELECT {k}{whole} FROM {source} {_group(keys)}), "
        f"s AS (SELECT {k}{picks} FROM a {_group(keys)}), "
        f"p AS (SELECT * FROM s {join})"
    )


# Estimators as (mean_t, var_t, mean_c, var_c) over the columns of p.
def _adjusted(theta_t: str, theta_c: str) -> tuple[str, str, str, str]:
    parts = []
    for arm, theta in (("t", theta_t), ("c", theta_c)):
        parts.append(f"my_{arm} - ({theta}) * (mx_{arm} - mx_p)")
        parts.append(
            f"vy_{arm} - 2 * ({theta}) * cyx_{arm} + ({theta}) * ({theta}) * vx_{arm}"
        )
    return tuple(parts)


THETA = "cyx_p / vx_p"
THETA_T, THETA_C = "cyx_t / vx_t", "cyx_c / vx_c"
ESTIMATORS = {
    "unadjusted": ("my_t", "vy_t", "my_c", "vy_c"),
    "cuped": _adjusted(THETA, THETA),
    "lin": _adjusted(THETA_T, THETA_C),
}
# Residual sum of squares of y on x within one sample with n, vy, cyx, vx.
_SSR = "(n_{a} - 1) * (vy_{a} - cyx_{a} * cyx_{a} / vx_{a})"
_WITHIN = "(((n_t - 1) * cyx_t + (n_c - 1) * cyx_c) / ((n_t - 1) * vx_t + (n_c - 1) * vx_c))"
_POOLED_VAR = "((n - 1) * (vy_p - cyx_p * cyx_p / vx_p) / (n - 3))"
_WITHIN_VAR = (
    f"(((n_t - 1) * vy_t + (n_c - 1) * vy_c"
    f" - {_WITHIN} * ((n_t - 1) * cyx_t + (n_c - 1) * cyx_c)) / (n - 3))"
)


def _ancova_form(theta_t: str, var_t: str, theta_c: str, var_c: str) -> tuple[str, str, str, str]:
    mean_t, _, mean_c, _ = _adjusted(theta_t, theta_c)
    return mean_t, var_t, mean_c, var_c


ANCOVA = {
    "ancova_pooled": _ancova_form(THETA, _POOLED_VAR, THETA, _POOLED_VAR),
    "ancova_within": _ancova_form(_WITHIN, _WITHIN_VAR, _WITHIN, _WITHIN_VAR),
    "ancova_lin": _ancova_form(
        THETA_T, f"{_SSR.format(a='t')} / (n_t - 2)", THETA_C, f"{_SSR.format(a='c')} / (n_c - 2)"
    ),
}


def effect_rows(forms: dict, keys: Sequence[str] = (), extra: str = "") -> str:
    """CTE ``e``: one row per (keys, estimator) with the full inference, unrounded."""
    k = _keys(keys)
    union = " UNION ALL ".join(
        f"SELECT {k}{extra}'{name}' AS estimator, n_t, n_c, {mt} AS mt, {vt} AS vt, {mc} AS mc, {vc} AS vc FROM p"
        for name, (mt, vt, mc, vc) in forms.items()
    )
    return (
        f"u AS ({union}), "
        "v AS (SELECT *, mt - mc AS d, sqrt(vt / n_t + vc / n_c) AS se, "
        "sqrt(vt / (n_t * mt * mt) + vc / (n_c * mc * mc)) AS lse FROM u), "
        f"e AS (SELECT *, d / se AS z, exp(ln(mt / mc) - {Z} * lse) - 1 AS rlo, "
        f"exp(ln(mt / mc) + {Z} * lse) - 1 AS rhi FROM v)"
    )


def effect_select(keys: Sequence[str] = ()) -> str:
    return (
        f"SELECT {_keys(keys)}estimator, n_t AS n_treatment, n_c AS n_control, "
        + ", ".join([
            r("mt", "mean_treatment"), r("mc", "mean_control"), r("d", "absolute_effect"),
            r("se", "se"), r(f"d - {Z} * se", "ci_low"), r(f"d + {Z} * se", "ci_high"),
            r(f"2 * {Z} * se", "ci_width"), r("z", "z", 6), r(two_sided("z"), "p_value"), r("mt / mc - 1", "relative_lift"),
            r("rlo", "relative_ci_low"), r("rhi", "relative_ci_high"),
            r("vt", "var_treatment"), r("vc", "var_control"),
            f"abs(z) > {Z} AS significant", "'ok' AS status",
        ])
        + " FROM e"
    )


def effects(source_ctes: str, source: str, forms: dict, keys=(), x=None) -> str:
    return (
        f"WITH {source_ctes}, {arms(source, keys, x)}, {effect_rows(forms, keys)} "
        + effect_select(keys)
    )


def cuped_diagnostics(x: str, safe: bool) -> str:
    mt, vt, mc, vc = ESTIMATORS["cuped"]
    status = (
        f"CASE WHEN abs(iz) > {Z_IMBALANCE} THEN 'imbalanced' ELSE 'valid' END"
        if safe else "'invalid_post_assignment'"
    )
    return f"""WITH {log()}, {arms('log', (), x)}, q AS (
  SELECT *, {THETA} AS theta, {vt} AS adj_t, {vc} AS adj_c, vy_t / n_t AS nt_, vy_c / n_c AS nc_,
    my_t - my_c AS d, ({mt}) - ({mc}) AS da, mx_t - mx_c AS gap, sqrt(vx_t / n_t + vx_c / n_c) AS gse,
    cyx_p / sqrt(vy_p * vx_p) AS rho FROM p
), q2 AS (SELECT *, 1 - adj_t / vy_t AS rt, 1 - adj_c / vy_c AS rc, nc_ / (nt_ + nc_) AS sc,
    (adj_t / n_t + adj_c / n_c) / (nt_ + nc_) AS kept, gap / gse AS iz, da - d AS shift,
    abs(theta) * gse AS chance FROM q)
SELECT {r('theta', 'theta')}, {r('rho', 'corr_pooled')},
  {r('rho * rho', 'theoretical_variance_reduction')},
  {r('(1 - sc) * rt + sc * rc', 'achievable_variance_reduction')},
  {r('rt', 'variance_reduction_treatment')}, {r('rc', 'variance_reduction_control')},
  {r('sc', 'control_share_of_variance')}, {r('1 - kept', 'observed_variance_reduction')},
  {r('1 - sqrt(kept)', 'observed_ci_width_reduction')},
  {r('mx_t', 'covariate_mean_treatment')}, {r('mx_c', 'covariate_mean_control')},
  {r('gap', 'covariate_imbalance')}, {r('iz', 'imbalance_z', 6)}, {r(two_sided('iz'), 'imbalance_p')},
  {r('shift', 'point_estimate_shift')}, {r('shift / d', 'point_estimate_shift_pct')},
  {r('chance / abs(d)', 'expected_shift_from_chance_pct')},
  {r('abs(shift) / chance', 'shift_vs_chance_multiple', 6)},
  {str(safe).lower()} AS covariate_is_safe, {status} AS covariate_status FROM q2"""


def sums(features: Sequence[str], spec: ExperimentSpec | None = None, cross: bool = True,
         w: str = "1", covariate: str | None = None, visit: bool = True, exposure: bool = True) -> str:
    """Select list of the cell sums, rounded as the operators' output is."""
    items = {"sum_y": "conversion", "sum_yy": "conversion * conversion"}
    if visit:
        items |= {"sum_xn": "visit", "sum_xnxn": "visit * visit", "sum_yxn": "conversion * visit"}
    if covariate:
        c = covariate
        items |= {"sum_xs": c, "sum_xsxs": f"{c} * {c}", "sum_yxs": f"conversion * {c}"}
    if exposure:
        items["sum_exposure"] = "exposure"
    for f in features:
        items |= {f"sum_{f}": f, f"sum_{f}_y": f"{f} * conversion"}
    if cross:
        for i, a in enumerate(features):
            items |= {f"sum_{a}_{b}": f"{a} * {b}" for b in features[i:]}
    return ", ".join(
        r(f"sum(({w}) * ({e})::DOUBLE)", name, sum_digits(name)) for name, e in items.items()
    )


def _positions() -> dict[str, str]:
    shares = (
        "SELECT block::INT AS block, count(*)::BIGINT AS n, "
        + r("avg(treatment)", "treatment_share") + " FROM b GROUP BY block"
    )

    def placed(treatment: str, order: str, source: str = "orders") -> str:
        return (
            f"WITH o AS (SELECT {treatment} AS treatment, row_number() OVER ({order}) - 1 AS pos, "
            f"count(*) OVER () AS total FROM {source}), "
            "b AS (SELECT treatment, least((pos * 10) // total, 9) AS block FROM o)"
        )

    def summary(head: str) -> str:
        return (
            f"{head}, s AS (SELECT avg(treatment) AS share FROM b GROUP BY block) "
            f"SELECT count(*)::BIGINT AS n_blocks, {r('min(share)', 'min_share')}, "
            f"{r('max(share)', 'max_share')}, {r('max(share) - min(share)', 'spread')}, "
            "max(share) - min(share) < 0.01 AS shuffled FROM s"
        )

    mixed = "(o_orderkey % 20 < 17)::INT"
    last = "(SELECT max(o_orderkey) FROM orders)"
    built = f"CASE WHEN o_orderkey < {last} * 0.35::DOUBLE THEN 1 ELSE {mixed} END"
    by_key = "ORDER BY o_orderkey"
    return {
        "position_dependence": f"{placed(mixed, by_key)} {shares}",
        "position_summary": summary(placed(mixed, by_key)),
        "position_summary_assembled": summary(placed(built, by_key)),
        "position_stored_order": f"{placed(f'({TREATED})::INT', '', 'lineitem')} {shares}",
    }


def _samples() -> dict[str, str]:
    rank = f"(o_orderkey * {RANDOM_FACTOR} + 11) % {RANDOM_PRIME}"
    sample = (
        f"SELECT o_orderkey, o_orderpriority, (o_orderkey % 20 < 17)::INT AS treatment "
        f"FROM orders ORDER BY {rank}, o_orderkey LIMIT {SAMPLE_SIZE}"
    )
    return {
        "hash_sample_topn": sample,
        "sample_arm_coverage": (
            f"WITH s AS ({sample}), a AS (SELECT unnest([0, 1])::INT AS treatment) "
            "SELECT a.treatment, count(s.o_orderkey)::BIGINT AS n, count(s.o_orderkey) > 100 AS covered "
            "FROM a LEFT JOIN s ON a.treatment = s.treatment GROUP BY a.treatment"
        ),
    }


def _quality() -> dict[str, str]:
    bad = ", ".join(
        f"count(*) FILTER (WHERE coalesce({f} NOT IN (0, 1), true))::BIGINT AS bad_{f}"
        for f in ("treatment", "conversion", "visit", "exposure")
    )
    broken = lambda a, b, name: f"count(*) FILTER (WHERE {a} = 1 AND {b} = 0)::BIGINT AS {name}"
    duplicates = (
        "sum(multiplicity)::BIGINT AS n_rows, count(*)::BIGINT AS distinct_rows, "
        "(sum(multiplicity) - count(*))::BIGINT AS exact_duplicate_rows, "
        + r("(sum(multiplicity) - count(*))::DOUBLE / sum(multiplicity)", "duplicate_share")
    )
    rep, one = "FILTER (WHERE multiplicity > 1)", "FILTER (WHERE multiplicity = 1)"
    distinct = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(DISTINCT {f})::BIGINT AS distinct_values FROM log"
        for f in FEATURES
    )
    return {
        "flag_quality": (
            f"WITH {log()} SELECT count(*)::BIGINT AS n_rows, {bad}, "
            f"count(*) FILTER (WHERE exposure = 1)::BIGINT AS exposed, "
            f"{broken('conversion', 'visit', 'converted_without_visit')} FROM log"
        ),
        "implication_violations": (
            f"WITH {log()} SELECT segment, count(*)::BIGINT AS n_rows, "
            "count(*) FILTER (WHERE conversion = 1)::BIGINT AS converted, "
            f"{broken('conversion', 'visit', 'converted_without_visit')}, "
            f"{broken('visit', 'conversion', 'visit_without_conversion')}, "
            f"{broken('exposure', 'treatment', 'exposed_in_control')} FROM log GROUP BY segment"
        ),
        "completeness": (
            f"WITH {log()} SELECT count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_complete, "
            "0::BIGINT AS n_dropped FROM log WHERE "
            + " AND ".join(f"{f} IS NOT NULL" for f in FEATURES)
        ),
        "duplicate_summary": f"WITH {log()}, {COLLAPSED} SELECT {duplicates} FROM collapsed",
        "duplicate_summary_16col": f"WITH {log()}, {COLLAPSED_16} SELECT {duplicates} FROM collapsed",
        "spec_cells_subset_features": (
            f"WITH {log()}, {COLLAPSED_16}, {WEIGHTED} SELECT spec, treatment, sum(w)::DOUBLE AS n, "
            + ", ".join(r(f"sum(w * ({e})::DOUBLE)", f"sum_{c}", sum_digits(f"sum_{c}"))
                        for c, e in (("y", "conversion"), ("f0", "f0"), ("f2", "f2")))
            + " FROM weighted GROUP BY spec, treatment"
        ),
        "duplicates_by_arm": (
            f"WITH {log()}, {COLLAPSED} SELECT treatment, {duplicates} FROM collapsed GROUP BY treatment"
        ),
        "distinct_by_arm": (
            f"WITH {log()}, d AS (SELECT DISTINCT {COARSE_COLUMNS} FROM log) "
            "SELECT treatment, (SELECT count(*) FROM log WHERE log.treatment = d.treatment)::BIGINT AS n_rows, "
            "count(*)::BIGINT AS distinct_rows FROM d GROUP BY treatment"
        ),
        "duplicate_profile": (
            f"WITH {log()}, {COLLAPSED}, g AS (SELECT sum(multiplicity) {rep} AS m, count(*) {rep} AS g, "
            f"max(multiplicity) AS big, sum(multiplicity * conversion) {rep} AS y, "
            f"sum(multiplicity * treatment) {rep} AS t, count(*) {one} AS s, sum(conversion) {one} AS sy "
            "FROM collapsed) SELECT m::BIGINT AS rows_in_duplicate_groups, g::BIGINT AS duplicate_groups, "
            "big::BIGINT AS largest_group, y::BIGINT AS conversions, s::BIGINT AS singleton_rows, "
            f"sy::BIGINT AS singleton_conversions, {r('t::DOUBLE / m', 'treatment_share')}, "
            f"{r('sy::DOUBLE / s * m', 'expected_conversions', 6)} FROM g"
        ),
        "multiplicity_weights": (
            f"WITH {log()}, {COLLAPSED} SELECT *, multiplicity AS w_all, 1::BIGINT AS w_dedup, "
            "(multiplicity = 1)::BIGINT AS w_singleton FROM collapsed"
        ),
        "feature_cardinality": f"WITH {log()} {distinct}",
        "feature_cardinality_united": f"WITH {log()}, d AS ({distinct}) SELECT feature, distinct_values, true AS close FROM d",
    }


def _sums() -> dict[str, str]:
    few = FEW.features
    summary = lambda keys: (
        f"WITH {log()}, a AS (SELECT {_keys(keys)}treatment, count(*) AS n, sum(conversion) AS y, "
        f"sum(visit) AS v, sum(exposure) AS e FROM log {_group(keys, 'treatment')}), "
        f"b AS (SELECT *, n::DOUBLE / sum(n) OVER ({'PARTITION BY ' + ', '.join(keys) if keys else ''}) AS share FROM a) "
        f"SELECT {_keys(keys)}treatment, n::BIGINT AS n, y::BIGINT AS conversions, v::BIGINT AS visits, "
        f"e::BIGINT AS exposed, {r('y::DOUBLE / n', 'conversion_rate')}, {r('share', 'share')}, "
        "round(100 * CASE WHEN treatment = 1 THEN share ELSE 1 - share END)::INT || '/' || "
        "round(100 * CASE WHEN treatment = 1 THEN 1 - share ELSE share END)::INT AS split_label FROM b"
    )
    moments = lambda x, dx, dv, dc: ", ".join([
        "count(*)::DOUBLE AS n", r("avg(conversion)", "mean_y"), r("var_samp(conversion)", "var_y"),
        r(f"avg({x})", "mean_x", dx), r(f"var_samp({x})", "var_x", dv),
        r(f"covar_samp(conversion, {x})", "cov_yx", dc), r(f"corr(conversion, {x})", "corr_yx"),
    ])
    pairs = [(a, b) for i, a in enumerate(few) for b in few[i:]]
    long = lambda features, mean, variance: " UNION ALL ".join(
        f"SELECT treatment, count(*)::DOUBLE AS n, '{f}' AS feature, {r(f'avg({f})', 'mean', mean)}, "
        f"{r(f'var_samp({f})', 'variance', variance)} FROM log GROUP BY treatment"
        for f in features
    )
    narrow = sums(few, visit=False, exposure=False)
    return {
        "arm_summary": summary(()),
        "arm_summary_by_segment": summary(("market",)),
        "sufficient_stats": (
            f"WITH {log()} SELECT treatment, count(*)::BIGINT AS n, {sums(FEATURES)} FROM log GROUP BY treatment"
        ),
        "sufficient_stats_sql": (
            f"WITH {log()} SELECT treatment, count(*)::BIGINT AS n, "
            "sum(conversion)::BIGINT AS sum_y, sum(conversion * conversion)::BIGINT AS sum_yy, "
            "sum(visit)::BIGINT AS sum_xn, sum(visit * visit)::BIGINT AS sum_xnxn, "
            "sum(conversion * visit)::BIGINT AS sum_yxn, sum(exposure)::BIGINT AS sum_exposure, "
            + ", ".join(
                r(f"sum({e})", n, sum_digits(n)) for f in FEATURES
                for n, e in ((f"sum_{f}", f), (f"sum_{f}_y", f"{f} * conversion"))
            )
            + " FROM log GROUP BY treatment"
        ),
        "sufficient_stats_by_segment": (
            f"WITH {log()} SELECT segment, treatment, count(*)::BIGINT AS n, {narrow} FROM log "
            "GROUP BY segment, treatment"
        ),
        "weighted_stats_by_spec": (
            f"WITH {log()}, {COLLAPSED}, {WEIGHTED} SELECT spec, treatment, sum(w)::DOUBLE AS n, "
            f"{sums(('f0', 'f2', 'f3'), w='w', covariate='f0')} FROM weighted GROUP BY spec, treatment"
        ),
        "fold_stats": (
            f"WITH {log()} SELECT fold AS _fold, treatment, count(*)::BIGINT AS n, {narrow} FROM log "
            "GROUP BY fold, treatment"
        ),
        "fold_complement_stats": (
            f"WITH {log()} SELECT 1 - fold AS _fold, treatment, count(*)::BIGINT AS n, {narrow} FROM log "
            "GROUP BY fold, treatment"
        ),
        "arm_moments": (
            f"WITH {log()} SELECT treatment, {moments('f0', 6, 6, 8)} FROM log GROUP BY treatment"
        ),
        "arm_moments_direct": (
            f"WITH {log()} SELECT treatment, {moments('f1', 3, -2, 4)} FROM log GROUP BY treatment"
        ),
        "pooled_moments": f"WITH {log()} SELECT {moments('f0', 6, 6, 8)} FROM log",
        "feature_covariance": f"WITH {log()} " + " UNION ALL ".join(
            f"SELECT treatment, '{a}' AS feature_i, '{b}' AS feature_j, "
            f"{r(f'covar_samp({a}, {b})', 'covariance', 2)} FROM log GROUP BY treatment"
            for a, b in pairs
        ),
        "feature_moments": f"WITH {log()} {long(few, 4, 2).replace('count(*)::DOUBLE AS n', 'count(*)::BIGINT AS n')}",
        "shifted_moments": f"WITH {log()} {long(('f1', 'f5', 'f8'), 4, -2).replace('count(*)::DOUBLE AS n', 'count(*)::BIGINT AS n')}",
    }


def _srm_ctes(source: str, keys: Sequence[str], share: str = "0.85::DOUBLE") -> str:
    return (
        f"c AS (SELECT {_keys(keys)}count(*) FILTER (WHERE treatment = 1) AS nt, "
        f"count(*) FILTER (WHERE treatment = 0) AS nc FROM {source} {_group(keys)}), "
        f"x AS (SELECT *, nt + nc AS n, (nt + nc) * {share} AS et, (nt + nc) * (1 - {share}) AS ec, "
        f"sqrt((nt + nc) * {share} * (1 - {share})) AS sd FROM c), "
        "y AS (SELECT *, (nt - et) * (nt - et) / et + (nc - ec) * (nc - ec) / ec AS chi2, "
        "(nt - et) / sd AS z FROM x)"
    )


def _best_ratio(keys: Sequence[str]) -> str:
    on = " AND ".join(f"g.{k} = y.{k}" for k in keys)
    return (
        f"g AS (SELECT {_keys(keys)}a, b, row_number() OVER (PARTITION BY {', '.join(keys)} "
        "ORDER BY abs(nt::DOUBLE / nc - a::DOUBLE / b), b, a) AS rn FROM c, "
        "(SELECT unnest(range(1, 101)) AS a), (SELECT unnest(range(1, 21)) AS b)), "
        f"h AS (SELECT y.*, g.a, g.b, nt::DOUBLE / nc AS ratio, "
        f"abs(nt::DOUBLE / nc - g.a::DOUBLE / g.b) AS gap FROM y JOIN g ON {on} AND g.rn = 1)"
    )


def _guardrails() -> dict[str, str]:
    shares = (0.50, 0.80, 0.84, 0.845, 0.85, 0.855, 0.86, 0.90)
    ratio_columns = (
        f"{r('ratio', 'arm_ratio')}, a || '/' || b AS nearest_simple_ratio, {r('gap', 'ratio_gap')}, "
        "gap / ratio < 0.00001 AS ratio_looks_constructed"
    )
    smd_rows = lambda features, source, keys: " UNION ALL ".join(
        f"SELECT {_keys(keys)}'{f}' AS feature, avg({f}) FILTER (WHERE treatment = 1) AS mt, "
        f"avg({f}) FILTER (WHERE treatment = 0) AS mc, var_samp({f}) FILTER (WHERE treatment = 1) AS vt, "
        f"var_samp({f}) FILTER (WHERE treatment = 0) AS vc, count(*) FILTER (WHERE treatment = 1) AS nt, "
        f"count(*) FILTER (WHERE treatment = 0) AS nc FROM {source} {_group(keys)}"
        for f in features
    )
    smd = (
        "m2 AS (SELECT *, (mt - mc) / sqrt((vt + vc) / 2) AS smd, (mt - mc) / sqrt(vt / nt + vc / nc) AS z FROM m)"
    )
    smd_select = lambda keys, d: (
        f"SELECT {_keys(keys)}feature, {r('mt', 'mean_treatment', d)}, {r('mc', 'mean_control', d)}, "
        f"{r('mt - mc', 'difference', d)}, {r('smd', 'smd')}, {r('z', 'z', 6)}, {r(two_sided('z'), 'p_value')}, "
        "abs(smd) > 0.1 AS above_threshold FROM m2"
    )
    four = ("f0", "f2", "f3", "f4")
    key = ("assignment",)
    two_means = (
        "q AS (SELECT t.assignment, t.n AS nt, c.n AS nc, t.m0 - c.m0 AS d0, t.m2 - c.m2 AS d2, "
        "((t.n - 1) * t.v0 + (c.n - 1) * c.v0) / (t.n + c.n - 2) AS s00, "
        "((t.n - 1) * t.v2 + (c.n - 1) * c.v2) / (t.n + c.n - 2) AS s22, "
        "((t.n - 1) * t.cv + (c.n - 1) * c.cv) / (t.n + c.n - 2) AS s02 "
        "FROM a t JOIN a c ON t.assignment = c.assignment AND t.treatment = 1 AND c.treatment = 0), "
        "z AS (SELECT *, nt * nc / (nt + nc) * (s22 * d0 * d0 - 2 * s02 * d0 * d2 + s00 * d2 * d2) "
        "/ (s00 * s22 - s02 * s02) AS t2 FROM q) "
    )
    # With two covariates the tail of F has a closed form.
    tail = "pow(1 + t2 / (nt + nc - 2), -(nt + nc - 3) / 2)"
    return {
        "srm_check": (
            f"WITH {log()}, {ASSIGNED}, {_srm_ctes('assigned', key)}, {_best_ratio(key)} "
            "SELECT assignment, nt::BIGINT AS n_treatment, nc::BIGINT AS n_control, n::BIGINT AS n_total, "
            f"{r('nt::DOUBLE / n', 'observed_treatment_share')}, 0.85::DOUBLE AS expected_treatment_share, "
            f"{r('et', 'expected_treatment_count', 5)}, {r('ec', 'expected_control_count', 5)}, "
            f"{r('nt - et', 'delta_users', 5)}, 1 AS dof, {r('chi2', 'chi2', 6)}, "
            f"abs(z) <= {Z_SRM} AS passed, 0.001::DOUBLE AS threshold, {r('sd', 'binomial_sd_users')}, "
            f"{r('z', 'z_score')}, {r(two_sided('z'), 'p_value')}, {r(central('z'), 'closeness_p')}, "
            f"abs(z) < {Z_CLOSE} AS underdispersed, {ratio_columns}, "
            f"CASE WHEN abs(z) <= {Z_SRM} THEN 'pass' ELSE 'fail' END AS status FROM h"
        ),
        "srm_by_segment": (
            f"WITH {log()}, {_srm_ctes('log', ('segment',))} SELECT segment, nt::BIGINT AS n_treatment, "
            f"nc::BIGINT AS n_control, {r('chi2', 'chi2', 6)}, {r('z', 'z_score')}, "
            f"abs(z) <= {Z_SRM} AS passed, abs(z) < {Z_CLOSE} AS underdispersed FROM y"
        ),
        "srm_sensitivity": (
            f"WITH {log()}, c AS (SELECT count(*) FILTER (WHERE treatment = 1) AS nt, "
            "count(*) FILTER (WHERE treatment = 0) AS nc FROM log), "
            f"s AS (SELECT nt, nc, unnest({list(shares)})::DOUBLE AS share FROM c), "
            "x AS (SELECT *, (nt + nc) * share AS et, (nt + nc) * (1 - share) AS ec, "
            "sqrt((nt + nc) * share * (1 - share)) AS sd FROM s) "
            "SELECT share AS assumed_treatment_share, "
            f"{r('(nt - et) * (nt - et) / et + (nc - ec) * (nc - ec) / ec', 'chi2', 4)}, "
            f"{r('(nt - et) / sd', 'z_score', 6)}, {r(two_sided('(nt - et) / sd'), 'p_value')}, abs((nt - et) / sd) <= {Z_SRM} AS passed FROM x"
        ),
        "srm_nearest_ratio": (
            f"WITH {log()}, {_srm_ctes('log', ('market',))}, {_best_ratio(('market',))} "
            f"SELECT market, nt::BIGINT AS n_treatment, nc::BIGINT AS n_control, {ratio_columns} FROM h"
        ),
        "balance_smd": (
            f"WITH {log()}, m AS ({smd_rows(FEATURES, 'log', ())}), {smd} {smd_select((), 4)}"
        ),
        "balance_from_sums": (
            f"WITH {log()}, {ASSIGNED}, m AS ({smd_rows(four, 'assigned', key)}), {smd} {smd_select(key, 8)}"
        ),
        "balance_sql": (
            f"WITH {log()}, m AS ({smd_rows(FEATURES, 'log', ())}), {smd} "
            f"SELECT feature, {r('mt - mc', 'difference', 4)}, {r('smd', 'smd')} FROM m2"
        ),
        "balance_verdict": (
            f"WITH {log()}, {ASSIGNED}, m AS ({smd_rows(four, 'assigned', key)}), {smd} "
            f"SELECT assignment, count(*)::BIGINT AS n_features, {r('max(abs(smd))', 'max_abs_smd')}, "
            "max_by(feature, abs(smd)) AS max_abs_smd_feature, "
            "count(*) FILTER (WHERE abs(smd) > 0.1)::BIGINT AS n_features_above_threshold, "
            "max(abs(smd)) <= 0.1 AS passed FROM m2 GROUP BY assignment"
        ),
        "hotelling_2cov": (
            f"WITH {log()}, {ASSIGNED}, a AS (SELECT assignment, treatment, count(*)::DOUBLE AS n, avg(f0) AS m0, "
            "avg(f2) AS m2, var_samp(f0) AS v0, var_samp(f2) AS v2, covar_samp(f0, f2) AS cv "
            f"FROM assigned GROUP BY assignment, treatment), {two_means} "
            "SELECT assignment, (nt + nc)::BIGINT AS n_total, "
            f"{r('t2', 'hotelling_t2', 5)}, {r('t2 * (nt + nc - 3) / (2 * (nt + nc - 2))', 'hotelling_f', 5)}, "
            f"2 AS hotelling_df1, (nt + nc - 3)::BIGINT AS hotelling_df2, {r(tail, 'hotelling_p')}, false AS singular FROM z"
        ),
        "balance_check_2cov": (
            f"WITH {log()}, {ASSIGNED}, m AS ({smd_rows(('f0', 'f2'), 'assigned', key)}), {smd}, "
            "a AS (SELECT assignment, treatment, count(*)::DOUBLE AS n, avg(f0) AS m0, avg(f2) AS m2, var_samp(f0) AS v0, "
            "var_samp(f2) AS v2, covar_samp(f0, f2) AS cv FROM assigned GROUP BY assignment, treatment), "
            f"{two_means}, w AS (SELECT assignment, count(*)::BIGINT AS n_features, max(abs(smd)) AS worst, "
            "max_by(feature, abs(smd)) AS max_abs_smd_feature, count(*) FILTER (WHERE abs(smd) > 0.1)::BIGINT AS above FROM m2 "
            "GROUP BY assignment) SELECT assignment, n_features, "
            f"{r('worst', 'max_abs_smd')}, max_abs_smd_feature, above AS n_features_above_threshold, worst <= 0.1 AS passed, "
            f"(nt + nc)::BIGINT AS n_total, {r('t2 * (nt + nc - 3) / (2 * (nt + nc - 2))', 'hotelling_f', 5)}, 2 AS hotelling_df1, "
            f"(nt + nc - 3)::BIGINT AS hotelling_df2, {r(tail, 'hotelling_p')}, CASE WHEN worst > 0.1 THEN 'imbalanced' "
            f"WHEN {tail} >= 0.001 THEN 'balanced' ELSE 'negligible' END AS verdict FROM w JOIN z USING (assignment)"
        ),
        "gated_effects": (
            f"WITH {log()}, {ASSIGNED}, {_srm_ctes('assigned', key)}, {arms('assigned', key)}, "
            f"{effect_rows({'unadjusted': ESTIMATORS['unadjusted']}, key)} {effect_select(key)} "
            f"WHERE assignment IN (SELECT assignment FROM y WHERE abs(z) <= {Z_SRM})"
        ),
    }


def _effects() -> dict[str, str]:
    only = lambda name: {name: ESTIMATORS[name]}
    mt, vt, mc, vc = ESTIMATORS["lin"]
    return {
        "itt_unadjusted": effects(log(), "log", only("unadjusted")),
        "itt_by_segment": effects(log(), "log", only("unadjusted"), ("market", "segment")),
        "cuped": effects(log(), "log", only("cuped"), (), "f0"),
        "cuped_diagnostics": cuped_diagnostics("f0", True),
        "cuped_post_treatment": effects(
            log(), "log", {"cuped[visit]": ESTIMATORS["cuped"]}, (), "visit"
        ),
        "cuped_post_diagnostics": cuped_diagnostics("visit", False),
        "lin_adjusted": (
            f"WITH {log()}, {arms('log', (), 'f0')} SELECT {r(THETA_T, 'theta_treatment')}, "
            f"{r(THETA_C, 'theta_control')}, {r(f'{THETA_T} - {THETA_C}', 'theta_gap')}, "
            + r(f"1 - (({vt}) / n_t + ({vc}) / n_c) / (vy_t / n_t + vy_c / n_c)", "variance_reduction")
            + " FROM p"
        ),
        "cace": (
            f"WITH {log()}, {arms('log', (), 'f0')}, "
            f"{effect_rows(ESTIMATORS, (), 'ex_t AS c, exn_c AS cx, ')}, "
            "k AS (SELECT estimator, c, d / c AS est, se / c AS cse, c * (1 - c) / n_t AS cv, cx FROM e) "
            f"SELECT estimator, {r('c', 'compliance_rate')}, {r('est', 'cace_absolute')}, {r('cse', 'cace_se')}, "
            f"{r(f'est - {Z} * cse', 'cace_ci_low')}, {r(f'est + {Z} * cse', 'cace_ci_high')}, "
            f"{r('sqrt(cse * cse + est * est * cv / (c * c))', 'cace_se_delta')}, "
            "CASE WHEN cx > 0 THEN 'control_exposed' ELSE 'ok' END AS status FROM k"
        ),
        "estimator_forest": effects(
            log(), "log",
            ESTIMATORS | {k: ANCOVA[k] for k in ("ancova_pooled", "ancova_lin")}, (), "f0",
        ),
        "ancova_1cov": effects(log(), "log", ANCOVA, (), "f0"),
    }


def _models() -> dict[str, str]:
    fit = (
        "regr_intercept(conversion, {x}) AS b0, regr_slope(conversion, {x}) AS b1, "
        "regr_r2(conversion, {x}) AS r2, count(*) AS n"
    )
    control = (
        f"k AS (SELECT 1 - fold AS fold, {fit.format(x='f0')} FROM log WHERE treatment = 0 GROUP BY fold)"
    )
    scored = "q AS (SELECT log.*, b0 + b1 * f0 AS s FROM log JOIN k ON log.fold = k.fold)"
    return {
        "ols_1cov_by_arm": (
            f"WITH {log()} SELECT treatment, count(*)::BIGINT AS n, "
            f"{r('regr_intercept(conversion, f0)', 'intercept')}, {r('regr_slope(conversion, f0)', 'slope', 10)}, "
            f"{r('regr_syy(conversion, f0) * (1 - regr_r2(conversion, f0))', 'ssr', 5)}, "
            f"{r('regr_r2(conversion, f0)', 'r2', 10)} FROM log GROUP BY treatment"
        ),
        "crossfit_index_1cov": (
            f"WITH {log()}, {control} SELECT fold AS _fold, n::BIGINT AS fit_rows, {r('b0', 'intercept')}, "
            f"{r('b1', 'slope', 10)}, {r('r2', 'r2', 10)} FROM k"
        ),
        "crossfit_index_sums": (
            f"WITH {log()}, {control}, {scored} SELECT treatment, count(*)::BIGINT AS n, {r('sum(s)', 'sum_xs', 5)}, "
            f"{r('sum(s * s)', 'sum_xsxs', 5)}, {r('sum(conversion * s)', 'sum_yxs', 5)} FROM q GROUP BY treatment"
        ),
        "crossfit_scores": (
            f"WITH {log()}, {control}, {scored} SELECT fold AS _fold, treatment, count(*)::BIGINT AS n, "
            f"{r('avg(s)', 'mean_score')}, {r('min(s)', 'min_score')}, {r('max(s)', 'max_score')} "
            "FROM q GROUP BY fold, treatment"
        ),
        "uplift_model_1cov": (
            f"WITH {log()}, {_uplift_models()} SELECT fold AS _fold, n::BIGINT AS fit_rows, "
            f"{r('g0', 'intercept_gap')}, {r('g1', 'slope_gap', 13)} FROM k"
        ),
        "ancova_index_gain": (
            f"WITH {log()}, {control}, g AS (SELECT regr_r2(conversion, f0) AS r2c FROM log WHERE treatment = 0) "
            f"SELECT {r('max(r2c)', 'r2_control', 10)}, {r('avg(r2)', 'r2_index_only', 10)}, "
            f"{r('max(r2c) - avg(r2)', 'r2_gain_from_all_features', 10)} FROM g, k"
        ),
    }


def _uplift_models() -> str:
    return (
        "m AS (SELECT 1 - fold AS fold, treatment, regr_intercept(conversion, f1) AS b0, "
        "regr_slope(conversion, f1) AS b1, count(*) AS n FROM log GROUP BY fold, treatment), "
        "k AS (SELECT t.fold, t.b0 - c.b0 AS g0, t.b1 - c.b1 AS g1, t.n + c.n AS n FROM m t JOIN m c "
        "ON t.fold = c.fold AND t.treatment = 1 AND c.treatment = 0)"
    )


def _spec_curve() -> tuple[str, str]:
    """CTEs up to ``v`` (one unrounded row per choice) and its select list."""
    moments = ["count(*)::DOUBLE AS n", "avg(conversion) AS my", "var_samp(conversion) AS vy",
               "avg(f0) AS mx", "var_samp(f0) AS vx", "covar_samp(conversion, f0) AS cyx"]
    for f in ("f0", "f2", "f3"):
        moments += [f"avg({f}) AS m_{f}", f"var_samp({f}) AS v_{f}"]
    names = [m.rsplit(" AS ", 1)[1] for m in moments]
    picks = ", ".join(
        f"max({c}) FILTER (WHERE treatment = {v}) AS {c}_{s}" for c in names for v, s in ((1, "t"), (0, "c"))
    )
    # Rows of each choice, spelled out: every copy, one copy, or only the unrepeated.
    expanded = (
        f"rows AS (SELECT 'all' AS spec, {COARSE_COLUMNS} FROM log "
        f"UNION ALL SELECT 'dedup', {COARSE_COLUMNS} FROM collapsed "
        f"UNION ALL SELECT 'singleton', {COARSE_COLUMNS} FROM collapsed WHERE multiplicity = 1)"
    )
    smd = lambda f: f"abs((m_{f}_t - m_{f}_c) / sqrt((v_{f}_t + v_{f}_c) / 2))"
    mt, vt, mc, vc = _adjusted(THETA, THETA)
    katz = lambda s, mt, vt, mc, vc: (
        f"exp(ln({mt} / {mc}) {s} {Z} * sqrt({vt} / (n_t * {mt} * {mt}) + {vc} / (n_c * {mc} * {mc}))) - 1"
    )
    ctes = (
        f"{log()}, {COLLAPSED}, {expanded}, "
        f"a AS (SELECT spec, treatment, {', '.join(moments)} FROM rows GROUP BY spec, treatment), "
        "w AS (SELECT spec, avg(f0) AS mx_p, var_samp(f0) AS vx_p, covar_samp(conversion, f0) AS cyx_p "
        "FROM rows GROUP BY spec), "
        f"s AS (SELECT spec, {picks} FROM a GROUP BY spec), "
        f"p AS (SELECT *, n_t + n_c AS nn, {mt} AS am_t, {vt} AS av_t, {mc} AS am_c, {vc} AS av_c "
        "FROM s JOIN w USING (spec)), "
        f"v AS (SELECT *, (n_t - nn * 0.85::DOUBLE) / sqrt(nn * 0.85::DOUBLE * 0.15::DOUBLE) AS sz, "
        f"greatest({smd('f0')}, {smd('f2')}, {smd('f3')}) AS worst, "
        f"CASE WHEN {smd('f0')} >= {smd('f2')} AND {smd('f0')} >= {smd('f3')} THEN 'f0' "
        f"WHEN {smd('f2')} >= {smd('f3')} THEN 'f2' ELSE 'f3' END AS worst_f, "
        f"my_t / my_c - 1 AS lu, {katz('-', 'my_t', 'vy_t', 'my_c', 'vy_c')} AS lul, "
        f"{katz('+', 'my_t', 'vy_t', 'my_c', 'vy_c')} AS luh, am_t / am_c - 1 AS lc, "
        f"{katz('-', 'am_t', 'av_t', 'am_c', 'av_c')} AS lcl, {katz('+', 'am_t', 'av_t', 'am_c', 'av_c')} AS lch FROM p)"
    )
    select = ", ".join([
        "spec", "n_t::BIGINT AS n_treatment", "n_c::BIGINT AS n_control", "nn::BIGINT AS n_total",
        r("n_t / nn", "treatment_share"), f"abs(sz) <= {Z_SRM} AS srm_passed", r("sz", "srm_z", 6),
        r("worst", "max_abs_smd"), "worst_f AS max_abs_smd_feature", "worst <= 0.1 AS balance_passed",
        r("my_t", "conversion_rate_treatment"), r("my_c", "conversion_rate_control"),
        r("lu", "lift_unadjusted"), r("lul", "lift_unadjusted_ci_low"), r("luh", "lift_unadjusted_ci_high"),
        r("lc", "lift_cuped"), r("lcl", "lift_cuped_ci_low"), r("lch", "lift_cuped_ci_high"),
        "CASE spec WHEN 'all' THEN 'every row counts' WHEN 'dedup' THEN 'copies count once' "
        "ELSE 'records that occur once' END AS label",
    ])
    return ctes, select


_SUMMARY = (
    "g AS (SELECT count(*) AS k, min(lu) AS un, max(lu) AS ux, min(lc) AS cn, max(lc) AS cx, "
    "min(least(lul, lcl)) AS low, count(DISTINCT abs(sz) <= " + Z_SRM + ") = 1 AS stable, "
    "bool_and(lc > 0) AS sign FROM v), "
    "g2 AS (SELECT *, least(un, cn) AS ln, greatest(ux, cx) AS lx, ux / un AS su, cx / cn AS sc FROM g), "
    "g3 AS (SELECT *, CASE WHEN ln > 0 THEN lx / ln ELSE 'inf'::DOUBLE END AS sf, "
    "CASE WHEN sc > 1 THEN (su - 1) / (sc - 1) ELSE 'inf'::DOUBLE END AS gain FROM g2)"
)


def _robustness() -> dict[str, str]:
    ctes, select = _spec_curve()
    mt, vt, mc, vc = _adjusted(THETA_T, THETA_C)
    lin_low = (
        f"exp(ln(({mt}) / ({mc})) - {Z} * sqrt(({vt}) / (n_t * ({mt}) * ({mt})) "
        f"+ ({vc}) / (n_c * ({mc}) * ({mc})))) - 1"
    )
    return {
        "spec_curve": f"WITH {ctes} SELECT {select} FROM v",
        "spec_curve_summary": (
            f"WITH {ctes}, {_SUMMARY} SELECT k::BIGINT AS n_specs, "
            + ", ".join([
                r("un", "lift_unadjusted_min"), r("ux", "lift_unadjusted_max"), r("cn", "lift_cuped_min"),
                r("cx", "lift_cuped_max"), r("low", "lowest_ci_bound"), "stable AS srm_stable",
                "sign AS sign_stable", r("ln", "lift_min"), r("lx", "lift_max"),
                r("su", "spread_factor_unadjusted"), r("sc", "spread_factor_cuped"),
                r("sf", "spread_factor"), r("gain", "adjustment_stability_gain", 3),
            ]) + " FROM g3"
        ),
        "ship_decision": (
            f"WITH {ctes}, {_SUMMARY}, l AS (SELECT v.*, {lin_low} AS linl FROM v WHERE spec = 'all'), "
            "d AS (SELECT *, least(lul, lcl, linl, low) AS wc, CASE WHEN gain > 1.5 THEN 'cuped' "
            "WHEN worst <= 0.1 THEN 'unadjusted' ELSE 'cuped' END AS lead FROM l, g3) "
            "SELECT wc > 0.1 AS ship, wc > 0 AND wc <= 0.1 AS marginal, CASE WHEN wc > 0.1 THEN 'ship' "
            "WHEN wc > 0 THEN 'marginal' ELSE 'hold' END AS decision, 0.1::DOUBLE AS min_practical_lift, "
            f"{r('wc', 'worst_case_lower_bound')}, lead AS leading_estimate, "
            + ", ".join(
                r(f"CASE WHEN lead = 'cuped' THEN {c} ELSE {u} END", name)
                for c, u, name in (("lc", "lu", "point_estimate"), ("lcl", "lul", "ci_low"), ("lch", "luh", "ci_high"))
            )
            + f", {r('ln', 'plausible_low')}, {r('lx', 'plausible_high')}, {r('lu', 'lift')}, "
            f"{r('lc', 'lift_cuped')} FROM d"
        ),
    }


def _uplift() -> dict[str, str]:
    points = ", ".join(f"{i / 10}" for i in range(1, 10))
    bins = (
        f"{log()}, {_uplift_models()}, "
        "q AS (SELECT treatment, conversion, g0 + g1 * f1 AS s FROM log JOIN k ON log.fold = k.fold), "
        f"ed AS (SELECT list_distinct(quantile_disc(s, [{points}])) AS edges FROM q), "
        "bn AS (SELECT treatment, conversion, s, len(list_filter(edges, lambda e: e < s)) AS bin FROM q, ed), "
        "ba AS (SELECT bin::INT AS bin, treatment, count(*) AS n, sum(conversion)::DOUBLE AS y, avg(s) AS ms "
        "FROM bn GROUP BY bin, treatment)"
    )
    table = (
        f"{bins}, tb AS (SELECT bin, max(n) FILTER (WHERE treatment = 1) AS nt, "
        "max(n) FILTER (WHERE treatment = 0) AS nc, max(y) FILTER (WHERE treatment = 1) AS yt, "
        "max(y) FILTER (WHERE treatment = 0) AS yc, sum(n * ms) / sum(n) AS ms FROM ba GROUP BY bin "
        "HAVING count(*) = 2), "
        "tt AS (SELECT *, yt / nt AS pt, yc / nc AS pc, yt / nt - yc / nc AS up, "
        "sqrt(yt / nt * (1 - yt / nt) / nt + yc / nc * (1 - yc / nc) / nc) AS se, "
        "(yt / nt - yc / nc) * (nt + nc) AS inc, "
        "row_number() OVER (ORDER BY ms DESC, bin DESC) AS rk FROM tb)"
    )
    curve = (
        f"{table}, cv AS (SELECT *, sum(nt + nc) OVER o::DOUBLE / sum(nt + nc) OVER () AS ps, "
        "sum(inc) OVER o AS gi, sum(inc) OVER () AS tot FROM tt WINDOW o AS (ORDER BY rk))"
    )
    area = (
        f"{curve}, ar AS (SELECT *, lag(ps, 1, 0) OVER (ORDER BY rk) AS p0, lag(gi, 1, 0) OVER (ORDER BY rk) AS g_0 FROM cv), "
        "tl AS (SELECT sum((ps - p0) * (gi + g_0) / 2) AS area, sum((ps - p0) * tot * (ps + p0) / 2) AS rnd, "
        "count(*) AS k, max(tot) AS tot, sum(yt) / sum(nt) - sum(yc) / sum(nc) AS ate, "
        "sum(up / (se * se)) / sum(1 / (se * se)) AS ctr FROM ar)"
    )
    return {
        "uplift_bins": (
            f"WITH {bins} SELECT bin, treatment, n::BIGINT AS n, y AS conversions, {r('ms', 'mean_score')} FROM ba"
        ),
        "uplift_table": (
            f"WITH {table} SELECT bin, nt::BIGINT AS n_treatment, nc::BIGINT AS n_control, {r('pt', 'rate_treatment')}, "
            f"{r('pc', 'rate_control')}, {r('up', 'uplift')}, {r('se', 'se')}, {r('up / pc', 'uplift_relative')}, "
            f"{r('ms', 'mean_score')}, {r('inc', 'incremental_conversions', 5)} FROM tt"
        ),
        "qini_curve": (
            f"WITH {curve} SELECT rk::INT AS step, bin, {r('ps', 'population_share')}, "
            f"{r('gi', 'incremental_conversions', 5)}, {r('gi / tot', 'share_of_incremental')}, "
            f"{r('ps', 'random_share')} FROM cv UNION ALL SELECT 0, NULL, 0.0, 0.0, 0.0, 0.0"
        ),
        "qini_coefficient": (
            f"WITH {area} SELECT max(k)::BIGINT AS n_bins, {r('max(ate)', 'ate_absolute')}, "
            f"{r('max(tl.tot)', 'total_incremental', 5)}, {r('max((area - rnd) / abs(rnd))', 'qini_ratio')}, "
            f"{r('sum(((up - ate) / se) ** 2)', 'chi2', 6)}, {r('sum(((up - ctr) / se) ** 2)', 'chi2_weighted', 6)}, "
            f"(max(k) - 1)::INT AS heterogeneity_df, {r(chi2_tail('sum(((up - ate) / se) ** 2)', '(max(k) - 1)'), 'heterogeneity_p')} FROM ar, tl"
        ),
        "uplift_bins_by_segment": (
            f"WITH {log()}, m AS (SELECT segment, 1 - fold AS fold, treatment, regr_intercept(conversion, f1) AS b0, "
            "regr_slope(conversion, f1) AS b1 FROM log GROUP BY ALL), "
            "k AS (SELECT t.segment, t.fold, t.b0 - c.b0 AS g0, t.b1 - c.b1 AS g1 FROM m t JOIN m c "
            "ON t.segment = c.segment AND t.fold = c.fold AND t.treatment = 1 AND c.treatment = 0), "
            "q AS (SELECT segment, treatment, conversion, g0 + g1 * f1 AS s FROM log JOIN k USING (segment, fold)), "
            f"ed AS (SELECT segment, list_distinct(quantile_disc(s, [{points}])) AS edges FROM q GROUP BY segment), "
            "bn AS (SELECT segment, treatment, conversion, s, len(list_filter(edges, lambda e: e < s)) AS bin FROM q JOIN ed USING (segment)) "
            "SELECT segment, bin::INT AS bin, treatment, count(*)::BIGINT AS n, sum(conversion)::DOUBLE AS conversions, "
            f"{r('avg(s)', 'mean_score')} FROM bn GROUP BY segment, bin, treatment"
        ),
        "uplift_concentration": (
            f"WITH {curve} SELECT {r('min_by(up, rk)', 'top_bin_uplift')}, {r('max_by(up, rk)', 'bottom_bin_uplift')}, "
            f"{r('min_by(up, rk) / max_by(up, rk)', 'top_vs_bottom_ratio', 6)}, "
            f"{r('sum(inc) FILTER (WHERE rk <= 3) / sum(inc)', 'share_of_effect_in_top_bins')}, "
            f"{r('(sum(nt + nc) FILTER (WHERE rk <= 3))::DOUBLE / sum(nt + nc)', 'population_in_top_bins')}, "
            + r(
                "sum(inc * least(greatest((0.3::DOUBLE - (ps - (nt + nc) / (SELECT sum(nt + nc)::DOUBLE FROM tt))) "
                "/ ((nt + nc) / (SELECT sum(nt + nc)::DOUBLE FROM tt)), 0), 1)) / sum(inc)",
                "share_of_effect_in_top_share",
            )
            + " FROM cv"
        ),
    }


def _power() -> dict[str, str]:
    angle = lambda p: f"asin(sqrt({p}))"
    zz = f"({Z} + {Z_POWER})"

    def base(keys: Sequence[str]) -> str:
        return (
            f"{log()}, b AS (SELECT {_keys(keys)}avg(conversion) FILTER (WHERE treatment = 0) AS p0, "
            "count(*) FILTER (WHERE treatment = 1)::DOUBLE AS nt, count(*) FILTER (WHERE treatment = 0)::DOUBLE AS nc "
            f"FROM log {_group(keys)}), b2 AS (SELECT *, nt / nc AS k, 2 * nt * nc / (nt + nc) AS ne FROM b)"
        )

    def required(source: str) -> str:
        return (
            f"h AS (SELECT *, p0 * (1 + mde) AS p1, 2 * ({angle('p0 * (1 + mde)')} - {angle('p0')}) AS h FROM {source}), "
            f"n1 AS (SELECT *, ceil(2 * {zz} * {zz} / (h * h)) AS nb FROM h), "
            "n2 AS (SELECT *, ceil(nb * (1 + 1 / k) / 2) AS rc FROM n1), "
            "n3 AS (SELECT *, ceil(k * rc) AS rt FROM n2)"
        )

    detect = f"pow(sin({angle('p0')} + {zz} * sqrt(2 / ne) / 2), 2) / p0 - 1"
    sizes = (
        "nb::BIGINT AS n_per_arm_balanced, rt::BIGINT AS n_treatment_required, rc::BIGINT AS n_control_required, "
        "(rt + rc)::BIGINT AS n_total_required"
    )
    powered = "nt >= rt AND nc >= rc"
    # Upper tails at the critical value less and plus the drift.
    drift = "abs(h) * sqrt(ne / 2)"
    upper = lambda z: f"(0.5 - sign({z}) * {central(z)} / 2)"
    achieved = r(f"{upper(f'({Z} - {drift})')} + {upper(f'({Z} + {drift})')}", "achieved_power")

    def grid(keys: Sequence[str]) -> str:
        return (
            f"WITH {base(keys)}, g AS (SELECT *, unnest([0.01, 0.02, 0.05, 0.10, 0.20])::DOUBLE AS mde FROM b2), "
            f"{required('g')} SELECT {_keys(keys)}mde AS mde_relative, {r('p0', 'baseline_rate')}, "
            f"{r('p1', 'treated_rate_target')}, {r('h', 'effect_size_h')}, {sizes}, nt::BIGINT AS n_treatment, "
            f"nc::BIGINT AS n_control, {powered} AS powered, {achieved} FROM n3"
        )

    return {
        "power_by_segment": (
            f"WITH {base(('market',))}, g AS (SELECT *, 0.05::DOUBLE AS mde FROM b2), {required('g')} "
            f"SELECT market, {r('p0', 'baseline_rate')}, mde AS mde_relative, {r('p1 - p0', 'mde_absolute')}, "
            f"{r('p1', 'treated_rate_target')}, 0.05::DOUBLE AS alpha, 0.8::DOUBLE AS power, "
            f"{r('h', 'effect_size_h')}, (2 * nb)::BIGINT AS n_total_balanced, {sizes}, "
            f"{r('k', 'allocation_ratio')}, nt::BIGINT AS n_treatment, nc::BIGINT AS n_control, {r('ne', 'n_eff', 4)}, "
            f"{powered} AS powered, {achieved}, {r(detect, 'smallest_detectable_lift')}, "
            f"CASE WHEN {powered} THEN 'powered' ELSE 'underpowered' END AS verdict FROM n3"
        ),
        "power_mde_grid": grid(()),
        "power_achieved": grid(("market",)),
        "smallest_detectable": (
            f"WITH {base(('segment',))} SELECT segment, {r('p0', 'baseline_rate')}, {r('ne', 'n_eff', 4)}, "
            f"{r(detect, 'smallest_detectable_lift')} FROM b2"
        ),
        "power_designs": (
            f"WITH {base(('market',))}, g AS (SELECT market, p0, 0.05::DOUBLE AS mde, "
            "unnest([0.5, 0.7, 0.85, 0.95])::DOUBLE AS share FROM b2), "
            f"g2 AS (SELECT *, share / (1 - share) AS k FROM g), {required('g2')} "
            f"SELECT market, {r('p0', 'baseline_rate')}, mde AS mde_relative, share AS treatment_share, "
            f"{r('p1', 'treated_rate_target')}, {r('h', 'effect_size_h')}, {sizes} FROM n3"
        ),
    }


def _looks() -> dict[str, str]:
    def valid(keys: Sequence[str], rho: str) -> str:
        return (
            f"WITH {log()}, {arms('log', keys)}, q AS (SELECT *, n_t * n_c / (n_t + n_c) AS ne, my_t - my_c AS d, "
            "sqrt(vy_t / n_t + vy_c / n_c) AS se FROM p), "
            f"q2 AS (SELECT *, sqrt((ne * {rho} + 1) / (ne * {rho}) * ln((ne * {rho} + 1) / (0.05::DOUBLE * 0.05::DOUBLE))) AS b FROM q) "
            f"SELECT {_keys(keys)}{r('ne', 'n_eff', 4)}, {r('d', 'absolute_effect')}, {r('se', 'se')}, {r('b', 'boundary')}, "
            f"{r(f'd - {Z} * se', 'fixed_ci_low')}, {r(f'd + {Z} * se', 'fixed_ci_high')}, "
            f"{r('d - b * se', 'always_valid_ci_low')}, {r('d + b * se', 'always_valid_ci_high')}, "
            f"{r(f'b / {Z}', 'width_penalty')}, d - b * se > 0 AS still_significant FROM q2"
        )

    events = (
        "ev AS (SELECT event_id, user_id, (user_id % 2)::INT AS treatment, (event_type = 'purchase')::INT AS conversion, "
        f"((row_number() OVER (ORDER BY ts, event_id) - 1) * {N_LOOKS}) // count(*) OVER () + 1 AS look FROM events)"
    )

    def running(source: str, keys: Sequence[str]) -> str:
        by = "PARTITION BY " + ", ".join(keys) if keys else ""
        group = ", ".join([*keys, "look"])
        return (
            f"st AS (SELECT {group}, count(*) FILTER (WHERE treatment = 1) AS nt, "
            "count(*) FILTER (WHERE treatment = 0) AS nc, coalesce(sum(conversion) FILTER (WHERE treatment = 1), 0) AS yt, "
            f"coalesce(sum(conversion) FILTER (WHERE treatment = 0), 0) AS yc FROM {source} GROUP BY {group}), "
            f"cu AS (SELECT {group}, sum(nt) OVER o AS nt, sum(nc) OVER o AS nc, sum(yt) OVER o::DOUBLE AS yt, "
            f"sum(yc) OVER o::DOUBLE AS yc FROM st WINDOW o AS ({by} ORDER BY look)), "
            # A look at which an arm is still empty has no z; 0/0 would be NaN, which sorts above every limit.
            "lk AS (SELECT *, (yt / nullif(nt, 0) - yc / nullif(nc, 0)) / nullif(sqrt((yt + yc) / (nt + nc) * (1 - (yt + yc) / (nt + nc)) "
            "* (1.0::DOUBLE / nt + 1.0::DOUBLE / nc)), 0) AS z FROM cu)"
        )

    crossed = f"coalesce(abs(z) > {Z}, false)"

    def false_positives(unit: str, treated: str) -> str:
        mixed = f"(({unit} * {RANDOM_FACTOR} + (r + 1) * 69621) % {RANDOM_PRIME})"
        return (
            f"WITH {events}, aa AS (SELECT conversion, look, r AS replicate, "
            f"((({mixed} * {mixed}) % {RANDOM_PRIME}) // 65536 {treated})::INT AS treatment "
            f"FROM ev, (SELECT unnest(range(0, {AA_REPLICATES})) AS r)), {running('aa', ('replicate',))}, "
            f"ec AS (SELECT look, {crossed}::INT AS c, max({crossed}::INT) OVER (PARTITION BY replicate ORDER BY look) AS ever FROM lk) "
            "SELECT look::INT AS n_looks, count(*)::BIGINT AS replicates, sum(ever)::BIGINT AS ever_crossed, "
            f"{r('avg(c)', 'rate_at_this_look')}, {r('avg(ever)', 'false_positive_rate')} FROM ec GROUP BY look"
        )

    return {
        "always_valid_interval": valid((), "ne"),
        "always_valid_tuned": valid(("market",), "(8.2::DOUBLE / 8000.0::DOUBLE)"),
        "look_replay": (
            f"WITH {events}, {running('ev', ())} SELECT look::INT AS look, nt::BIGINT AS n_treatment, "
            "nc::BIGINT AS n_control, yt AS conversions_treatment, yc AS conversions_control, "
            f"{r('yt / nt', 'rate_treatment')}, {r('yc / nc', 'rate_control')}, {r('z', 'z')}, {crossed} AS crossed FROM lk"
        ),
        "look_crossings": (
            f"WITH {events}, {running('ev', ())} SELECT count(*)::BIGINT AS n_looks, {r('max(abs(z))', 'max_abs_z')}, "
            f"(min(look) FILTER (WHERE {crossed}))::INT AS first_crossing, bool_or({crossed}) AS ever_crossed FROM lk"
        ),
        "aa_false_positive_rate": false_positives("event_id", "% 2"),
        "aa_false_positive_rate_by_user": false_positives("user_id", "% 20 < 17"),
    }


def _whole_keys() -> dict[str, str]:
    """Nothing is lost: more than two folds, a NULL key, a key whose sample ratio fails."""
    # NULL takes part as a value of its own and is turned back at the end.
    named = f"{log('raw')}, log AS (SELECT * REPLACE (coalesce(segment_null, '~') AS segment_null) FROM raw)"
    key = ("segment_null",)
    others = "FROM (SELECT DISTINCT fold5 FROM log) f JOIN log ON log.fold5 <> f.fold5"
    arm = lambda v, e: f"{e} FILTER (WHERE treatment = {v})"
    smd = " UNION ALL ".join(
        f"SELECT segment_null, '{f}' AS feature, {arm(1, f'avg({f})')} - {arm(0, f'avg({f})')} AS d, "
        f"sqrt(({arm(1, f'var_samp({f})')} + {arm(0, f'var_samp({f})')}) / 2) AS sd FROM log GROUP BY segment_null"
        for f in ("f0", "f2")
    )
    five = (
        f"m AS (SELECT f.fold5 AS fold5, treatment, regr_intercept(conversion, f1) AS b0, regr_slope(conversion, f1) AS b1 "
        f"{others} GROUP BY f.fold5, treatment), "
        "k AS (SELECT t.fold5, t.b0 - c.b0 AS g0, t.b1 - c.b1 AS g1 FROM m t JOIN m c "
        "ON t.fold5 = c.fold5 AND t.treatment = 1 AND c.treatment = 0), "
        "q AS (SELECT log.fold5, treatment, g0 + g1 * f1 AS s FROM log JOIN k ON log.fold5 = k.fold5)"
    )
    return {
        "crossfit_five_folds": (
            f"WITH {log()} SELECT f.fold5 AS _fold, count(*)::BIGINT AS fit_rows, "
            f"{r('regr_intercept(conversion, f0)', 'intercept')}, {r('regr_slope(conversion, f0)', 'slope', 10)}, "
            f"{r('regr_r2(conversion, f0)', 'r2', 10)} {others} WHERE treatment = 0 GROUP BY f.fold5"
        ),
        "uplift_scores_five_folds": (
            f"WITH {log()}, {five} SELECT fold5 AS _fold, treatment, count(*)::BIGINT AS n, 0::BIGINT AS n_unscored, "
            f"{r('avg(s)', 'mean_score')} FROM q GROUP BY fold5, treatment"
        ),
        "gated_effects_null_key": (
            f"WITH {named}, {_srm_ctes('log', key)}, {arms('log', key)}, "
            f"{effect_rows({'unadjusted': ESTIMATORS['unadjusted']}, key)}, "
            f"out AS ({effect_select(key)} WHERE segment_null IN (SELECT segment_null FROM y WHERE abs(z) <= {Z_SRM})) "
            "SELECT * REPLACE (nullif(segment_null, '~') AS segment_null) FROM out"
        ),
        "balance_null_key": (
            f"WITH {named}, m AS ({smd}), n AS (SELECT segment_null, count(*)::BIGINT AS n_total FROM log GROUP BY segment_null) "
            f"SELECT nullif(segment_null, '~') AS segment_null, count(*)::BIGINT AS n_features, "
            f"{r('max(abs(d / sd))', 'max_abs_smd')}, max_by(feature, abs(d / sd)) AS max_abs_smd_feature, "
            "max(abs(d / sd)) <= 0.1 AS passed, any_value(n_total) AS n_total FROM m JOIN n USING (segment_null) "
            "GROUP BY segment_null"
        ),
        "duplicates_rare": (
            f"WITH {log()}, {COLLAPSED_16} SELECT treatment, sum(multiplicity)::BIGINT AS n_rows, count(*)::BIGINT AS distinct_rows, "
            "(sum(multiplicity) - count(*))::BIGINT AS exact_duplicate_rows, "
            f"{r('(sum(multiplicity) - count(*))::DOUBLE / sum(multiplicity)', 'duplicate_share')} FROM collapsed GROUP BY treatment"
        ),
        "decision_withheld": (
            f"WITH {log()}, {ASSIGNED}, {_srm_ctes('assigned', ('assignment',))}, {arms('assigned', ('assignment',))}, "
            f"{effect_rows({'unadjusted': ESTIMATORS['unadjusted']}, ('assignment',))}, "
            f"judged AS (SELECT assignment, abs(y.z) <= {Z_SRM} AS ok, mt / mc - 1 AS lift, rlo FROM y JOIN e USING (assignment)) "
            "SELECT assignment, CASE WHEN NOT ok THEN 'withheld' WHEN rlo > 0.1 THEN 'ship' WHEN rlo > 0 THEN 'marginal' "
            f"ELSE 'hold' END AS decision, {r('CASE WHEN ok THEN lift END', 'lift')}, "
            f"{r('CASE WHEN ok THEN rlo END', 'worst_case_lower_bound')} FROM judged"
        ),
    }


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in (_quality, _positions, _samples, _sums, _guardrails, _effects, _models,
                 _robustness, _uplift, _power, _looks, _whole_keys):
        out |= part()
    return out
