"""The whole analysis of a log, table by table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ancova as anc
from ..operators import decision, effects, guardrails, models, position, power, quality, robustness
from ..operators import sequential, suffstats, uplift
from ..operators.folds import FOLD, with_fold
from ..functions.columns import on_keys
from ..operators.moments import paired_moments
from ..sources.logs import write_cells, write_result
from ..sources.session import durable
from ..spec import ExperimentSpec


class ExperimentReport:
    """Every result table of one analysis, built when first asked for.

    The log is read for four things: flags and completeness, the position table,
    the sums per (choice, fold, arm), from which all tests, models and adjusted
    estimates follow by algebra, and the uplift bins, which need a score per row.
    The counts and sums are kept in the checkpoint folder, so every other table
    starts from a handful of rows. Tables that compare the arms carry
    ``srm_status``, the key's sample-ratio check.

    ``choices=False`` leaves out the row-handling choices and with them the
    collapse to distinct rows, in which row hashes and the rows that repeat are shuffled.
    """

    TABLES = (
        "quality", "completeness", "duplicates", "duplicate_profile", "position", "arms", "srm", "srm_sensitivity", "balance_features", "balance",
        "power", "power_grid", "effects", "cuped", "lin", "cuped_post", "cuped_post_diagnostics",
        "complier", "ancova", "index_gain", "sequential", "spec_curve", "spec_curve_summary",
        "uplift_bins", "unscored", "uplift", "qini_curve", "uplift_summary", "decision", "summary",
    )
    COMPARISONS = (
        "cuped", "lin", "cuped_post", "cuped_post_diagnostics", "complier", "ancova", "index_gain", "sequential",
        "spec_curve", "spec_curve_summary", "uplift_bins", "uplift", "qini_curve", "uplift_summary",
    )

    def __init__(
        self, log: DataFrame, spec: ExperimentSpec, choices: bool = True, identity: tuple[str, ...] | None = None
    ):
        """``identity`` names the columns in which copies of a row agree; by default all of the log's."""
        self.spec = spec
        self.choices = choices
        self.identity = tuple(dict.fromkeys([*(identity or log.columns), *suffstats.analysis_columns(spec)]))
        self.raw = log
        self.log = log.select(*suffstats.analysis_columns(spec))

    @cached_property
    def _ordered(self) -> bool:
        return position.has_stored_order(self.raw)

    @property
    def tables(self) -> tuple[str, ...]:
        """Names of the tables that this spec has the columns for; ``position`` only for a log whose stored order is known."""
        absent = set()
        if not self.choices:
            absent |= {"spec_curve", "spec_curve_summary", "duplicates", "duplicate_profile"}
        if not self.spec.post_covariate:
            absent |= {"cuped_post", "cuped_post_diagnostics"}
        if not self.spec.exposure:
            absent.add("complier")
        if not self._ordered:
            absent.add("position")
        return tuple(t for t in self.TABLES if t not in absent)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(name)
        if name not in ("quality", "completeness"):
            self.require_clean_flags()
        table = getattr(self, name)
        if name in self.COMPARISONS:
            status = self.srm.select(*self.spec.keys, F.col("status").alias("srm_status"))
            table = on_keys(table, status, self.spec.keys)
        return table

    def write(self, folder: str) -> None:
        """Cells as Parquet, every table as JSON lines."""
        write_cells(self.cells, f"{folder}/cells")
        for name in self.tables:
            write_result(self[name], f"{folder}/{name}")

    # -- sums, kept ----------------------------------------------------------------------

    @cached_property
    def choice_folds(self) -> DataFrame:
        """Sums per (keys, choice, fold, arm), from the log collapsed to distinct rows."""
        return durable(
            robustness.spec_cells(with_fold(self.collapsed, self.spec), self.spec, by=(FOLD,))
        )

    @cached_property
    def collapsed(self) -> DataFrame:
        """Distinct rows of the whole log with how often each occurs, whatever features are analysed."""
        n_rows = self.completeness.agg(F.sum("n_rows")).first()[0] or 0
        return quality.collapse_rare(self.raw, self.identity, n_rows)

    @cached_property
    def duplicates(self) -> DataFrame:
        return quality.duplicate_summary(self.collapsed)

    @cached_property
    def duplicate_profile(self) -> DataFrame:
        return quality.duplicate_profile(self.collapsed, self.spec)

    @cached_property
    def position(self) -> DataFrame:
        """Treatment share in ten blocks of the stored order."""
        return position.share_by_block(self.raw, self.spec)

    @cached_property
    def fold_cells(self) -> DataFrame:
        if self.choices:
            return self.choice_folds.filter(F.col(robustness.SPEC) == "all").drop(robustness.SPEC)
        return durable(models.fold_cells(self.log, self.spec))

    @cached_property
    def index_models(self) -> DataFrame:
        return models.covariate_models(self.fold_cells, self.spec)

    @cached_property
    def choice_cells(self) -> DataFrame:
        """Cells per (keys, choice, arm) with the sums of the cross-fitted index."""
        keyed = robustness.per_spec(self.spec)
        return durable(models.index_cells(
            self.choice_folds, self.index_models, keyed, model_keys=self.spec.keys
        ))

    @cached_property
    def cells(self) -> DataFrame:
        """Cells per (keys, arm) with the sums of the cross-fitted index."""
        if self.choices:
            return self.choice_cells.filter(F.col(robustness.SPEC) == "all").drop(robustness.SPEC)
        return durable(models.index_cells(self.fold_cells, self.index_models, self.spec))

    @cached_property
    def uplift_bins(self) -> DataFrame:
        fitted = models.pin_models(models.uplift_models(self.fold_cells, self.spec), self.spec)
        return uplift.uplift_bins(self.log, self.spec, fitted=fitted)

    @cached_property
    def unscored(self) -> DataFrame:
        """Rows that are in no uplift bin because a column is missing or no model applies."""
        keys = self.spec.keys
        scored = self.uplift_bins.groupBy(*keys).agg(F.sum("n").alias("n_scored"))
        counted = on_keys(self.completeness.select(*keys, "n_rows"), scored, keys)
        missing = F.col("n_rows") - F.coalesce("n_scored", F.lit(0))
        return counted.select(*keys, "n_rows", missing.cast("long").alias("n_unscored"))

    # -- quality and guardrails ----------------------------------------------------------

    @cached_property
    def _checks(self) -> DataFrame:
        """Flag quality and completeness from one pass."""
        s = self.spec
        flags = [c for c in (s.arm, s.metric, s.post_covariate, s.exposure) if c]
        counts = quality.flag_counts(flags) + suffstats.completeness_counts(s)
        return durable(self.log.groupBy(*s.keys).agg(*counts))

    def require_clean_flags(self) -> None:
        """Stop when a flag holds anything but 0 and 1; ``quality`` has the counts."""
        quality.require_clean_flags(self._checks)

    @cached_property
    def quality(self) -> DataFrame:
        return self._checks.drop("n_complete", "n_dropped")

    @cached_property
    def completeness(self) -> DataFrame:
        return self._checks.select(*self.spec.keys, "n_rows", "n_complete", "n_dropped")

    @cached_property
    def arms(self) -> DataFrame:
        return suffstats.arm_summary(self.cells, self.spec)

    @cached_property
    def counts(self) -> DataFrame:
        pairs = suffstats.arm_pairs(self.cells, self.spec, ("n",))
        return pairs.select(
            *self.spec.keys,
            F.coalesce("t_n", F.lit(0)).cast("long").alias("n_treatment"),
            F.coalesce("c_n", F.lit(0)).cast("long").alias("n_control"),
        )

    @cached_property
    def srm(self) -> DataFrame:
        return guardrails.srm_check(self.counts, self.spec)

    @cached_property
    def srm_sensitivity(self) -> DataFrame:
        return guardrails.srm_sensitivity(self.counts, self.spec)

    @cached_property
    def balance_features(self) -> DataFrame:
        return guardrails.balance_features(self.cells, self.spec)

    @cached_property
    def balance(self) -> DataFrame:
        return guardrails.balance_check(self.cells, self.spec)

    # -- power and effects -----------------------------------------------------------------

    @cached_property
    def power(self) -> DataFrame:
        return power.power_summary(self.cells, self.spec)

    @cached_property
    def power_grid(self) -> DataFrame:
        return power.power_grid(self.cells, self.spec)

    @cached_property
    def pairs(self) -> DataFrame:
        return paired_moments(self.cells, self.spec, "xs")

    @cached_property
    def effects(self) -> DataFrame:
        """Estimates of the keys whose sample ratio holds; the others are withheld."""
        return guardrails.gate(effects.estimates(self.pairs, self.spec), self.srm, self.spec)

    @cached_property
    def cuped(self) -> DataFrame:
        return effects.cuped_diagnostics(self.pairs, self.spec)

    @cached_property
    def lin(self) -> DataFrame:
        return effects.lin_diagnostics(self.pairs, self.spec)

    @cached_property
    def cuped_post(self) -> DataFrame:
        """The tempting but wrong adjustment, on a covariate the treatment moves."""
        post = paired_moments(self.cells, self.spec, "xn")
        return effects.estimates(post, self.spec, ("cuped",), suffix=f"[{self.spec.post_covariate}]")

    @cached_property
    def cuped_post_diagnostics(self) -> DataFrame:
        post = paired_moments(self.cells, self.spec, "xn")
        return effects.cuped_diagnostics(post, self.spec, pre_assignment=False)

    @cached_property
    def complier(self) -> DataFrame:
        return effects.complier_effects(self.pairs, self.spec)

    @cached_property
    def ancova(self) -> DataFrame:
        return anc.ancova(self.cells, self.spec, ("pooled", "within", "lin"))

    @cached_property
    def index_gain(self) -> DataFrame:
        r2 = models.mean_index_r2(self.index_models, self.spec)
        return anc.index_gain(self.ancova, r2, self.spec)

    @cached_property
    def sequential(self) -> DataFrame:
        return sequential.always_valid(self.pairs, self.spec)

    # -- robustness, uplift, decision -----------------------------------------------------

    @cached_property
    def spec_curve(self) -> DataFrame:
        return robustness.spec_curve(self.choice_cells, self.spec)

    @cached_property
    def spec_curve_summary(self) -> DataFrame:
        return robustness.spec_curve_summary(self.spec_curve, self.spec)

    @cached_property
    def uplift(self) -> DataFrame:
        return uplift.uplift_table(self.uplift_bins, self.spec)

    @cached_property
    def qini_curve(self) -> DataFrame:
        return uplift.qini_curve(self.uplift, self.spec)

    @cached_property
    def uplift_summary(self) -> DataFrame:
        return uplift.uplift_summary(self.uplift, self.spec)

    @cached_property
    def decision(self) -> DataFrame:
        curve = self.spec_curve_summary if self.choices else None
        return decision.ship_decision(self.effects, self.spec, curve, self.balance, self.srm)

    @cached_property
    def summary(self) -> DataFrame:
        """One row per key: the decision and the headline figures behind it."""
        keys = self.spec.keys
        treated = self.arms.filter(F.col(self.spec.arm) == 1)
        return decision.experiment_summary(
            self.decision, self.spec,
            split=treated.select(*keys, F.col("split_label").alias("label")),
            srm=self.srm.select(*keys, "status", "z_score", "p_value", "underdispersed"),
            cuped=self.cuped.select(
                *keys, "observed_variance_reduction", "observed_ci_width_reduction", "covariate_status"
            ),
            power=self.power.select(
                *keys, "baseline_rate", "mde_relative", "n_control_required", "powered",
                "achieved_power", "smallest_detectable_lift",
            ),
            sequential=self.sequential.select(*keys, "always_valid_ci_low", "always_valid_ci_high", "width_penalty"),
            uplift=self.uplift_summary.select(
                *keys, "qini_ratio", "heterogeneity_p", "share_of_effect_in_top_share"
            ),
        )
