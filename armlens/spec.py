"""The description of one experiment, shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, replace
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()


@dataclass(frozen=True)
class ExperimentSpec:
    """Which columns carry the experiment, and the design decisions around it.

    ``keys`` turns every operator into its segmented form: one result row (or
    table) per key combination, computed in the same pass over the log.
    """

    arm: str = "treatment"
    metric: str = "conversion"
    features: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    covariate: str | None = None
    post_covariate: str | None = None
    exposure: str | None = None
    fold: str | None = None
    n_folds: int = 2
    # A number, or the name of a key-level column holding each experiment's share.
    design_share: float | str = 0.85
    alpha: float = 0.05
    power: float = 0.80
    mde: float = 0.05
    mde_grid: tuple[float, ...] = (0.01, 0.02, 0.05, 0.10, 0.20)
    min_lift: float = 0.10
    srm_threshold: float = 0.001
    underdispersion_threshold: float = 0.01
    smd_threshold: float = 0.10
    shuffle_tolerance: float = 0.01
    # Size (n_t * n_c / (n_t + n_c)) at which the always-valid interval is tightest; it holds at any.
    n_planned: float = 1e6
    # (feature, constant) pairs subtracted before products are summed.
    shift: tuple[tuple[str, float], ...] = ()

    def __post_init__(self):
        if not isinstance(self.design_share, str) and not 0.0 < self.design_share < 1.0:
            raise ValueError("design_share must lie strictly between 0 and 1")
        for name in ("features", "keys", "mde_grid"):
            object.__setattr__(self, name, tuple(getattr(self, name)))

    def with_keys(self, *keys: str) -> "ExperimentSpec":
        return replace(self, keys=tuple(keys))

    def with_features(self, *features: str) -> "ExperimentSpec":
        return replace(self, features=tuple(features))

    @property
    def z_crit(self) -> float:
        """Two-sided normal critical value at ``alpha``."""
        return _NORMAL.inv_cdf(1.0 - self.alpha / 2.0)

    @property
    def z_power(self) -> float:
        return _NORMAL.inv_cdf(self.power)

    @property
    def srm_z_limit(self) -> float:
        """|z| at which the one-degree chi-square p-value equals the SRM threshold."""
        return _NORMAL.inv_cdf(1.0 - self.srm_threshold / 2.0)

    @property
    def closeness_z_limit(self) -> float:
        """|z| below which P(|Z| < |z|) is under the under-dispersion threshold."""
        return _NORMAL.inv_cdf(0.5 + self.underdispersion_threshold / 2.0)

    def share_column(self) -> Column:
        if isinstance(self.design_share, str):
            return F.col(self.design_share)
        return F.lit(float(self.design_share))

    def shift_of(self, feature: str) -> float:
        return dict(self.shift).get(feature, 0.0)

    def feature_text(self, feature: str) -> str:
        """The feature as a double in SQL, moved by its shift constant when one is set."""
        name = "`" + feature.replace("`", "``") + "`"
        shift = self.shift_of(feature)
        cast = f"CAST({name} AS DOUBLE)"
        return f"({cast} - CAST('{shift!r}' AS DOUBLE))" if shift else cast

    def feature_column(self, feature: str) -> Column:
        return F.expr(self.feature_text(feature))
