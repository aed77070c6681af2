"""Experiment analysis on Spark: every analysis is a DataFrame -> DataFrame operator."""

from .plans.experiment import ExperimentReport
from .spec import ExperimentSpec

__all__ = ["ExperimentReport", "ExperimentSpec"]
