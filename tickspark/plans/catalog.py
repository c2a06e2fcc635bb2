"""All registered plans."""

from tickspark.plans import model_plans, panel_plans, pricing_plans, ranking_plans, tick_plans  # noqa: F401
from tickspark.plans.registry import ORACLES, PLANS

__all__ = ["ORACLES", "PLANS"]
