"""Loads every suite module and exposes the filled registries."""

from visitframe.plans import (suite_pit, suite_columns, suite_joins, suite_profile, suite_splits, suite_metrics,  # noqa: F401
                              suite_sources, suite_models, suite_text)
from visitframe.plans.suite import ORACLES, QUERIES  # noqa: F401
