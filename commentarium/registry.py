"""Names of the queries of the core and their SQL."""

from importlib import import_module

MODULES = ("plans.clean", "plans.sentiment", "plans.analysis", "plans.extra", "plans.shown")
FLAGSHIP = "agg2_sentiment_over_time"


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(f"commentarium.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= import_module(f"commentarium.{name}").SQL
    return found
