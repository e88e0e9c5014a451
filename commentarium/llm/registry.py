"""Names of the queries of this subpackage and their SQL."""

from importlib import import_module

MODULES = ("terms", "topn", "lookalikes", "tokens", "leaks", "near_copies", "languages", "abuse", "pii", "clusters")


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(f"commentarium.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= import_module(f"commentarium.llm.{name}").SQL
    return found
