"""All queries of the library but those of the llm subpackage."""

from __future__ import annotations

from lanternsift.plans import registry, registry_extra, registry_metrics  # noqa: F401  (they fill the tables)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
