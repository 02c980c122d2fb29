"""Queries over the tables at hand, each with the SQL that it has to agree with."""

import importlib
import pkgutil

from . import registry

for _m in pkgutil.iter_modules(__path__):
    if _m.name.endswith("_queries"):
        importlib.import_module(f"{__name__}.{_m.name}")


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return {k: registry.duck(*v) for k, v in registry.SQL.items()}
