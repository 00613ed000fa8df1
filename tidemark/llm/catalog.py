"""The queries of this subpackage and their SQL: each operator's module holds an ``opN_`` function and perhaps an ``OPN_SQL``."""

from __future__ import annotations

import importlib
import pkgutil


def _modules() -> list:
    package = importlib.import_module(__package__)
    names = [m.name for m in pkgutil.iter_modules(package.__path__) if m.name != "catalog"]
    return [importlib.import_module(f"{__package__}.{n}") for n in sorted(names)]


def _own(module) -> dict:
    return {n: f for n, f in vars(module).items() if n.startswith("op") and n[2:3].isdigit() and callable(f) and f.__module__ == module.__name__}


def queries() -> dict:
    return {n: f for m in _modules() for n, f in _own(m).items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for m in _modules() for n in _own(m) if (sql := getattr(m, f"OP{n[2:].split('_')[0]}_SQL", None))}
