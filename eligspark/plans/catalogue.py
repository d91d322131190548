"""Every registered query of the library, by name, with its SQL oracle."""

from __future__ import annotations

from eligspark.plans import corpus, evaluation, functions, matching, names, records, rules, search, serving, validation

MODULES = (search, matching, corpus, evaluation, serving, functions, rules, records, validation, names)
QUERIES: dict = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
