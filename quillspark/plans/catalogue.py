"""All registered queries and their SQL."""

from __future__ import annotations

from quillspark.plans import characters, corpus, roundtrips, runs, scoring, splitting, translation
from quillspark.plans.register import Query

MODULES = (scoring, splitting, translation, characters, corpus, runs, roundtrips)
QUERIES: dict[str, Query] = {name: f for module in MODULES for name, f in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
