"""All queries of the library, without the subpackage llm."""

from __future__ import annotations

from figloom.plans import benchmark, corpus, shredding, stages, statistics

MODULES = (corpus, benchmark, statistics, stages, shredding)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
