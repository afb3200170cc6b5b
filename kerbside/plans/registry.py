"""All queries of the engine's own operators."""

from __future__ import annotations

from kerbside.plans import boards, contexts, live, motion, reports, rules, scripted, series, tools

FAMILIES = (motion, series, reports, boards, live, rules, contexts, tools, scripted)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL = {name: sql for family in FAMILIES for name, sql in family.ORACLE_SQL.items()}
