"""All registered queries of the engine, but for the corpus operators."""

from __future__ import annotations

from tessera.plans import physical, single, starschema, substitution, tpch

QUERIES = tpch.QUERIES | substitution.QUERIES | physical.QUERIES | starschema.QUERIES | single.QUERIES
ORACLE_SQL = tpch.ORACLE_SQL | substitution.ORACLE_SQL | physical.ORACLE_SQL | starschema.ORACLE_SQL | single.ORACLE_SQL
