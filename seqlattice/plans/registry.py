"""Every registered query over the given tables, and the SQL that checks it where SQL can express it."""

from __future__ import annotations

from . import queries_align, queries_kernels, queries_model, queries_sim

QUERIES = {**queries_align.QUERIES, **queries_model.QUERIES, **queries_kernels.QUERIES, **queries_sim.QUERIES}
ORACLE_SQL = {**queries_align.ORACLE_SQL, **queries_model.ORACLE_SQL, **queries_kernels.ORACLE_SQL, **queries_sim.ORACLE_SQL}
