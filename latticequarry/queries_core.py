"""All queries of the engine's own operators."""

from . import queries_mining, queries_recommend, queries_runs

QUERIES = {**queries_mining.QUERIES, **queries_runs.QUERIES, **queries_recommend.QUERIES}
ORACLE = {**queries_mining.ORACLE, **queries_runs.ORACLE, **queries_recommend.ORACLE}
