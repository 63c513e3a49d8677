"""Training-data operators: sharding, secret scans, BPE, quality rules, fixity audits, joins, dedup, chat, packing, search, toxicity, audits.

Nothing outside this subpackage imports it. ``queries()`` and ``oracle_sql()`` are what the
driver contract registers; the operators themselves are in the sibling modules.
"""

from corpusmill.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
