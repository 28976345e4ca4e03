"""loadgrid: utility interval-data analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    table catalog (parquet / JDBC / bulk-unload files), control files, file listing, audit store
functions  scalar ``Column`` builders and row predicates (no Python UDFs)
operators  reusable relational operators: dedupe, intervals, islands, set rewrites, units,
           calendar, time-series quality and DST, audit gates
plans      dataset builders (study, meters, bills, reads ...), run modes, and the
           driver-table queries with their SQL oracles
llm        training-data operators (independent of the rest)
"""

__all__ = ["session"]
