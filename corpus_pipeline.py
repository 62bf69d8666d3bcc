"""Corpus pipeline over documents; the stages are in `orrery/llm/stages.py`.

`run` applies STAGES in order: each works on the Parquet rows that the one before it kept.
"""

from orrery.llm.stages import COLUMNS, STAGES, run

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
