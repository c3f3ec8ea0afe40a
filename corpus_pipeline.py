"""The corpus pipeline: STAGES, each calling one of the operators, and run(), as they stand in treeloom.llm.pipeline."""

from treeloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
