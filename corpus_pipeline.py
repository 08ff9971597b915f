"""The training-data pipeline over ``documents``; its stages are in ``meshlake.llm.pipeline``."""

from meshlake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
