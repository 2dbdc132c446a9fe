"""The corpus pipeline: ``STAGES``, ``run`` and ``ORACLE_SQL``; see ``codestrata.llm.pipeline``."""

from codestrata.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
