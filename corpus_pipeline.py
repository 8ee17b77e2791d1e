"""From raw documents to packed training sequences: STAGES, run(spark, sf_dir) and ORACLE_SQL. The stages are in tidelog.llm.pipeline."""

from tidelog.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
