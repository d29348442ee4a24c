"""The corpus pipeline; its stages are described in ``auditspark.llm.stages``.

Stages take (spark, docs, sf_dir); ``run`` applies them to the documents table. Trained models and packing have no SQL
form, so ``ORACLE_SQL`` is None and the stages are tested against brute force.
"""

from auditspark.llm.stages import ORACLE_SQL, STAGES, drop_exact_copies, drop_near_copies, drop_toxic, keep_known_languages, pack, run

__all__ = ["ORACLE_SQL", "STAGES", "drop_exact_copies", "drop_near_copies", "drop_toxic", "keep_known_languages", "pack", "run"]
