"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import pipeline
from .ann import op1_nearest_vectors
from .chat_format import op3_chat_windows
from .line_dedup import OP4_SQL, op4_line_dedup
from .mixing import op5_mix_sources
from .ngram_join import op6_ngram_join
from .packing import op2_best_fit_packing
from .quality_classifier import op8_quality_classifier
from .quality_rules import op9_quality_rules
from .substring_dedup import op10_substring_dedup
from .warc_revisits import OP7_SQL, op7_revisit_resolution

QUERIES = {
    f.__name__: f
    for f in (
        op1_nearest_vectors,
        op2_best_fit_packing,
        op3_chat_windows,
        op4_line_dedup,
        op5_mix_sources,
        op6_ngram_join,
        op7_revisit_resolution,
        op8_quality_classifier,
        op9_quality_rules,
        op10_substring_dedup,
    )
} | {"pipeline": pipeline.run}
ORACLE_SQL: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op7_revisit_resolution": OP7_SQL}
