"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from .bpe import op4_duckdb_bpe
from .lm import op10_gated_recurrent
from .media import op8_mpeg_audio
from .mixing import op6_split_tree_mix
from .neardup import op3_odd_sketches
from .pages import op1_page_differencing
from .quality import op2_weak_supervision
from .resample import SQL_OP12, op12_importance_resampling
from .sharding import op9_feistel_shards
from .spelling import SQL_OP11, op11_spelling_variants
from .tokenids import op13_range_numerals
from .tokencount import op7_transducer_counts
from .urls import op5_template_tree

QUERIES = {f.__name__: f for f in (op1_page_differencing, op2_weak_supervision, op3_odd_sketches, op4_duckdb_bpe, op5_template_tree, op6_split_tree_mix, op7_transducer_counts, op8_mpeg_audio, op9_feistel_shards, op10_gated_recurrent, op11_spelling_variants, op12_importance_resampling, op13_range_numerals)}

SQL: dict[str, str] = {"op11_spelling_variants": SQL_OP11, "op12_importance_resampling": SQL_OP12}
