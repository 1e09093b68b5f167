"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from loomset.llm.audio_features import op9_media_columns
from loomset.llm.importance_resampling import op12_importance_resampling, op12_sql
from loomset.llm.jaccard_join import op7_jaccard_join
from loomset.llm.licence_scan import op5_licence_scan, op5_sql
from loomset.llm.mixing import op8_source_mixing
from loomset.llm.quality_classifier import op1_quality_classifier
from loomset.llm.quality_rules import op6_quality_rules, op6_sql
from loomset.llm.sentencepiece_codec import op4_sentencepiece
from loomset.llm.spelling_variants import op11_spelling_variants, op11_sql
from loomset.llm.substring_dedup import op13_sql, op13_substring_dedup
from loomset.llm.suffix_dedup import op10_suffix_dedup
from loomset.llm.token_counts import op2_token_counts
from loomset.llm.warc_archive import op3_warc

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_token_counts": op2_token_counts,
    "op3_warc": op3_warc,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_licence_scan": op5_licence_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_source_mixing": op8_source_mixing,
    "op9_media_columns": op9_media_columns,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_substring_dedup": op13_substring_dedup,
}

SQL = {"op5_licence_scan": op5_sql(), "op6_quality_rules": op6_sql(), "op11_spelling_variants": op11_sql(), "op12_importance_resampling": op12_sql(), "op13_substring_dedup": op13_sql()}
