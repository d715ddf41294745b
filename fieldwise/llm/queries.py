"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from fieldwise.llm.chat_format import OP6_SQL, op6_chat_format
from fieldwise.llm.decontamination import op1_benchmark_decontamination
from fieldwise.llm.fingerprints import op12_fingerprints
from fieldwise.llm.mixing import op8_mixing
from fieldwise.llm.ngram_join import OP4_SQL, op4_ngram_jaccard_join
from fieldwise.llm.quality_rules import OP5_SQL, op5_quality_rules
from fieldwise.llm.source_divergence import OP13_SQL, op13_source_divergence
from fieldwise.llm.substring_dedup import OP7_SQL, op7_substring_dedup
from fieldwise.llm.token_alignment import op11_token_alignment
from fieldwise.llm.token_counts import op9_token_counts
from fieldwise.llm.token_output import op3_token_output
from fieldwise.llm.toxicity import op10_toxicity
from fieldwise.llm.url_filter import op2_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_url_filter, op3_token_output, op4_ngram_jaccard_join, op5_quality_rules,
        op6_chat_format, op7_substring_dedup, op8_mixing, op9_token_counts, op10_toxicity,
        op11_token_alignment, op12_fingerprints, op13_source_divergence,
    )
}

ORACLE_SQL = {"op4_ngram_jaccard_join": OP4_SQL, "op5_quality_rules": OP5_SQL, "op6_chat_format": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op13_source_divergence": OP13_SQL}
