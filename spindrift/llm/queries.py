"""The training-data queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from spindrift.llm import fim, manifest
from spindrift.llm.chat import op7_chat_formatting
from spindrift.llm.decontam import op9_benchmark_decontamination
from spindrift.llm.fim import op12_fill_in_middle
from spindrift.llm.jaccard_join import op2_ngram_jaccard_join
from spindrift.llm.langid import op10_language_id
from spindrift.llm.lm_score import op4_lm_scoring
from spindrift.llm.manifest import op11_merkle_manifest
from spindrift.llm.media import op5_media_columns
from spindrift.llm.mixing import op8_source_mixing
from spindrift.llm.pieces import op13_sentencepiece
from spindrift.llm.quality import op6_quality_classifier
from spindrift.llm.suffix_dedup import op1_suffix_array_dedup
from spindrift.llm.token_store import op3_token_store

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_ngram_jaccard_join,
        op3_token_store,
        op4_lm_scoring,
        op5_media_columns,
        op6_quality_classifier,
        op7_chat_formatting,
        op8_source_mixing,
        op9_benchmark_decontamination,
        op10_language_id,
        op11_merkle_manifest,
        op12_fill_in_middle,
        op13_sentencepiece,
    )
}

ORACLES: dict[str, str] = {"op11_merkle_manifest": manifest.ORACLE, "op12_fill_in_middle": fim.ORACLE}
