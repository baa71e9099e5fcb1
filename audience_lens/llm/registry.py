"""Queries of the corpus operators and, where SQL can express them, their twins."""

from __future__ import annotations

import corpus_pipeline
from audience_lens.llm import merkle, warc
from audience_lens.llm.ann import op5_nearest_vectors
from audience_lens.llm.chunk_bpe import op6_chunk_bpe
from audience_lens.llm.conversations import op13_conversation_repair
from audience_lens.llm.jaccard_join import op4_jaccard_join
from audience_lens.llm.merkle import op12_merkle_manifest
from audience_lens.llm.packing import op8_best_fit_packing
from audience_lens.llm.quality import op1_quality_rules
from audience_lens.llm.secrets import op10_secret_scan
from audience_lens.llm.suffix_dedup import op9_suffix_dedup
from audience_lens.llm.token_counts import op7_token_counts
from audience_lens.llm.token_files import op2_token_files
from audience_lens.llm.toxicity import op3_toxicity
from audience_lens.llm.warc import op11_warc

QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_token_files, op3_toxicity, op4_jaccard_join, op5_nearest_vectors,
    op6_chunk_bpe, op7_token_counts, op8_best_fit_packing, op9_suffix_dedup, op10_secret_scan,
    op11_warc, op12_merkle_manifest, op13_conversation_repair)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE_SQL: dict[str, str] = {"op11_warc": warc.SQL, "op12_merkle_manifest": merkle.SQL}
