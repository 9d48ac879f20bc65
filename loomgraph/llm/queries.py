"""The operators' queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from loomgraph.llm import alignment, ann, bpe, collocations, jaccard, lines, lm, mixing, neardup, quality, secrets, substring, toxicity

QUERIES: dict[str, Callable] = {
    "op1_quality_classifier": quality.op1,
    "op2_secret_scans": secrets.op2,
    "op3_line_dedup": lines.op3,
    "op4_bpe": bpe.op4,
    "op5_ann": ann.op5,
    "op6_mixing": mixing.op6,
    "op7_substring_dedup": substring.op7,
    "op8_embedding_near_dedup": neardup.op8,
    "op9_lm_scoring": lm.op9,
    "op10_ngram_jaccard_join": jaccard.op10,
    "op11_phrase_collocations": collocations.op11,
    "op12_cross_tokenizer_alignment": alignment.op12,
    "op13_toxicity": toxicity.op13,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op3_line_dedup": lines.OP3_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op11_phrase_collocations": collocations.OP11_SQL,
}
