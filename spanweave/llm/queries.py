"""The queries of the training-data operators, one for each, and the DuckDB SQL of those that SQL can express."""

from spanweave.llm import ann, bpe, decontaminate, divergence, merkle, near_dup, ngram_lm, packing, quality, quotation, substring_dedup, toxicity, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_ngram_lm": ngram_lm.op2_ngram_lm,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_balanced_lists": ann.op4_balanced_lists,
    "op5_near_duplicates": near_dup.op5_near_duplicates,
    "op6_quality": quality.op6_quality,
    "op7_warc": warc.op7_warc,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_quotation_linking": quotation.op9_quotation_linking,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_packing": packing.op11_packing,
    "op12_divergence": divergence.op12_divergence,
    "op13_manifest": merkle.op13_manifest,
}
ORACLES = {
    "op7_warc": warc.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op9_quotation_linking": quotation.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_manifest": merkle.ORACLE,
}
