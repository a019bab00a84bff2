"""The corpus queries and their SQL oracles, as the driver registers them."""

import corpus_pipeline
from quillframe.llm import ann, byte_cnn, exact_dedup, licenses, mixing, near_dedup, pieces, pii, secrets_scan, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "pipeline": corpus_pipeline.run,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_pii": pii.op3_pii,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_nearest": ann.op5_nearest,
    "op6_sample_pieces": pieces.op6_sample_pieces,
    "op7_quality": byte_cnn.op7_quality,
    "op8_secrets": secrets_scan.op8_secrets,
    "op9_licenses": licenses.op9_licenses,
}
ORACLES = {
    "op4_near_dedup": near_dedup.ORACLE,
    "op9_licenses": licenses.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
