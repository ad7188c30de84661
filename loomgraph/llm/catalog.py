"""The registered queries of this subpackage and their SQL."""

from . import ann, kmeans, lm, mixing, neardup, pieces, quality, ranked, suffixes, tokenfiles, topk, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_lm": lm.op3_lm,
    "op4_token_counts": tokenfiles.op4_token_counts,
    "op5_nearest": ann.op5_nearest,
    "op6_warc": warc.op6_warc,
    "op7_quality": quality.op7_quality,
    "op8_neardup": neardup.op8_neardup,
    "op9_pieces": pieces.op9_pieces,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_ranked": ranked.op11_ranked,
    "op12_suffix_dedup": suffixes.op12_suffix_dedup,
    "op13_kmeans": kmeans.op13_kmeans,
}

ORACLES = {
    "op6_warc": warc.ORACLE,
    "op10_exact_topk": topk.ORACLE,
    "op11_ranked": ranked.ORACLE,
    "op13_kmeans": kmeans.ORACLE,
}
