"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import contamination, jaccard, languages, licenses, lines, mixing, phrases, quality, secrets, suffixes, toxicity, urls, vectors

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_quality_divergence": quality.op2_quality_divergence,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_ngram_jaccard_join": jaccard.op5_ngram_jaccard_join,
    "op6_url_rules": urls.op6_url_rules,
    "op7_benchmark_decontamination": contamination.op7_benchmark_decontamination,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_source_mixing": mixing.op10_source_mixing,
    "op11_phrase_collocations": phrases.op11_phrase_collocations,
    "op12_vector_codes": vectors.op12_vector_codes,
    "op13_language_id": languages.op13_language_id,
}
ORACLE = {
    "op2_quality_divergence": quality.OP2_SQL,
    "op4_line_dedup": lines.OP4_SQL,
    "op5_ngram_jaccard_join": jaccard.OP5_SQL,
    "op6_url_rules": urls.OP6_SQL,
    "op7_benchmark_decontamination": contamination.OP7_SQL,
    "op8_suffix_dedup": suffixes.OP8_SQL,
    "op10_source_mixing": mixing.OP10_SQL,
    "op11_phrase_collocations": phrases.OP11_SQL,
    "op12_vector_codes": vectors.OP12_SQL,
}
