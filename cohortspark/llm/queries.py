"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from cohortspark.llm import byte_bpe, collocations, decontamination, language, lines, packing, secrets, simhash, sketches, substrings, toxicity, warc, whitening

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_warc": warc.op3_warc,
    "op4_substrings": substrings.op4_substrings,
    "op5_packing": packing.op5_packing,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_language": language.op7_language,
    "op8_lines": lines.op8_lines,
    "op9_fingerprints": sketches.op9_fingerprints,
    "op10_secrets": secrets.op10_secrets,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_whitening": whitening.op12_whitening,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {
    "op3_warc": warc.OP3_SQL,
    "op4_substrings": substrings.OP4_SQL,
    "op8_lines": lines.OP8_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
