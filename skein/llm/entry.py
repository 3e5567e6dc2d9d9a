"""The corpus operators' queries and SQL, for the driver's contract."""

from __future__ import annotations

from skein.llm import chat, decontam, fingerprints, licenses, minhash, phrases, sentencepiece_ops, simhash, suffix_dedup, toxicity, url_filters, vector_codes, warc

QUERIES: dict = {
    "op1_sentencepiece": sentencepiece_ops.op1_sentencepiece,
    "op2_simhash": simhash.op2_simhash,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_warc": warc.op7_warc,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_chat_format": chat.op9_chat_format,
    "op10_decontaminate": decontam.op10_decontaminate,
    "op11_phrases": phrases.op11_phrases,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_minhash": minhash.op13_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op8_url_filters": url_filters.OP8_SQL,
    "op9_chat_format": chat.OP9_SQL,
    "op11_phrases": phrases.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
}
