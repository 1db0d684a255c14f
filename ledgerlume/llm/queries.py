"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import align, bpe, chat, collocations, decontaminate, exact_dedup, langid, license_scan, minhash, pii, quality, repeats, toxicity

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_pii": pii.op3_pii,
    "op4_near_dedup": minhash.op4_near_dedup,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_language_id": langid.op6_language_id,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_chat_format": chat.op9_chat_format,
    "op10_quality": quality.op10_quality,
    "op11_tokenizer_alignment": align.op11_tokenizer_alignment,
    "op12_substring_dedup": repeats.op12_substring_dedup,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op9_chat_format": chat.OP9_SQL,
    "op12_substring_dedup": repeats.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
