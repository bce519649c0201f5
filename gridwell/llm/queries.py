"""The registered queries of this subpackage, and their SQL where it can say the same."""

from __future__ import annotations

from . import bpe, chat, decontaminate, htmltext, jaccard, media, mixing, quality, spelling, tokenbin, toxicity, urlfilter, whitening


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_media": media.op2_media,
        "op3_chat": chat.op3_chat,
        "op4_token_files": tokenbin.op4_token_files,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_html_text": htmltext.op6_html_text,
        "op7_jaccard_join": jaccard.op7_jaccard_join,
        "op8_url_filters": urlfilter.op8_url_filters,
        "op9_bpe": bpe.op9_bpe,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_decontamination": decontaminate.op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.OP1_SQL, "op8_url_filters": urlfilter.OP8_SQL, "op12_spelling_variants": spelling.OP12_SQL, "op13_decontamination": decontaminate.OP13_SQL}
