"""The queries of this folder by name, and their SQL where SQL can express them."""

from . import chat, decontaminate, licenses, lm, packing, pages, quality, repair, setjoin, simhash, spelling, suffix, tokens

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_chat": chat.op2_chat,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_pages": pages.op4_pages,
    "op5_packing": packing.op5_packing,
    "op6_quality": quality.op6_quality,
    "op7_lm": lm.op7_lm,
    "op8_tokens": tokens.op8_tokens,
    "op9_licenses": licenses.op9_licenses,
    "op10_suffix": suffix.op10_suffix,
    "op11_spelling": spelling.op11_spelling,
    "op12_repair": repair.op12_repair,
    "op13_jaccard": setjoin.op13_jaccard,
}
ORACLE: dict[str, str] = {}
