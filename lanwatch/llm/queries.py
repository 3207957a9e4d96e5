"""Registered queries of this package: name -> (query, SQL or None)."""

from __future__ import annotations

from . import (chat, decontaminate, divergence, language, licenses, lm, pieces, secrets, simhash, sketch, spelling,
               tokencount, topk)

ENTRIES = {
    "op1_lm": (lm.query, None),
    "op2_chat": (chat.query, None),
    "op3_simhash": (simhash.query, None),
    "op4_secrets": (secrets.query, secrets.SQL),
    "op5_sketch": (sketch.query, None),
    "op6_tokencount": (tokencount.query, None),
    "op7_decontaminate": (decontaminate.query, decontaminate.SQL),
    "op8_pieces": (pieces.query, None),
    "op9_licenses": (licenses.query, None),
    "op10_language": (language.query, None),
    "op11_topk": (topk.query, topk.SQL),
    "op12_divergence": (divergence.query, divergence.SQL),
    "op13_spelling": (spelling.query, None),
}
