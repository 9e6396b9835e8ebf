"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pairloom.llm import (
    chat, decontaminate, fingerprints, html_text, licenses, mixing, near_copies, neighbours, periodic_runs, personal_data, quality, toxicity,
    turn_repair,
)

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_quality": quality.op2_quality,
    "op3_licenses": licenses.op3_licenses,
    "op4_chat_format": chat.op4_chat_format,
    "op5_html_text": html_text.op5_html_text,
    "op6_mixing": mixing.op6_mixing,
    "op7_near_copies": near_copies.op7_near_copies,
    "op8_personal_data": personal_data.op8_personal_data,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_nearest_vectors": neighbours.op12_nearest_vectors,
    "op13_turn_repair": turn_repair.op13_turn_repair,
}
ORACLES = {"op4_chat_format": chat.OP4_SQL, "op6_mixing": mixing.OP6_SQL, "op10_decontamination": decontaminate.OP10_SQL,
           "op11_periodic_runs": periodic_runs.OP11_SQL, "op13_turn_repair": turn_repair.OP13_SQL}
