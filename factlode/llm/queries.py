"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from . import chat, decontamination, fingerprints, licenses, lm, mixing, repeats, secrets, simhash, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_repeats": repeats.op3_repeats,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_chat": chat.op5_chat,
    "op6_lm": lm.op6_lm,
    "op7_simhash": simhash.op7_simhash,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_licenses": licenses.op9_licenses,
    "op10_secrets": secrets.op10_secrets,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op3_repeats": repeats.ORACLE_SQL,
    "op4_decontamination": decontamination.ORACLE_SQL,
    "op5_chat": chat.ORACLE_SQL,
    "op9_licenses": licenses.ORACLE_SQL,
    "op10_secrets": secrets.ORACLE_SQL,
}
