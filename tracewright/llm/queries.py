"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import ann, bpe, chat, ctw, decontam, langid, licences, minhash, secrets, sharding

QUERIES = {
    "op1_preference_format": chat.query,
    "op2_language_id": langid.query,
    "op3_decontamination": decontam.query,
    "op4_secret_scan": secrets.query,
    "op5_sharding": sharding.query,
    "op6_bpe": bpe.query,
    "op7_ann": ann.query,
    "op8_license_scan": licences.query,
    "op9_ctw": ctw.query,
    "op10_minhash": minhash.query,
}

ORACLES: dict[str, str] = {"op1_preference_format": chat.SQL, "op7_ann": ann.SQL}
