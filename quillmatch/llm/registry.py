"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontaminate, lm, mixing, pii, quality, quotes, secrets, shards, simhash, sql, tokens

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_mixing": mixing.op2_mixing,
    "op3_shards": shards.op3_shards,
    "op4_quotes": quotes.op4_quotes,
    "op5_tokens": tokens.op5_tokens,
    "op6_secrets": secrets.op6_secrets,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality": quality.op9_quality,
    "op10_lm": lm.op10_lm,
}

ORACLE_SQL = {
    "op7_decontaminate": sql.decontaminate_sql(),
    "op9_quality": sql.quality_sql(),
}
