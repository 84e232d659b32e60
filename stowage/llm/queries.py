"""The corpus queries and their SQL."""

from __future__ import annotations

from . import chat, dedup, jaccard, licences, mixing, packing, pii, planes, quality, sharding

QUERIES = {
    "op1_sharding": sharding.op1,
    "op2_pii": pii.op2,
    "op3_quality": quality.op3,
    "op4_packing": packing.op4,
    "op5_mixing": mixing.op5,
    "op6_planes": planes.op6,
    "op7_exact_dedup": dedup.op7,
    "op8_chat": chat.op8,
    "op9_licences": licences.op9,
    "op10_jaccard": jaccard.op10,
}

ORACLE_SQL = {
    "op1_sharding": sharding.OP1_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op7_exact_dedup": dedup.OP7_SQL,
    "op9_licences": licences.OP9_SQL,
}
