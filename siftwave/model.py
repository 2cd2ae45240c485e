"""The event record and the constants that the rest agrees on."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("pubkey", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("tags", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("content", T.StringType()),
        T.StructField("sig", T.StringType()),
    ]
)

TEXT_KINDS = (0, 1, 20, 21, 22, 1063, 1111, 1222, 1244, 1617, 1621, 1622, 9802, 30017, 30018, 30023, 30024, 30311, 30402, 31922, 31923, 34550)
TRENDING_KINDS = (1, 1111, 9802, 30023)

#: field boosts of free text
BOOSTS = {"title": 3.0, "summary": 1.5, "content": 1.0}
TIER_WEIGHT, RECENCY_WEIGHT, RECENCY_DAYS, SKEW_S = 0.5, 1.0, 365, 300
BM25_K1, BM25_B = 1.2, 0.75

DAY, WEEK, LAG_S = 86_400, 604_800, 21_600
HALF_LIFE_S = 6 * 3600
MAX_CLIENTS, MAX_RELAYS, MAX_CLIENT_BYTES = 1024, 8192, 64
MAX_TOKEN_BYTES = 40
DAMPING, ITERATIONS, MAX_NODES = 0.85, 20, 5_000_000
