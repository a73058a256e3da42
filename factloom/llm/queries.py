"""The registered queries of this package and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, licenses, media, minhash, ngramjoin, packing, quality, repair, secrets, sharding, topk, urlfilter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": minhash.op1_minhash,
    "op2_media": media.op2_media,
    "op3_bpe": bpe.op3_bpe,
    "op4_secrets": secrets.op4_secrets,
    "op5_topk": topk.op5_topk,
    "op7_quality": quality.op7_quality,
    "op6_urlfilter": urlfilter.op6_urlfilter,
    "op8_licenses": licenses.op8_licenses,
    "op9_sharding": sharding.op9_sharding,
    "op10_packing": packing.op10_packing,
    "op11_repair": repair.op11_repair,
    "op12_whitening": whitening.op12_whitening,
    "op13_ngram_join": ngramjoin.op13_ngram_join,
    "packing_turns": packing.packing_turns,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash": minhash.OP1_SQL,
    "op5_topk": topk.OP5_SQL,
    "op6_urlfilter": urlfilter.OP6_SQL,
    "op8_licenses": licenses.OP8_SQL,
    "op11_repair": repair.OP11_SQL,
    "op13_ngram_join": ngramjoin.OP13_SQL,
}
