"""Queries over token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, packing, rangecoder, sharding
from .registry import query, table


@query("op7_packing")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op2_sharding")
def sharded(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign(table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op5_bpe")
def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), ["doc_id"], digests=True)


@query("op3_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    return rangecoder.round_trip(table(spark, folder, "documents"))
