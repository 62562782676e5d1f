"""Weighted rendezvous sharding of stable record keys.

Each record goes to the shard with the smallest ``-ln(u) / weight``, where ``u`` in
(0, 1) is a hash of the record key and the shard number.  A shard's share of the
records is its share of the weights, and adding a shard moves only the records that
the new shard wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecohort.llm.common import running_offsets, shuffle_partitions


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that wins ``key`` (a null key is a key like any other).

    Shards of weight 0 win nothing; ties, which need equal 53-bit hashes, go to the
    lower number.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be positive")
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(F.lit(shard), key), 11)  # 53 bits
            u = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
            scores.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("at"), F.lit(shard).alias("shard")))
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def with_shards(docs: DataFrame, weights: Sequence[float], order: Sequence[Column] = (), ties: Sequence[str] = (),
                id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, which counts a shard's rows from 0 without gaps.

    Slots follow ``order``, whose first column must split a shard's rows evenly (a file's
    number, say); without it, a hash of the id and the columns ``ties``, then these
    themselves.  Columns of these two names are replaced, all others stay as they are.
    """
    by, tied = [f"_order{i}" for i in range(len(order))], [f"_tie{i}" for i in range(len(ties))]
    # the caller's columns travel in a struct, where no helper's name can clash with theirs
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")])
    key = F.col(id_col).cast("bigint")
    rows = docs.select(
        whole.alias("_row"), key.alias("_key"), rendezvous_shard(key, weights).cast("int").alias("shard"),
        *[o.alias(n) for o, n in zip(order, by, strict=True)], *[F.col(t).alias(n) for t, n in zip(ties, tied, strict=True)],
    )
    if order:
        bucket = F.col("_order0")
    else:
        by = ["_mixed"]
        rows = rows.withColumn("_mixed", F.xxhash64("_key", *tied, F.lit(1)))
        buckets = shuffle_partitions(docs.sparkSession)
        bucket = F.floor(F.shiftrightunsigned("_mixed", 1) / F.lit(2.0**63) * buckets)
    rows = rows.withColumn("_bucket", bucket)
    totals = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = running_offsets(totals, ["_bucket"], "_n", "_before", ["shard"]).drop("_n")
    inside = Window.partitionBy("shard", "_bucket").orderBy(*by, "_key", *tied)
    same = rows["shard"].eqNullSafe(before["shard"]) & rows["_bucket"].eqNullSafe(before["_bucket"])
    numbered = rows.withColumn("_inside", F.row_number().over(inside) - 1)
    joined = numbered.join(before, same).drop(before["shard"], before["_bucket"])
    slot = (F.col("_before") + F.col("_inside")).cast("bigint")
    return joined.select("_row.*", "shard", slot.alias("slot"))


def file_order(docs: DataFrame) -> list[Column]:
    """Place of each row in the files ``docs`` was read from; empty if it wasn't read from files."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return []
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("bigint"), name, F.col("_metadata.row_index")]


def shard_records(docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float] | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 16 (null: 16), ``text_crc32`` that of the text
    (null: of the empty text).  ``grown_shard`` is the shard under ``grown_weights``.

    Repeated ids go to the same shard and have slots of their own; rows that are equal in
    all columns that are read take theirs in any order.  Null ids share one shard.  An
    empty table gives no rows.  Other columns are not read.
    """
    key = F.col(id_col).cast("bigint")
    grown = rendezvous_shard(key, grown_weights) if grown_weights is not None else F.lit(None)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        key.alias("doc_id"), (F.length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"), grown.cast("int").alias("grown_shard"),
    )
    placed = with_shards(rows, weights, ties=["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
