"""Operator 7: shards by jump consistent hashing, in DataFrame functions only.

A key walks through a 64-bit linear congruential sequence; each step jumps to a shard further on, and
the last jump below the shard count is the key's shard. No ring table is kept, and with one more shard
a key either stays or moves to the new one. Products modulo 2**64 are formed in limbs that fit a
long, so nothing overflows under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

# Fixed values of the jump hash: the multiplier 2862933555777941757 of its generator, in two halves, and 2**31.
MULTIPLIER_HIGH, MULTIPLIER_LOW = divmod(2862933555777941757, 1 << 32)
UNIT = float(1 << 31)
MASK = 0xFFFFFFFF


def _low_product(a: Column, b: int) -> Column:
    """The low 32 bits of a * b, both below 2**32."""
    return (a * F.lit(b & 0xFFFF) + F.shiftleft((a * F.lit(b >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(F.lit(MASK))


def _step(s: Column) -> Column:
    """The state after one turn of the generator: key = key * multiplier + 1, shard = next, next = the jump's end."""
    high, low = s["high"], s["low"]
    upper = low * F.lit(MULTIPLIER_LOW >> 16)
    total = low * F.lit(MULTIPLIER_LOW & 0xFFFF) + F.shiftleft(upper.bitwiseAND(0xFFFF), 16) + F.lit(1)
    carry = F.shiftright(total, 32) + F.shiftright(upper, 16)
    new_high = (carry + _low_product(low, MULTIPLIER_HIGH) + _low_product(high, MULTIPLIER_LOW)).bitwiseAND(F.lit(MASK))
    jump = F.floor((s["next"] + 1).cast("double") * (F.lit(UNIT) / (F.shiftright(new_high, 1) + 1).cast("double")))
    return F.struct(new_high.alias("high"), total.bitwiseAND(F.lit(MASK)).alias("low"), s["next"].alias("shard"), jump.alias("next"))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to shards-1 of a long key (null: as key 0). At most ``shards`` jumps, as each goes at least one shard on."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(MASK)).alias("low"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    turns = F.sequence(F.lit(1), F.lit(shards))
    walked = F.aggregate(turns, start, lambda s, _: F.when(s["next"] < shards, _step(s)).otherwise(s))
    return walked["shard"].cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows with size, text_crc32, law, shard, slot and grown_shard (the shard with one shard more).

    Null text counts as empty; a null key is dealt as key 0. Repeated rows share their shard and get
    slots of their own. Input columns with these six names are replaced. Slots are gapless from 0 in
    each shard, numbered in hash buckets, so that no task holds a whole shard.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    made = {"size": F.octet_length(body).cast("long") + 16, "text_crc32": F.crc32(body), "law": F.lit("key"), "shard": jump_shard(F.col(key), shards), "grown_shard": jump_shard(F.col(key), shards + 1)}
    placed = docs.drop("slot").withColumns(made)
    return numbered(placed, ["shard"], [key, "text_crc32", "size"], "slot")
