"""A filter of hashed keys as bitmaps, with DataFrame functions only, that spares rows a shuffle.

Each key sets one bit. The bitmaps are pieces of 32,768 bits; those that hold a bit are broadcast, and rows
meet theirs by number. The filter has 32 bits a key (about 3 % of other rows pass) up to MAX_BITS, 64 MB, which
bounds the broadcast; with more keys than that more other rows pass. It never loses a row whose key is in
it, so callers that group or join afterwards have exact results at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 15
MAX_BITS = 1 << 29


def bits_for(n_keys: int) -> int:
    """Size of the filter for so many keys: a power of two from PIECE to MAX_BITS."""
    return min(MAX_BITS, max(PIECE, 1 << (32 * n_keys - 1).bit_length())) if n_keys else PIECE


def passing(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose key (long, no null) may be among keys (one long column): all that are, and a few others."""
    name = keys.columns[0]
    bits = bits_for(keys.count())
    slot = lambda k: F.pmod(k, F.lit(bits).cast("long"))
    in_piece = lambda k: slot(k) % PIECE
    number = lambda k: F.floor(slot(k) / PIECE).cast("int")
    pieces = keys.groupBy(number(F.col(name)).alias("__piece")).agg(F.bitmap_construct_agg(in_piece(F.col(name))).alias("__bits"))
    met = rows.withColumn("__key", key).join(F.broadcast(pieces), number(F.col("__key")) == F.col("__piece"))
    at = in_piece(F.col("__key"))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1
    return met.where(held).drop("__key", "__piece", "__bits")
