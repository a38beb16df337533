"""FNV-1a 64 of text, as 16 hexadecimal digits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of FNV-1a 64.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a_bytes(data: bytes) -> str:
    h = OFFSET
    for byte in data:
        h = (h ^ byte) * PRIME & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def fnv1a(column: Column) -> Column:
    """For equality with stored fingerprints; where none is needed, ``xxhash64``
    is cheaper. The state is two halves of 32 bits, as products of whole
    numbers beyond 64 bits are errors: the prime is 2**40 + LOW, so the low half
    times 256 is carried into the high one."""
    data = column if isinstance(column, Column) else F.col(column)
    digits = F.regexp_extract_all(F.hex(data.cast("binary")), F.lit(".."), F.lit(0))
    low_prime, half = F.lit(PRIME - (1 << 40)), F.lit(0xFFFFFFFF)

    def step(h: Column, pair: Column) -> Column:
        low = h["low"].bitwiseXOR(F.conv(pair, 16, 10).cast("long"))
        product = low * low_prime
        high = h["high"] * low_prime + F.shiftrightunsigned(product, 32) + low * 256
        return F.struct(high.bitwiseAND(half).alias("high"), product.bitwiseAND(half).alias("low"))

    start = F.struct(F.lit(OFFSET >> 32).alias("high"), F.lit(OFFSET & 0xFFFFFFFF).alias("low"))
    shown = lambda h: F.lower(F.concat(F.lpad(F.hex(h["high"]), 8, "0"), F.lpad(F.hex(h["low"]), 8, "0")))
    return F.when(data.isNotNull(), F.aggregate(digits, start, step, shown))
