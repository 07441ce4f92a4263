"""Byte-string functions over binary keys and values, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Key bytes at most; small payloads' records carry no key in their header.
MAX_KEY, KEYLESS = 1056, 4096
KEYLESS_HEADER, KEYED_HEADER = 10, 21


def be(number: Column, width: int) -> Column:
    """A non-negative integer as ``width`` big-endian bytes."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * width, "0"))


def be_bytes(number: int, width: int) -> bytes:
    return number.to_bytes(width, "big")


def unsigned(key: Column) -> Column:
    """Up to 8 big-endian bytes as decimal(20,0); null for no bytes."""
    return F.conv(F.hex(key), 16, 10).cast("decimal(20,0)")


def purge_mark(key: Column, at: int) -> Column:
    """The big-endian u64 at byte ``at``; 0 if the key is too short to hold all of it."""
    return F.when(F.octet_length(key) >= at + 8, unsigned(F.substring(key, at + 1, 8))).otherwise(F.lit(0).cast("decimal(20,0)"))


def is_purged(key: Column, at: int, floor: int) -> Column:
    """Strictly below the floor; a floor of 0 purges nothing."""
    return purge_mark(key, at) < F.lit(str(floor)).cast("decimal(20,0)")


def shard_of(key: Column, shard_bytes: int) -> Column:
    """The leading bytes as a number, missing ones as zero."""
    if not shard_bytes:
        return F.lit(0).cast("decimal(20,0)")
    return unsigned(pad_or_cut(F.substring(key, 1, shard_bytes), shard_bytes))


def pad_or_cut(bound: Column, width: int) -> Column:
    """Exactly ``width`` bytes: zeros are added on the right, or what is over is cut."""
    return F.call_function("rpad", bound, F.lit(width), F.lit(b"\0"))


def pad_or_cut_bytes(bound: bytes, width: int) -> bytes:
    return bound[:width].ljust(width, b"\0")


def clamped(value: Column, offset: int, length: int) -> Column:
    """``length`` bytes from ``offset``, as far as there are any; an offset past the end gives no bytes, not null."""
    return F.substring(value, offset + 1, length) if offset < 2**31 - 1 else F.when(value.isNotNull(), F.lit(b""))


def successor(prefix: bytes) -> bytes | None:
    """The least byte string above all that start with prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def record_span(key: Column, length: Column) -> Column:
    """The footprint of a record: header and stored payload."""
    return F.when(length <= KEYLESS, F.lit(KEYLESS_HEADER)).otherwise(KEYED_HEADER + F.octet_length(key)) + length


def dead_fraction(dead: Column, live: Column) -> Column:
    """dead / (dead + live), 0 where there is nothing."""
    return F.coalesce(F.try_divide(dead.cast("double"), (dead + live).cast("double")), F.lit(0.0))


def droppable(held: Column, held_lsn: Column, floor: Column) -> Column:
    """Tombstone bytes that may go: all of them without a floor, none unless the newest lies below it."""
    return F.when(floor.isNull() | (held_lsn < floor), held).otherwise(F.lit(0))


def reclaimable(dead: Column, held: Column, held_lsn: Column, floor: Column) -> Column:
    return dead + droppable(held, held_lsn, floor)
