"""Column families and the schemas of the log and what is derived from it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

from ..errors import ColumnFamilyNotFound, ConfigError
from ..functions.keys import MAX_KEY

DATA, TOMBSTONE, RANGE = 0, 1, 2

# Key widths that a fixed-width family may have.
FIXED_WIDTHS = (0, 2, 8, 12, 16, 20, 24, 32, 34, 36, 40, 44, 48, 72, 96, 108)

LOG = T.StructType(
    [
        T.StructField("cf", T.StringType(), False),
        T.StructField("k", T.BinaryType(), False),
        T.StructField("lsn", T.LongType(), False),
        T.StructField("kind", T.ByteType(), False),
        T.StructField("range_end", T.BinaryType()),
        T.StructField("v", T.BinaryType()),
        T.StructField("len", T.IntegerType(), False),
        T.StructField("codec", T.ByteType()),
        T.StructField("crc", T.LongType()),
        T.StructField("relocated", T.BooleanType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("segment_id", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class ColumnFamily:
    """A keyspace: ``width`` None for keys of any length up to MAX_KEY; ``purge_at`` is the offset of an 8-byte mark."""

    name: str
    id: int
    width: int | None = None
    shard_bytes: int = 0
    purge_at: int | None = None
    codec: str = "none"

    def __post_init__(self):
        if not 0 <= self.id <= 255:
            raise ConfigError(f"column id {self.id} is not a byte")
        if self.width is not None and self.width not in FIXED_WIDTHS:
            raise ConfigError(f"width {self.width} of {self.name} is not admitted")
        if self.codec not in ("none", "lz4"):
            raise ConfigError(f"codec {self.codec} of {self.name} is unknown")
        if self.shard_bytes < 0 or self.width is not None and self.shard_bytes > self.width and self.width:
            raise ConfigError(f"{self.name} shards on {self.shard_bytes} bytes of {self.width}")

    def admits(self, key: bytes) -> bool:
        return len(key) == self.width if self.width is not None else len(key) <= MAX_KEY


class Registry:
    """The families that a store was opened with."""

    def __init__(self, families: Sequence[ColumnFamily]):
        self.families = tuple(families)
        self.by_name = {f.name: f for f in self.families}
        if len(self.by_name) != len(self.families) or len({f.id for f in self.families}) != len(self.families):
            raise ConfigError("a column name or id is declared twice")

    def __getitem__(self, name: str) -> ColumnFamily:
        if name not in self.by_name:
            raise ColumnFamilyNotFound(name)
        return self.by_name[name]

    def get(self, name: str) -> ColumnFamily | None:
        return self.by_name.get(name)


def parse_column(text: str) -> ColumnFamily:
    """NAME:ID or NAME:ID:WIDTH."""
    parts = text.split(":")
    if len(parts) not in (2, 3) or not parts[0]:
        raise ConfigError(f"column {text!r} is not NAME:ID[:WIDTH]")
    if not all(p.isdecimal() for p in parts[1:]):
        raise ConfigError(f"column {text!r} has an id or width that is no number")
    return ColumnFamily(parts[0], int(parts[1]), int(parts[2]) if len(parts) == 3 else None)


@dataclass(frozen=True)
class Volume:
    path: str
    kind: str = "capacity"
    dead: bool = False


def parse_volume(text: str) -> Volume:
    """PATH, PATH:fast or PATH:capacity, each perhaps with :dead."""
    path, *flags = text.split(":")
    dead = flags[-1:] == ["dead"]
    flags = flags[:-1] if dead else flags
    if not path or len(flags) > 1 or any(f not in ("fast", "capacity") for f in flags):
        raise ConfigError(f"volume {text!r} is not PATH[:fast|capacity][:dead]")
    return Volume(path, flags[0] if flags else "capacity", dead)
