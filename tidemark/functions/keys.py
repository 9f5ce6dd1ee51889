"""Keys, bounds and write batches: what a caller may pass in and how it becomes Catalyst predicates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lengths are stored in 16 bits and a whole batch in 32 by every log this format can be exported to.
MAX_FIELD, MAX_BATCH = 65_535, 2**32 - 1

VERSION_SCHEMA = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("ts", T.LongType(), False), T.StructField("value", T.BinaryType())])


def as_bytes(x: bytes | bytearray | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


@dataclass(frozen=True)
class Bound:
    """One end of a key range; ``key`` None means open."""

    key: bytes | str | None = None
    inclusive: bool = True

    @property
    def open(self) -> bool:
        return self.key is None


def included(key: bytes | str) -> Bound:
    return Bound(key, True)


def excluded(key: bytes | str) -> Bound:
    return Bound(key, False)


UNBOUNDED = Bound()


@dataclass(frozen=True)
class KeyRange:
    """Keys between two bounds, in unsigned byte order; empty if lower lies above upper."""

    lower: Bound = UNBOUNDED
    upper: Bound = UNBOUNDED

    def predicate(self, key: Column) -> Column:
        """A conjunction of comparisons that Parquet scans take as pushed filters; one key is an equality, which
        a file's Bloom filter can answer."""
        if not self.lower.open and self.lower == self.upper and self.lower.inclusive:
            return key == F.lit(self.lower.key)
        out = F.lit(True)
        if not self.lower.open:
            out = out & (key >= F.lit(self.lower.key) if self.lower.inclusive else key > F.lit(self.lower.key))
        if not self.upper.open:
            out = out & (key <= F.lit(self.upper.key) if self.upper.inclusive else key < F.lit(self.upper.key))
        return out

    def contains(self, key: bytes) -> bool:
        low, high = self.lower, self.upper
        above = low.open or key > as_bytes(low.key) or (low.inclusive and key == as_bytes(low.key))
        return above and (high.open or key < as_bytes(high.key) or (high.inclusive and key == as_bytes(high.key)))

    def overlaps(self, first: bytes, last: bytes) -> bool:
        """Whether a sorted file from first to last can hold a key of the range."""
        low, high = self.lower, self.upper
        if not low.open and (last < as_bytes(low.key) or (last == as_bytes(low.key) and not low.inclusive)):
            return False
        return high.open or first < as_bytes(high.key) or (high.inclusive and first == as_bytes(high.key))


ALL_KEYS = KeyRange()


def prefix_range(prefix: bytes) -> KeyRange:
    """The keys that start with prefix, as a range, so that files are pruned by it."""
    p = bytearray(prefix)
    while p and p[-1] == 0xFF:
        p.pop()
    if not p:
        return KeyRange(included(prefix), UNBOUNDED)
    p[-1] += 1
    return KeyRange(included(prefix), excluded(bytes(p)))


@dataclass(frozen=True)
class Put:
    key: bytes | str
    value: bytes | str


@dataclass(frozen=True)
class Delete:
    key: bytes | str


class BatchError(ValueError):
    """A write batch that breaks a size rule; nothing of it has been applied."""


def check_batch(records: Iterable[Put | Delete]) -> list[tuple[bytes, bytes | None]]:
    """Checks a whole batch before any of it counts; (key, value) in order, a delete as None."""
    out, size = [], 0
    for r in records:
        key = as_bytes(r.key)
        value = as_bytes(r.value) if isinstance(r, Put) else None
        if not key:
            raise BatchError("a key must not be empty")
        if value == b"":
            raise BatchError("a value must not be empty; delete the key instead")
        if len(key) > MAX_FIELD or len(value or b"") > MAX_FIELD:
            raise BatchError(f"keys and values hold at most {MAX_FIELD} bytes")
        size += len(key) + len(value or b"") + 12
        if size > MAX_BATCH:
            raise BatchError(f"a batch holds at most {MAX_BATCH} bytes")
        out.append((key, value))
    return out


def last_wins(records: Sequence[tuple[bytes, bytes | None]]) -> dict[bytes, bytes | None]:
    """Of several records for a key the last counts."""
    return dict(records)
