"""Snapshot transactions with optimistic validation at commit."""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import ALL_KEYS, KeyRange, as_bytes, included
from ..operators import resolve
from .table import ClosedError, Commit, ConflictError, State, VersionedTable


def _release(table: VersionedTable, ts: int, paths: list[str]) -> None:
    with table.lock:
        table.readers.remove(ts)
        table.pins.subtract(paths)


class Transaction:
    """Reads the state at its start under its own writes.

    Reads are remembered as keys and ranges, never as collected rows: a later commit conflicts if it
    wrote a key that was read, or one in a scanned range that the scan had returned (isolation "keys") or
    any in the range (isolation "range").  Writes alone never conflict.
    """

    def __init__(self, table: VersionedTable) -> None:
        self.table, self.state = table, table.state
        self.read_ts = self.state.latest_ts
        self.writes: dict[bytes, bytes | None] = {}
        self.keys_read: set[bytes] = set()
        self.ranges_read: list[KeyRange] = []
        self.done = False
        paths = [f.path for f in self.state.layout.files()]
        table.readers.add(self.read_ts)
        table.pins.update(paths)
        self._end = weakref.finalize(self, _release, table, self.read_ts, paths)

    def _check(self) -> None:
        if self.done:
            raise ClosedError("the transaction is over")

    def get(self, key) -> bytes | None:
        self._check()
        key = as_bytes(key)
        self.keys_read.add(key)
        if key in self.writes:
            return self.writes[key]
        return self.table.get(key, self.state, self.read_ts)

    def scan(self, keys: KeyRange = ALL_KEYS) -> DataFrame:
        """Rows (key, value) in key order.  The result keeps the transaction, and so its files, alive."""
        self._check()
        self.ranges_read.append(keys)
        own = [(k, 0, v) for k, v in self.writes.items() if keys.contains(k)]
        self.keys_read |= {k for k, _, v in own if v is not None}
        if own:
            base = resolve.newest(self.table.versions(self.state, keys, self.read_ts))
            out = resolve.overlay(base, self.table._rows_frame(own)).select("key", "value").orderBy("key")
        else:
            out = self.table.scan(keys, self.state, self.read_ts)
        out._transaction = self
        return out

    def put(self, key, value) -> None:
        """An empty value deletes."""
        self._check()
        self.writes[as_bytes(key)] = as_bytes(value) or None

    def delete(self, key) -> None:
        self._check()
        self.writes[as_bytes(key)] = None

    def commit(self) -> int:
        """Validates and applies the writes; afterwards, also if it fails, the transaction is over."""
        self._check()
        self.done = True
        try:
            if not self.writes:
                return self.read_ts
            from ..functions.keys import Delete, Put, check_batch

            rows = check_batch(Delete(k) if v is None else Put(k, v) for k, v in self.writes.items())
            with self.table.lock:
                if self.table.options.serializable:
                    self._commit_checked(rows)
                    return self.table.state.latest_ts
                return self.table._write(rows)
        finally:
            self._end()

    def _commit_checked(self, rows: list[tuple[bytes, bytes | None]]) -> None:
        t = self.table
        if not t.options.durable_writes:
            self._validate(t.state)
            t._write(rows)
            return
        from .table import _b64

        coded = [[_b64(k), _b64(v)] for k, v in rows]

        def record(s: State) -> dict:
            self._validate(s)  # anew each time another process was faster
            return {"op": "batch", "ts": s.latest_ts + 1, "rows": coded}

        t._commit(record)

    def _validate(self, now: State) -> None:
        for c in self.table.recent:
            if c.ts > self.read_ts and self._meets(c):
                raise ConflictError(f"commit {c.ts} changed what was read at {self.read_ts}")

    def _meets(self, c: Commit) -> bool:
        if c.files:
            return self._meets_files(c)
        if self.keys_read & c.rows.keys():
            return True
        hits = [k for k in c.rows if any(r.contains(k) for r in self.ranges_read)]
        if self.table.options.isolation == "range":
            return bool(hits)
        if len(hits) < 2:
            return any(self.table.get(k, self.state, self.read_ts) is not None for k in hits)
        # One semi-join, whatever the number of written keys.
        span = KeyRange(included(min(hits)), included(max(hits)))
        seen = resolve.live(resolve.newest(self.table.versions(self.state, span, self.read_ts)))
        written = self.table._rows_frame([(k, 0, None) for k in hits]).select("key")
        return not seen.join(written, "key", "left_semi").isEmpty()

    def _meets_files(self, c: Commit) -> bool:
        """The same for a bulk load, by a semi-join on its files."""
        spans = [f for f in c.files if any(f.first_key <= k <= f.last_key for k in self.keys_read) or any(r.overlaps(f.first_key, f.last_key) for r in self.ranges_read)]
        if not spans:
            return False
        written = self.table._files_frame(spans).select("key")
        if self.keys_read:
            wanted = self.table._rows_frame([(k, 0, None) for k in self.keys_read]).select("key")
            if not written.join(wanted, "key", "left_semi").isEmpty():
                return True
        for r in self.ranges_read:
            inside = written.where(r.predicate(F.col("key")))
            if self.table.options.isolation != "range":
                inside = inside.join(self.table.scan(r, self.state, self.read_ts).select("key"), "key", "left_semi")
            if not inside.isEmpty():
                return True
        return False

    def rollback(self) -> None:
        self.done = True
        self._end()

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.done:
            return
        if kind:
            self.rollback()
        else:
            self.commit()
