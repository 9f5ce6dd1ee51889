"""Tables as a Spark data source:

    register(spark)
    spark.read.format("tidemark").option("path", "file:///tables/users").option("lower", "a").load()

Options: path; lower and upper (text, both included); read_ts; versions=true for all stored versions.  Plans and
key filters are resolved on the driver from the commit log; each file is a partition, read with pyarrow and
pruned by the same bounds.  Versions of a key stand in several files, so without ``versions`` the rows carry
what is needed to choose and the caller groups them; :meth:`VersionedTable.scan` does that inside Spark and
keeps the vectorised Parquet reader, and is the main way to read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.keys import Bound, KeyRange, as_bytes
from .log import CorruptLog, parse


def register(spark) -> None:
    """Makes format("tidemark") known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TidemarkSource)


class FilePartition(InputPartition):
    def __init__(self, path: str, ts: int | None) -> None:
        self.path, self.ts = path, ts


class TidemarkSource(DataSource):
    """Stored versions (key, ts, value) of a table on a file system that pyarrow reaches."""

    @classmethod
    def name(cls) -> str:
        return "tidemark"

    def schema(self) -> str:
        return "key binary, ts bigint, value binary"

    def reader(self, schema) -> TidemarkReader:
        return TidemarkReader(self.options)


def _open(path: str):
    """(file system, path) of a table's file as the log names it, that is without escapes."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(quote(re.sub(r"^file:/(?!/)", "file:///", path), safe="/:@") if re.match(r"\w+:", path) else path)


def _state(path: str) -> tuple[list[dict], list[list]]:
    """Files and buffered batches of the newest version: the newest state file and the records after it.  As when
    a table is opened, a torn last record is left out and any other damage is an error."""
    from pyarrow import fs

    files, root = _open(path)
    names = [os.path.basename(i.path) for i in files.get_file_info(fs.FileSelector(f"{root}/_log"))]
    numbers = lambda kind: sorted(int(n[:20]) for n in names if re.fullmatch(rf"\d{{20}}\.{kind}", n))

    def record(version: int, kind: str) -> dict | None:
        with files.open_input_stream(f"{root}/_log/{version:020d}.{kind}") as f:
            return parse(f.read(), f"{version}.{kind}")

    live: dict[int, dict] = {}
    batches: list[list] = []
    after = -1
    for v in reversed(numbers("state")):
        if (saved := record(v, "state")) is not None:
            placed = [*saved["l0"], *(f for _, fs_ in saved["levels"] for f in fs_)]
            live, batches, after = {f["file_id"]: f for f in placed}, [b for group in saved["buffers"] for b in group], v
            break
    todo = [v for v in numbers("json") if v > after]
    for k, v in enumerate(todo):
        if k and v != todo[k - 1] + 1 or not k and after >= 0 and v != after + 1:
            raise CorruptLog(f"version {v - 1} is missing")
        r = record(v, "json")
        if r is None:
            if v != todo[-1]:
                raise CorruptLog(f"version {v} is torn")
            break
        if r["op"] == "batch":
            batches.append([r["ts"], r["rows"]])
        if r["op"] == "flush":
            batches = [b for b in batches if b[0] > r["upto"]]
        if r["op"] == "compact":
            for _, ids in r["task"]["inputs"]:
                for i in ids:
                    live.pop(i, None)
        live |= {f["file_id"]: f for f in r.get("files", ())}
    return list(live.values()), batches


class TidemarkReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.read_ts = int(options["read_ts"]) if "read_ts" in options else None
        bound = lambda name: Bound(options[name].encode()) if name in options else Bound()
        self.keys = KeyRange(bound("lower"), bound("upper"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds on key and upper bounds on ts; Spark applies the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("key",):
                b = Bound(as_bytes(f.value), not isinstance(f, (GreaterThan, LessThan)))
                low, high = self.keys.lower, self.keys.upper
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) and (low.open or as_bytes(low.key) < b.key):
                    low = b
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) and (high.open or b.key < as_bytes(high.key)):
                    high = b
                self.keys = KeyRange(low, high)
            yield f  # bounds only prune here; Spark still checks every row

    def partitions(self) -> list[InputPartition]:
        import base64

        files, self.batches = _state(self.path)
        out: list[InputPartition] = []
        for f in files:
            first, last = base64.b64decode(f["first_key"]), base64.b64decode(f["last_key"])
            if self.keys.overlaps(first, last) and (self.read_ts is None or f["min_ts"] <= self.read_ts):
                out.append(FilePartition(f["path"], f["max_ts"] if f["unique"] and f["min_ts"] == f["max_ts"] else None))
        rows = [(base64.b64decode(k), ts, None if v is None else base64.b64decode(v)) for ts, batch in self.batches for k, v in batch]
        if rows:
            out.append(InputPartition(rows))
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("key", pa.binary()), ("ts", pa.int64()), ("value", pa.binary())])
        if isinstance(partition, FilePartition):
            import pyarrow.parquet as pq

            files, path = _open(partition.path)
            batches = pq.ParquetFile(files.open_input_file(path)).iter_batches(columns=["key", "ts", "value"])
        else:
            batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*partition.value, strict=True), kind.types, strict=True)], schema=kind)]
        for b in batches:
            if isinstance(partition, FilePartition) and partition.ts is not None:
                b = b.set_column(1, "ts", pa.array([partition.ts] * b.num_rows, pa.int64()))
            keep = pa.array([True] * b.num_rows)
            low, high = self.keys.lower, self.keys.upper
            if not low.open:
                keep = pc.and_(keep, (pc.greater_equal if low.inclusive else pc.greater)(b["key"], pa.scalar(as_bytes(low.key), pa.binary())))
            if not high.open:
                keep = pc.and_(keep, (pc.less_equal if high.inclusive else pc.less)(b["key"], pa.scalar(as_bytes(high.key), pa.binary())))
            if self.read_ts is not None:
                keep = pc.and_(keep, pc.less_equal(b["ts"], self.read_ts))
            yield b.filter(keep).cast(kind)
