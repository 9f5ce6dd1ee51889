"""Versioned key-value tables: sorted Parquet files of (key, ts, value) under a JSON commit log.

    t = VersionedTable.open(spark, "hdfs:///tables/users", Options(policy=Leveled()))
    t.write_batch([Put("a", "1"), Delete("b")])     # atomic, one commit timestamp
    t.write_frame(df)                               # the same for a DataFrame of any size
    t.get("a"); t.scan(KeyRange(included("a"), excluded("m")))
    with t.begin() as txn: ...

Reads are Catalyst plans over the files that the manifest leaves after pruning by key span and timestamp.
Small writes wait in a buffer on the driver, made durable by their log record; large ones are written by
the executors and named by the log record.  Data files are always complete before a record names them.
"""

from __future__ import annotations

import base64
import threading
import time
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import ALL_KEYS, MAX_FIELD, VERSION_SCHEMA, BatchError, Delete, KeyRange, Put, as_bytes, check_batch, last_wins, prefix_range
from ..operators import resolve
from ..plans.layout import Layout, NoCompaction, SortedFile, StaleTask, Task
from .log import CommitLog, VersionTaken

ENTRY_OVERHEAD = 8
STATE_EVERY = 32


class ConflictError(RuntimeError):
    """A transaction read what another one has changed since."""


class ClosedError(RuntimeError):
    """Use of a finished transaction or a closed table."""


BAD_FIELD = "a key or value is empty or too long"

#: Files whose timestamps are broadcast at most; beyond it a shuffle joins them.
MANY_FILES = 100_000


@dataclass(frozen=True)
class Options:
    """policy: NoCompaction, SimpleLeveled, Tiered or Leveled.

    file_bytes is the size at which output files are cut; buffer_bytes, or file_bytes if that is smaller, the size
    at which the buffer freezes; frozen_limit the number of
    buffers, the open one included, at which maintenance flushes.  durable_writes logs every batch before it
    shows.  serializable validates transactions at commit; isolation "range" also finds phantoms.
    """

    policy: object = field(default_factory=NoCompaction)
    file_bytes: int = 256 << 20
    buffer_bytes: int = 2 << 20
    frozen_limit: int = 2
    durable_writes: bool = True
    serializable: bool = False
    isolation: str = "keys"


class Watermark:
    """Timestamps that open snapshots read at, with how many do."""

    def __init__(self) -> None:
        self.readers: Counter[int] = Counter()

    def add(self, ts: int) -> None:
        self.readers[ts] += 1

    def remove(self, ts: int) -> None:
        self.readers[ts] -= 1
        if self.readers[ts] <= 0:
            del self.readers[ts]

    def lowest(self) -> int | None:
        return min(self.readers, default=None)

    def __len__(self) -> int:
        return len(self.readers)


@dataclass(frozen=True)
class Commit:
    """A batch in the buffer or a bulk load, as transactions check it."""

    ts: int
    rows: dict[bytes, bytes | None] = field(default_factory=dict)
    files: tuple[SortedFile, ...] = ()

    def size(self) -> int:
        return sum(len(k) + ENTRY_OVERHEAD + len(v or b"") for k, v in self.rows.items())


@dataclass(frozen=True)
class State:
    """One immutable version of the table; readers keep the one they started with."""

    version: int = -1
    layout: Layout = Layout()
    latest_ts: int = 0
    next_id: int = 1
    #: Buffers, oldest first; the last one is open.
    buffers: tuple[tuple[Commit, ...], ...] = ((),)
    apps: tuple[tuple[str, int], ...] = ()

    def pending(self) -> list[Commit]:
        return [c for b in self.buffers for c in b]


def _b64(x: bytes | None) -> str | None:
    return None if x is None else base64.b64encode(x).decode()


def _unb64(x: str | None) -> bytes | None:
    return None if x is None else base64.b64decode(x)


def file_json(f: SortedFile) -> dict:
    return asdict(f) | {"first_key": _b64(f.first_key), "last_key": _b64(f.last_key)}


def json_file(d: dict) -> SortedFile:
    return SortedFile(**(d | {"first_key": _unb64(d["first_key"]), "last_key": _unb64(d["last_key"])}))


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, options: Options) -> None:
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.log = CommitLog(spark, self.path)
        self.lock = threading.RLock()
        self.readers, self.pins = Watermark(), Counter()
        self.filters: list[bytes] = []
        self.recent: list[Commit] = []
        self.open, self.failure = True, None
        self._thread: threading.Thread | None = None
        saved = self.log.last_state()
        self.state = self._load_state(*saved) if saved else State(layout=options.policy.start())
        self._catch_up()

    @classmethod
    def at(cls, spark: SparkSession, path: str, options: Options | None = None) -> VersionedTable:
        return cls(spark, path, options or Options())

    # -- the log

    def _catch_up(self) -> None:
        for v, record in self.log.read(self.state.version):
            self.state = self._replay(replace(self.state, version=v), record)

    def _replay(self, s: State, r: dict) -> State:
        """The state after a record."""
        policy, op = self.options.policy, r["op"]
        if r.get("app"):
            s = replace(s, apps=tuple((dict(s.apps) | {r["app"]: r["batch"]}).items()))
        files = tuple(json_file(f) for f in r.get("files", ()))
        s = replace(s, next_id=max([s.next_id, *(f.file_id + 1 for f in files)]), latest_ts=max([s.latest_ts, r.get("ts", 0), *(f.max_ts for f in files)]))
        if op == "batch":
            rows = {_unb64(k): _unb64(v) for k, v in r["rows"]}
            return self._buffered(s, Commit(r["ts"], rows))
        if op == "flush":
            keep = tuple(b for b in (tuple(c for c in b if c.ts > r["upto"]) for b in s.buffers[:-1]) if b)
            s = replace(s, buffers=(*keep, tuple(c for c in s.buffers[-1] if c.ts > r["upto"])))
        if op in ("flush", "load"):
            for f in files:
                s = replace(s, layout=policy.flush(s.layout, f))
            if op == "load":
                self.recent.append(Commit(r["ts"], files=files))
            return s
        if op == "compact":
            return replace(s, layout=self._applied(s.layout, Task.from_json(r["task"]), files))
        raise ValueError(f"unknown record {op}")

    def _applied(self, layout: Layout, task: Task, files: tuple[SortedFile, ...]) -> Layout:
        policy = NoCompaction() if task.policy == "full" else self.options.policy
        return policy.apply(layout, task, files)[0]

    def _buffered(self, s: State, c: Commit) -> State:
        self.recent.append(c)
        s = replace(s, latest_ts=max(s.latest_ts, c.ts), buffers=(*s.buffers[:-1], (*s.buffers[-1], c)))
        if sum(x.size() for x in s.buffers[-1]) >= min(self.options.buffer_bytes, self.options.file_bytes):
            s = replace(s, buffers=(*s.buffers, ()))
        return s

    def _commit(self, make) -> State:
        """Appends the record that make(state) gives; if another writer was faster, reads what it wrote and
        makes the record anew."""
        with self.lock:
            self._check_open()
            while True:
                record = make(self.state)
                version = self.state.version + 1
                try:
                    self.log.commit(version, record)
                except VersionTaken:
                    self._catch_up()
                    continue
                self.state = self._replay(replace(self.state, version=version), record)
                if version and version % STATE_EVERY == 0:
                    self.log.save_state(version, self._state_json())
                low = self.watermark()
                self.recent = [c for c in self.recent if c.ts > low]
                return self.state

    def _state_json(self) -> dict:
        s = self.state
        return {
            "l0": [file_json(f) for f in s.layout.l0],
            "levels": [[n, [file_json(f) for f in fs]] for n, fs in s.layout.levels],
            "latest_ts": s.latest_ts,
            "next_id": s.next_id,
            "buffers": [[[c.ts, [[_b64(k), _b64(v)] for k, v in c.rows.items()]] for c in b] for b in s.buffers],
            "apps": list(s.apps),
        }

    def _load_state(self, version: int, d: dict) -> State:
        layout = Layout(tuple(map(json_file, d["l0"])), tuple((n, tuple(map(json_file, fs))) for n, fs in d["levels"]))
        buffers = tuple(tuple(Commit(ts, {_unb64(k): _unb64(v) for k, v in rows}) for ts, rows in b) for b in d["buffers"])
        return State(version, layout, d["latest_ts"], d["next_id"], buffers, tuple(tuple(a) for a in d["apps"]))

    def _check_open(self) -> None:
        if not self.open:
            raise ClosedError("the table is closed")
        if self.failure:
            error, self.failure = self.failure, None
            raise RuntimeError("background maintenance has stopped") from error

    # -- writing

    def write_batch(self, records: Iterable[Put | Delete]) -> int:
        """Applies all records under one new commit timestamp and returns it; nothing at all if one is
        not allowed, no new timestamp if there are none."""
        return self._write(check_batch(records))

    def _write(self, records: list[tuple[bytes, bytes | None]]) -> int:
        if not records:
            return self.state.latest_ts
        rows = last_wins(records)
        if not self.options.durable_writes:
            with self.lock:
                self._check_open()
                self.state = self._buffered(self.state, Commit(self.state.latest_ts + 1, rows))
                return self.state.latest_ts
        coded = [[_b64(k), _b64(v)] for k, v in rows.items()]
        return self._commit(lambda s: {"op": "batch", "ts": s.latest_ts + 1, "rows": coded}).latest_ts

    def put(self, key, value) -> int:
        if self.options.serializable:  # through a transaction, where an empty value deletes
            with self.begin() as t:
                t.put(key, value)
            return self.state.latest_ts
        return self.write_batch([Put(key, value)])

    def delete(self, key) -> int:
        return self.write_batch([Delete(key)])

    def write_frame(self, rows: DataFrame, app: str | None = None, batch: int | None = None, ordinal: str | None = None) -> int | None:
        """A batch of any size: columns key and value (null deletes), of equal keys the one of largest
        ordinal counts, or without an ordinal the largest value, a deletion only if alone.  With app and batch,
        a batch already committed is not applied again (None).  The input is evaluated once."""
        if app is not None and dict(self.state.apps).get(app, -1) >= batch:
            return None
        key, value = F.col("key").cast("binary"), F.col("value").cast("binary")
        bad = key.isNull() | (F.length(key) == 0) | (F.length(value) == 0) | (F.length(key) > MAX_FIELD) | (F.length(value) > MAX_FIELD)
        rows = rows.select(F.when(bad, F.raise_error(F.lit(BAD_FIELD))).otherwise(key).alias("key"), value.alias("value"), *([ordinal] if ordinal else []))
        rows = resolve.dedupe_batch(rows, ordinal).drop(ordinal) if ordinal else resolve.newest(rows, F.struct(F.col("value").isNotNull(), F.col("value")))
        # The timestamp is known only at commit: files are written with 0 and get it from the manifest.
        try:
            files = self._write_files(rows.withColumn("ts", F.lit(0).cast("long")), None, unique=True)
        except PySparkException as e:
            if BAD_FIELD in str(e):
                raise BatchError(BAD_FIELD) from e
            raise

        def record(s: State) -> dict:
            if app is not None and dict(s.apps).get(app, -1) >= batch:
                raise StaleTask("this batch is committed")
            ts = s.latest_ts + 1
            named = [replace(f, file_id=s.next_id + i, min_ts=ts, max_ts=ts) for i, f in enumerate(files)]
            return {"op": "load", "ts": ts, "files": [file_json(f) for f in named], "stamp": True} | ({"app": app, "batch": batch} if app is not None else {})

        try:
            return self._commit(record).latest_ts
        except StaleTask:
            return None

    def load_versions(self, log: DataFrame) -> None:
        """Adds rows (key, ts, value) with timestamps of their own, as one sorted run of files."""
        log = log.select(F.col("key").cast("binary").alias("key"), F.col("ts").cast("long").alias("ts"), F.col("value").cast("binary").alias("value"))
        files = self._write_files(log, None, unique=False)
        self._commit(lambda s: {"op": "load", "ts": max([s.latest_ts, *(f.max_ts for f in files)]), "files": [file_json(replace(f, file_id=s.next_id + i)) for i, f in enumerate(files)]})

    def _write_files(self, log: DataFrame, n_files: int | None, unique: bool) -> list[SortedFile]:
        """Sorted Parquet files of the rows, each key in one of them, in key order; ids are the caller's."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows = log.select("key", "ts", "value")
        # Without a number Spark sizes the ranges by the shuffled bytes.
        rows = rows.repartitionByRange(n_files, "key") if n_files else rows.repartitionByRange("key")
        writer = rows.sortWithinPartitions("key", F.desc("ts")).write.option("compression", "zstd")
        writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(folder)
        stats = self.spark.read.schema(VERSION_SCHEMA).parquet(folder).groupBy(F.input_file_name().alias("path"))
        stats = stats.agg(F.min("key").alias("first"), F.max("key").alias("last"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n"))
        # The column has escapes where a folder's name has blanks or the like; the file's own name has none.
        found = [(f"{folder}/{r['path'].rpartition('/')[2]}", r) for r in stats.collect()]
        out = [SortedFile(0, path, bytes(r["first"]), bytes(r["last"]), r["lo"], r["hi"], r["n"], self.log.size(path), unique) for path, r in found]
        return sorted(out, key=lambda f: f.first_key)

    # -- reading

    def _files_frame(self, files: Iterable[SortedFile]) -> DataFrame | None:
        """Rows of the files; those of a bulk load get the timestamp of their commit."""
        files = list(files)
        stored = [f for f in files if f.min_ts != f.max_ts or not f.unique]
        stamped: dict[int, list[SortedFile]] = {}
        for f in files:
            if f not in stored:
                stamped.setdefault(f.max_ts, []).append(f)
        parts = [self.spark.read.schema(VERSION_SCHEMA).parquet(*(f.path for f in stored))] if stored else []
        if len(stamped) == 1:
            (ts, fs), = stamped.items()
            parts.append(self.spark.read.schema(VERSION_SCHEMA).parquet(*(f.path for f in fs)).withColumn("ts", F.lit(ts).cast("long")))
        elif stamped:
            # One scan whatever the number of loads; a file's timestamp comes by its name, which no two files share.
            name = lambda f: f.path.rpartition("/")[2]
            when = self.spark.createDataFrame([(name(f), ts) for ts, fs in stamped.items() for f in fs], "_name string, ts long")
            part = self.spark.read.schema(VERSION_SCHEMA).parquet(*(f.path for fs in stamped.values() for f in fs))
            part = part.select("key", "value", F.col("_metadata.file_name").alias("_file"))
            few = sum(map(len, stamped.values())) <= MANY_FILES
            parts.append(part.join(F.broadcast(when) if few else when, F.col("_file") == F.col("_name")).select("key", "ts", "value"))
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def _rows_frame(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame([(bytearray(k), ts, None if v is None else bytearray(v)) for k, ts, v in rows], VERSION_SCHEMA)

    def versions(self, state: State | None = None, keys: KeyRange = ALL_KEYS, read_ts: int | None = None) -> DataFrame:
        """All stored versions, deletions included, from files the range and timestamp leave."""
        s = state or self.state
        files = [f for f in s.layout.files() if keys.overlaps(f.first_key, f.last_key) and (read_ts is None or f.min_ts <= read_ts)]
        rows = [(k, c.ts, v) for c in s.pending() if read_ts is None or c.ts <= read_ts for k, v in c.rows.items() if keys.contains(k)]
        log = self._files_frame(files)
        if rows or log is None:
            buffered = self._rows_frame(rows)
            log = buffered if log is None else log.unionByName(buffered)
        return resolve.visible(log, read_ts, keys)

    def _sorted_once(self, s: State, keys: KeyRange) -> bool:
        """Whether the range lies in one run that has a key once: then nothing needs resolving."""
        runs = [[f for f in fs if keys.overlaps(f.first_key, f.last_key)] for fs in [*((f,) for f in s.layout.l0), *(fs for _, fs in s.layout.levels)]]
        runs = [r for r in runs if r]
        return not s.pending() and len(runs) == 1 and all(f.unique for f in runs[0])

    def scan(self, keys: KeyRange = ALL_KEYS, state: State | None = None, read_ts: int | None = None) -> DataFrame:
        """Rows (key, value) of a snapshot in key order."""
        self._check_open()
        s = state or self.state
        log = self.versions(s, keys, s.latest_ts if read_ts is None else read_ts)
        rows = resolve.live(log) if self._sorted_once(s, keys) else resolve.live(resolve.newest(log))
        return rows.select("key", "value").orderBy("key")

    def prefix(self, prefix) -> DataFrame:
        return self.scan(prefix_range(as_bytes(prefix)))

    def seek(self, key) -> DataFrame:
        """The first row at or after key."""
        from ..functions.keys import included

        return self.scan(KeyRange(included(as_bytes(key)))).limit(1)

    def get(self, key, state: State | None = None, read_ts: int | None = None) -> bytes | None:
        """Value of one key, or None.  The buffer is newer than any file and answers without a job."""
        self._check_open()
        s, key = state or self.state, as_bytes(key)
        ts = s.latest_ts if read_ts is None else read_ts
        for c in reversed(s.pending()):
            if c.ts <= ts and key in c.rows:
                return c.rows[key]
        log = self._files_frame(f for f in s.layout.files() if f.first_key <= key <= f.last_key and f.min_ts <= ts)
        row = resolve.point(log, bytearray(key), ts).first() if log is not None else None
        return bytes(row["value"]) if row else None

    def diff(self, old_ts: int, new_ts: int) -> DataFrame:
        return resolve.diff(self.versions(), old_ts, new_ts)

    def describe(self) -> DataFrame:
        """One row per file and buffer: where it stands and what it holds."""
        s = self.state
        rows = [("buffer", i, None, None, None, None, None, sum(len(c.rows) for c in b), sum(c.size() for c in b)) for i, b in enumerate(s.buffers)]
        for place, number, files in [("l0", 0, s.layout.l0), *(("level", n, fs) for n, fs in s.layout.levels)]:
            rows += [(place, number, f.file_id, bytearray(f.first_key), bytearray(f.last_key), f.min_ts, f.max_ts, f.rows, f.size) for f in files]
        return self.spark.createDataFrame(rows, "place string, number long, file_id long, first_key binary, last_key binary, min_ts long, max_ts long, n_rows long, n_bytes long")

    # -- transactions

    def begin(self):
        from .transaction import Transaction

        with self.lock:
            self._check_open()
            return Transaction(self)

    def watermark(self) -> int:
        """Versions that no reader can tell apart lie at or below this."""
        low = self.readers.lowest()
        return self.state.latest_ts if low is None else low

    # -- flush and compaction

    def sync(self) -> None:
        """With durable writes every batch is in the log already; else this flushes."""
        if not self.options.durable_writes:
            self.flush_all()

    def freeze(self) -> None:
        with self.lock:
            if self.state.buffers[-1]:
                self.state = replace(self.state, buffers=(*self.state.buffers, ()))

    def flush(self) -> bool:
        """Freezes the open buffer and writes the oldest one as a sorted file."""
        self.freeze()
        with self.lock:
            oldest = self.state.buffers[0] if len(self.state.buffers) > 1 else ()
        if not oldest:
            return False
        rows = [(k, c.ts, v) for c in oldest for k, v in c.rows.items()]
        files = self._write_files(self._rows_frame(rows), 1, unique=len(oldest) == 1)
        upto = oldest[-1].ts
        self._commit(lambda s: {"op": "flush", "upto": upto, "files": [file_json(replace(f, file_id=s.next_id + i)) for i, f in enumerate(files)]})
        return True

    def flush_all(self) -> None:
        while self.flush():
            pass

    def add_filter(self, prefix) -> None:
        """Keys with this prefix may be dropped by later compactions, for as long as the table is open."""
        self.filters.append(as_bytes(prefix))

    def _rewrite(self, task: Task) -> bool:
        s, wanted = self.state, task.ids()
        files = [f for f in s.layout.files() if f.file_id in wanted]
        mark = self.watermark()
        log = self._files_frame(files)
        out: list[SortedFile] = []
        if log is not None:
            kept = resolve.collect(log, mark, task.bottom, [bytearray(p) for p in self.filters])
            n = max(1, -(-sum(f.size for f in files) // self.options.file_bytes))
            out = self._write_files(kept, n, unique=max(f.max_ts for f in files) <= mark)

        def record(now: State) -> dict:
            named = tuple(replace(f, file_id=now.next_id + i) for i, f in enumerate(out))
            self._applied(now.layout, task, named)  # raises if the layout has moved on
            return {"op": "compact", "task": task.to_json(), "files": [file_json(f) for f in named]}

        try:
            self._commit(record)
        except StaleTask:
            return False
        return True

    def compact(self) -> bool:
        """One compaction, if the policy asks for one."""
        task = self.options.policy.plan(self.state.layout)
        return task is not None and self._rewrite(task)

    def full_compaction(self) -> None:
        """Rewrites all files into one run; for tables without a policy."""
        if not isinstance(self.options.policy, NoCompaction):
            raise ValueError("a full compaction is for tables without a compaction policy")
        self._rewrite(self.options.policy.full(self.state.layout))

    def maintain(self) -> None:
        """What the background thread does once: flush beyond the limit, then compact until at rest."""
        while len(self.state.buffers) > self.options.frozen_limit and self.flush():
            pass
        while self.compact():
            pass

    def start_background(self, seconds: float = 0.05) -> None:
        def loop() -> None:
            while self.open:
                try:
                    self.maintain()
                except Exception as e:  # the next call on the table raises it
                    self.failure = e if self.open else None
                    return
                time.sleep(seconds)

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()

    def vacuum(self, older_than_seconds: float = 7 * 86_400) -> list[str]:
        """Deletes data files that neither this version nor an open snapshot names and that are old
        enough for no other process to read them, and log files that state files have replaced."""
        named = {f.path for f in self.state.layout.files()} | {p for p, n in self.pins.items() if n > 0}
        strip = lambda p: tuple(p.rsplit("/", 2)[1:])  # noqa: E731  folders have names of their own, however the table is written
        keep, gone = {strip(p) for p in named}, []
        for path, changed in self.log.data_files():
            if strip(path) not in keep and time.time() - changed >= older_than_seconds:
                self.log.delete(path)
                gone.append(path)
        self.log.retire(older_than_seconds)
        return gone

    def close(self) -> None:
        if self.open:
            if not self.options.durable_writes:
                self.flush_all()
            self.open = False
            if self._thread:
                self._thread.join(10)

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()
