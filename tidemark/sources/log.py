"""The commit log: one JSON file a version, created if absent, on any file system Hadoop reaches."""

from __future__ import annotations

import json
import logging
import time
import uuid
import zlib

from pyspark.sql import SparkSession

LOG = logging.getLogger(__name__)


class VersionTaken(RuntimeError):
    """Another writer has committed this version."""


class CorruptLog(RuntimeError):
    """A log file whose checksum or order is wrong."""


def parse(raw: bytes, name: str) -> dict | None:
    """The record in the bytes of a log file, or None if the file is torn."""
    head, sep, body = raw.partition(b"\n")
    try:
        length, crc = map(int, head.split(b" "))
    except ValueError:
        if sep:
            raise CorruptLog(f"{name}: header") from None
        return None
    if len(body) < length:
        return None
    if len(body) > length or zlib.crc32(body) != crc:
        raise CorruptLog(f"{name}: checksum")
    return json.loads(body)


class CommitLog:
    """Files ``_log/00000000000000000007.json`` of a header line (length, CRC-32) and a JSON record.

    A record is written under a private name and renamed, never over another: the rename is the commit.
    A file shorter than its header says is the trace of a torn copy: as the last one it is dropped with a
    warning; anywhere else, or with a wrong checksum, it is an error.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.dir = self._path(f"{self.root}/_log")
        self.fs = self.dir.getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.dir.toUri() if self.dir.toUri().getScheme() else self.fs.getUri(), self.conf)
        self.fs.mkdirs(self.dir)

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def _file(self, version: int, kind: str = "json"):
        return self._path(f"{self.root}/_log/{version:020d}.{kind}")

    def versions(self, kind: str = "json") -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.dir)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith("." + kind) and n[:20].isdigit())

    def _bytes(self, path) -> bytes:
        stream = self.fs.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _put(self, path, record: dict) -> None:
        body = json.dumps(record, separators=(",", ":")).encode()
        private = self._path(f"{self.root}/_log/.{uuid.uuid4().hex}")
        out = self.fs.create(private, False)
        out.write(bytearray(f"{len(body)} {zlib.crc32(body)}\n".encode() + body))
        out.close()
        none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        kinds = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        kinds[0] = none
        try:
            self.context.rename(private, path, kinds)
        except Exception as e:
            self.fs.delete(private, False)
            if "FileAlreadyExists" in str(e):
                raise VersionTaken(path.getName()) from None
            raise

    def commit(self, version: int, record: dict) -> None:
        self._put(self._file(version), record)

    def parse(self, raw: bytes, name: str) -> dict | None:
        return parse(raw, name)

    def read(self, after: int) -> list[tuple[int, dict]]:
        """Records of the versions after ``after``, without gaps."""
        todo = [v for v in self.versions() if v > after]
        out: list[tuple[int, dict]] = []
        for v in todo:
            if v != after + 1 + len(out):
                raise CorruptLog(f"version {after + 1 + len(out)} is missing")
            record = self.parse(self._bytes(self._file(v)), str(v))
            if record is None:
                if v != todo[-1]:
                    raise CorruptLog(f"version {v} is torn")
                LOG.warning("dropping torn log file of version %d", v)
                self.fs.delete(self._file(v), False)
                break
            out.append((v, record))
        return out

    # -- state files, so that opening does not replay everything

    def save_state(self, version: int, state: dict) -> None:
        try:
            self._put(self._file(version, "state"), state)
        except VersionTaken:
            pass

    def last_state(self) -> tuple[int, dict] | None:
        for v in reversed(self.versions("state")):
            state = self.parse(self._bytes(self._file(v, "state")), f"{v}.state")
            if state is not None:
                return v, state
        return None

    def retire(self, older_than_seconds: float) -> int:
        """Deletes records and state files that the last two state files make needless, once no process that is
        behind can still want them; returns how many."""
        states = self.versions("state")
        if len(states) < 2:
            return 0
        limit, done = time.time() - older_than_seconds, 0
        for kind, upto in (("json", states[-2]), ("state", states[-2] - 1)):
            for v in self.versions(kind):
                if v <= upto and self.fs.getFileStatus(self._file(v, kind)).getModificationTime() / 1000 <= limit:
                    done += bool(self.fs.delete(self._file(v, kind), False))
        return done

    # -- data files

    def size(self, path: str) -> int:
        return self.fs.getFileStatus(self._path(path)).getLen()

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def data_files(self) -> list[tuple[str, float]]:
        """(path, seconds since the epoch) of the Parquet files under data/."""
        top = self._path(f"{self.root}/data")
        out = []
        if self.fs.exists(top):
            it = self.fs.listFiles(top, True)
            while it.hasNext():
                s = it.next()
                if s.getPath().getName().endswith(".parquet"):
                    out.append((s.getPath().toString(), s.getModificationTime() / 1000))
        return out
