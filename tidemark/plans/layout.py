"""The immutable picture of a table's files that planners read and produce."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class SortedFile:
    """Metadata of one sorted file; keys are None in metadata-only simulations."""

    file_id: int
    path: str = ""
    first_key: bytes | None = None
    last_key: bytes | None = None
    min_ts: int = 0
    max_ts: int = 0
    rows: int = 0
    size: int = 1
    unique: bool = False  # one version a key


@dataclass(frozen=True)
class Layout:
    """l0: newest first.  levels: (number, files), for tiers the newest tier first."""

    l0: tuple[SortedFile, ...] = ()
    levels: tuple[tuple[int, tuple[SortedFile, ...]], ...] = ()

    def files(self) -> tuple[SortedFile, ...]:
        return self.l0 + tuple(f for _, fs in self.levels for f in fs)

    def level(self, number: int) -> tuple[SortedFile, ...]:
        return next((fs for n, fs in self.levels if n == number), ())

    def with_level(self, number: int, files: Iterable[SortedFile]) -> Layout:
        return replace(self, levels=tuple((n, tuple(files) if n == number else fs) for n, fs in self.levels))


@dataclass(frozen=True)
class Task:
    """A compaction: which files to rewrite, and where the result belongs.

    inputs is (level or tier number, file ids), 0 for l0, newest source first.  ``bottom`` says
    that nothing older lies below the result.
    """

    policy: str
    inputs: tuple[tuple[int, tuple[int, ...]], ...]
    target: int
    bottom: bool

    def ids(self) -> set[int]:
        return {i for _, ids in self.inputs for i in ids}

    def to_json(self) -> dict:
        return {"policy": self.policy, "inputs": [[n, list(ids)] for n, ids in self.inputs], "target": self.target, "bottom": self.bottom}

    @staticmethod
    def from_json(d: dict) -> Task:
        return Task(d["policy"], tuple((n, tuple(ids)) for n, ids in d["inputs"]), d["target"], d["bottom"])


class StaleTask(RuntimeError):
    """The layout no longer holds what a task was planned on."""


def ids(files: Iterable[SortedFile]) -> tuple[int, ...]:
    return tuple(f.file_id for f in files)


@dataclass(frozen=True)
class NoCompaction:
    """Files stay in l0 until a full compaction moves all into level 1."""

    name: str = field(default="none", init=False)

    def start(self) -> Layout:
        return Layout(levels=((1, ()),))

    def flush(self, layout: Layout, file: SortedFile) -> Layout:
        return replace(layout, l0=(file, *layout.l0))

    def plan(self, layout: Layout) -> Task | None:
        return None

    def full(self, layout: Layout) -> Task:
        return Task("full", ((0, ids(layout.l0)), (1, ids(layout.level(1)))), 1, True)

    def apply(self, layout: Layout, task: Task, output: tuple[SortedFile, ...]) -> tuple[Layout, list[int]]:
        """The layout after the task, and the ids it made obsolete.  Files flushed since stay."""
        captured = task.ids()
        if layout.level(1) and not set(ids(layout.level(1))) <= captured:
            raise StaleTask("level 1 has changed")
        l0 = tuple(f for f in layout.l0 if f.file_id not in captured)
        return replace(layout, l0=l0).with_level(1, output), sorted(captured)
