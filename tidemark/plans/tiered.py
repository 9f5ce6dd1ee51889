"""Size-tiered compaction: every flush is a tier; neighbouring tiers merge into one."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import accumulate

from .layout import Layout, SortedFile, StaleTask, Task, ids


@dataclass(frozen=True)
class Tiered:
    num_tiers: int = 8
    max_size_amplification_percent: int = 200
    size_ratio: int = 1
    min_merge_width: int = 2
    max_merge_width: int | None = None
    name: str = field(default="tiered", init=False)

    def start(self) -> Layout:
        return Layout()

    def flush(self, layout: Layout, file: SortedFile) -> Layout:
        return replace(layout, levels=((file.file_id, (file,)), *layout.levels))

    def plan(self, layout: Layout) -> Task | None:
        if layout.l0:
            raise ValueError("a tiered table has no l0")
        tiers = layout.levels
        if len(tiers) < self.num_tiers:
            return None
        return self._task(layout, self._width([len(fs) for _, fs in tiers]))

    def _width(self, sizes: list[int]) -> int:
        """How many of the newest tiers merge."""
        *newer, last = sizes
        if newer and 100 * sum(newer) >= self.max_size_amplification_percent * last:
            return len(sizes)
        # A tier that outgrows all newer ones together ends the run of tiers to merge.
        for width, (total, following) in enumerate(zip(accumulate(sizes), sizes[1:]), start=1):  # noqa: B905
            if width >= self.min_merge_width and 100 * following > (100 + self.size_ratio) * total:
                return width
        return min(len(sizes), self.max_merge_width or len(sizes))

    def _task(self, layout: Layout, width: int) -> Task:
        chosen = layout.levels[:width]
        return Task(self.name, tuple((n, ids(fs)) for n, fs in chosen), chosen[-1][0], width == len(layout.levels))

    def apply(self, layout: Layout, task: Task, output: tuple[SortedFile, ...]) -> tuple[Layout, list[int]]:
        """The merged tier takes the place of the oldest one it replaces and the id of its first
        file; tiers flushed meanwhile stay in front.  An empty result leaves no tier."""
        captured = dict(task.inputs)
        oldest = task.inputs[-1][0]
        tiers: list[tuple[int, tuple[SortedFile, ...]]] = []
        for number, files in layout.levels:
            if number not in captured:
                tiers.append((number, files))
            elif ids(files) != captured.pop(number):
                raise StaleTask(f"tier {number} has changed")
            elif number == oldest and output:
                tiers.append((output[0].file_id, output))
        if captured:
            raise StaleTask(f"tiers {sorted(captured)} are gone")
        return replace(layout, levels=tuple(tiers)), [i for _, fs in task.inputs for i in fs]
