"""Simple leveled compaction: levels are compared by their number of files."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .layout import Layout, SortedFile, StaleTask, Task, ids


@dataclass(frozen=True)
class SimpleLeveled:
    size_ratio_percent: int = 200
    level0_file_num_compaction_trigger: int = 2
    max_levels: int = 3
    name: str = field(default="simple", init=False)

    def start(self) -> Layout:
        return Layout(levels=tuple((n, ()) for n in range(1, self.max_levels + 1)))

    def flush(self, layout: Layout, file: SortedFile) -> Layout:
        return replace(layout, l0=(file, *layout.l0))

    def plan(self, layout: Layout) -> Task | None:
        """A full l0 moves into level 1, never as the bottom; else the first level that is too large
        for the next one moves down whole."""
        if len(layout.l0) >= self.level0_file_num_compaction_trigger:
            return self._pair(layout, 0, False)
        for upper in range(1, self.max_levels):
            above, below = len(layout.level(upper)), len(layout.level(upper + 1))
            if above and 100 * below < self.size_ratio_percent * above:
                return self._pair(layout, upper, upper + 1 == self.max_levels)
        return None

    def _pair(self, layout: Layout, upper: int, bottom: bool) -> Task:
        top = layout.l0 if upper == 0 else layout.level(upper)
        return Task(self.name, ((upper, ids(top)), (upper + 1, ids(layout.level(upper + 1)))), upper + 1, bottom)

    def apply(self, layout: Layout, task: Task, output: tuple[SortedFile, ...]) -> tuple[Layout, list[int]]:
        (upper, captured), (lower, old) = task.inputs
        if ids(layout.level(lower)) != old:
            raise StaleTask(f"level {lower} has changed")
        if upper:
            if ids(layout.level(upper)) != captured:
                raise StaleTask(f"level {upper} has changed")
            layout = layout.with_level(upper, ())
        else:
            if not set(captured) <= set(ids(layout.l0)):
                raise StaleTask("l0 lost files of the task")
            layout = replace(layout, l0=tuple(f for f in layout.l0 if f.file_id not in captured))
        return layout.with_level(lower, output), [*captured, *old]
