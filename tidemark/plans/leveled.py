"""Leveled compaction: levels have byte targets, one file at a time moves down."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .layout import Layout, SortedFile, StaleTask, Task, ids


@dataclass(frozen=True)
class Leveled:
    level_size_multiplier: int = 2
    level0_file_num_compaction_trigger: int = 2
    max_levels: int = 4
    base_level_size_mb: int = 128
    name: str = field(default="leveled", init=False)

    def start(self) -> Layout:
        return Layout(levels=tuple((n, ()) for n in range(1, self.max_levels + 1)))

    def flush(self, layout: Layout, file: SortedFile) -> Layout:
        return replace(layout, l0=(file, *layout.l0))

    def targets(self, layout: Layout) -> dict[int, int]:
        """Bytes each level may hold: the last one what it has, the base size at least, and each level
        above a fraction of that as long as the level below it is over the base size."""
        base = self.base_level_size_mb << 20
        goal = max(sum(f.size for f in layout.level(self.max_levels)), base)
        out = {self.max_levels: goal}
        for n in range(self.max_levels - 1, 0, -1):
            goal = goal // self.level_size_multiplier if goal > base else 0
            out[n] = goal
        return out

    def plan(self, layout: Layout) -> Task | None:
        goal = self.targets(layout)
        if len(layout.l0) >= self.level0_file_num_compaction_trigger:
            top = min(n for n, g in goal.items() if g > 0)
            return self._down(layout, 0, layout.l0, top)
        fill = {n: sum(f.size for f in layout.level(n)) for n in goal}
        over = [(fill[n] / goal[n] if goal[n] else float("inf"), n) for n in goal if n < self.max_levels and fill[n] > goal[n]]
        if not over:
            return None
        level = max(over)[1]
        oldest = min(layout.level(level), key=lambda f: f.file_id)
        return self._down(layout, level, (oldest,), level + 1)

    def _down(self, layout: Layout, upper: int, files: tuple[SortedFile, ...], lower: int) -> Task:
        first, last = min(f.first_key for f in files), max(f.last_key for f in files)
        meet = tuple(f for f in layout.level(lower) if f.first_key <= last and f.last_key >= first)
        return Task(self.name, ((upper, ids(files)), (lower, ids(meet))), lower, lower == self.max_levels)

    def apply(self, layout: Layout, task: Task, output: tuple[SortedFile, ...]) -> tuple[Layout, list[int]]:
        (upper, captured), (lower, old) = task.inputs
        source = layout.l0 if upper == 0 else layout.level(upper)
        if not set(captured) <= set(ids(source)) or not set(old) <= set(ids(layout.level(lower))):
            raise StaleTask("files of the task are gone")
        rest = tuple(f for f in source if f.file_id not in captured)
        layout = replace(layout, l0=rest) if upper == 0 else layout.with_level(upper, rest)
        new = [f for f in layout.level(lower) if f.file_id not in old] + list(output)
        return layout.with_level(lower, sorted(new, key=lambda f: f.first_key)), [*captured, *old]
