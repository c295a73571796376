"""Stimulus protocols: half-open windows in seconds, as values, predicates and tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Window:
    """Times with start <= t < end."""

    phase: str
    start: float
    end: float

    def holds(self, t: Column) -> Column:
        return (t >= F.lit(float(self.start))) & (t < F.lit(float(self.end)))

    def frames(self, fs: float) -> tuple[int, int]:
        """First index and the one after the last; halves are rounded to even."""
        return round(self.start * fs), round(self.end * fs)

    def holds_frame(self, t_idx: Column, fs: float) -> Column:
        first, after = self.frames(fs)
        return (t_idx >= first) & (t_idx < after)


@dataclass(frozen=True)
class Cycle:
    index: int
    baseline: Window | None
    flicker: Window
    recovery: Window

    def windows(self) -> list[Window]:
        return [w for w in (self.baseline, self.flicker, self.recovery) if w is not None]


@dataclass(frozen=True)
class Protocol:
    name: str
    fs: float
    global_baseline: Window | None = None
    cycles: tuple[Cycle, ...] = field(default_factory=tuple)
    end_baseline: Window | None = None

    def windows(self) -> list[tuple[int, Window]]:
        """(cycle, window) in order: the global baseline, cycles, the end baseline; -1 outside cycles."""
        out = [(-1, self.global_baseline)] if self.global_baseline else []
        out += [(c.index, w) for c in self.cycles for w in c.windows()]
        return out + ([(-1, self.end_baseline)] if self.end_baseline else [])

    def phase(self, name: str) -> list[Window]:
        return [w for _, w in self.windows() if w.phase == name]

    def in_phase(self, t: Column, name: str) -> Column:
        return any_of(t, self.phase(name))

    def in_cycle(self, t: Column, index: int) -> Column:
        if not self.cycles:
            raise ValueError("the protocol has no cycles")
        return any_of(t, [w for k, w in self.windows() if k == index])

    def end(self) -> float:
        return max((w.end for _, w in self.windows()), default=0.0)

    def baseline_of(self, cycle: Cycle) -> Window | None:
        return cycle.baseline or self.global_baseline

    def reference(self, source: str = "protocol_global", custom: Window | None = None) -> Window:
        """The window that percent values refer to; the global one falls back to the first cycle's."""
        first = self.cycles[0].baseline if self.cycles else None
        found = {"protocol_global": self.global_baseline or first, "cycle0_baseline": first, "custom": custom}[source]
        if found is None:
            raise ValueError(f"the protocol has no baseline for {source}")
        return found

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, self.fs, k, w.phase, float(w.start), float(w.end)) for k, w in self.windows()]
        return spark.createDataFrame(rows, "protocol string, fs double, cycle_index int, phase string, start_sec double, end_sec double")

    def check(self, baseline: float = 30, flicker: float = 20, recovery: float = 50) -> None:
        """Cycles have the given durations and follow each other."""
        last = 0.0
        for c in self.cycles:
            for w, length in ((c.baseline, baseline), (c.flicker, flicker), (c.recovery, recovery)):
                if w is None:
                    continue
                if abs(w.end - w.start - length) > 1e-9 or w.start < last:
                    raise ValueError(f"cycle {c.index}: {w.phase} lasts {w.end - w.start} s from {w.start} s")
                last = w.end


def any_of(t: Column, windows: list[Window]) -> Column:
    return reduce(lambda a, b: a | b, (w.holds(t) for w in windows), F.lit(False))


def standard(fs: float = 25.0, cycles: int = 3) -> Protocol:
    """20 s of rest, then cycles of 30 s baseline, 20 s flicker and 50 s recovery."""
    made = tuple(Cycle(i, Window("baseline", 20 + 100 * i, 50 + 100 * i), Window("flicker", 50 + 100 * i, 70 + 100 * i), Window("recovery", 70 + 100 * i, 120 + 100 * i)) for i in range(cycles))
    return Protocol("standard", fs, Window("baseline", 0, 20), made)
