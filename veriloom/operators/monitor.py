"""Watching stages: time and memory of the driver, progress lines, counts of work, and sweeps over settings."""

from __future__ import annotations

import resource
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation

from ..config import Config, override


def resident_mb() -> float:
    """Memory that this process holds now."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize() / 1e6
    except OSError:
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3


@dataclass
class StageMonitor:
    """MON1: seconds and peak memory of each stage, sampled while it runs."""

    every: float = 0.05
    stages: dict[str, dict[str, float]] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began, done, peak = time.perf_counter(), threading.Event(), [resident_mb()]

        def watch() -> None:
            while not done.wait(self.every):
                peak[0] = max(peak[0], resident_mb())

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        try:
            yield
        finally:
            done.set()
            thread.join()
            self.stages[name] = {"seconds": time.perf_counter() - began, "peak_mb": max(peak[0], resident_mb())}


def progress(label: str, say: Callable[[str], None], every: int = 500, seconds: float = 30.0, clock: Callable[[], float] = time.perf_counter) -> Callable[[int, int], None]:
    """MON2: a callback (done, total) that reports every ``every`` items or ``seconds``, and at the end, with the time left at the pace so far."""
    began = clock()
    last = {"done": 0, "at": began}

    def report(done: int, total: int) -> None:
        now = clock()
        if done < total and done - last["done"] < every and now - last["at"] < seconds:
            return
        pace = (now - began) / max(1, done)
        say(f"{label}: {done:,} of {total:,}, {(now - began) / 60:.1f} min so far, {pace * (total - done) / 60:.1f} min left")
        last.update(done=done, at=now)

    return report


def counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """AGG20: ``df`` with counters that fill while whatever runs it passes its rows; read them from the observation's ``get``."""
    watch = Observation()
    return df.observe(watch, *(c.alias(name) for name, c in counts.items())), watch


def sweep(config: Config, settings: Mapping[str, Sequence[Any]], run: Callable[[Config], Mapping[str, Any]]) -> list[dict[str, Any]]:
    """SWP1: ``run`` once for each value of each setting (``section.key``), others as in ``config``; upstream tables are best saved before."""
    out = []
    for name, values in settings.items():
        for value in values:
            text = str(value).lower() if isinstance(value, bool) else value
            out.append({"setting": name, "value": value, **run(override(config, f"{name}={text}"))})
    return out
