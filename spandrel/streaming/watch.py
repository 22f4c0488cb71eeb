"""Watch mode: run an analysis again whenever the source files of a folder change."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession

from spandrel.operators.graph import Graph
from spandrel.sources import cache, scan


def snapshot(root: str, languages: Iterable[str]) -> dict[str, tuple[int, int]]:
    """Size and time of change by path, of the files that an analysis would read; the engine's own outputs are none."""
    out = {}
    for path, _, _, _ in scan.list_files(root, languages):
        try:
            s = os.stat(path)
        except OSError:
            continue
        out[path] = (s.st_size, s.st_mtime_ns)
    return out


def changes(root: str, languages: Iterable[str] = scan.DEFAULT_LANGUAGES, every: float = 1.0, rounds: int | None = None) -> Iterator[list[str]]:
    """Paths that were added, removed or changed since the last look, whenever there are any."""
    before, n = snapshot(root, languages), 0
    while rounds is None or n < rounds:
        time.sleep(every)
        n += 1
        now = snapshot(root, languages)
        moved = sorted(p for p in before.keys() | now.keys() if before.get(p) != now.get(p))
        before = now
        if moved:
            yield moved


def watch(spark: SparkSession, root: str, on_graph: Callable[[Graph], None], languages: Iterable[str] = scan.DEFAULT_LANGUAGES, every: float = 1.0, rounds: int | None = None) -> int:
    """Analyse once, then after every change with the cache, and hand each graph on. Gives the number of analyses."""
    on_graph(cache.analyze(spark, root, languages))
    runs = 1
    for _ in changes(root, languages, every, rounds):
        on_graph(cache.analyze(spark, root, languages))
        runs += 1
    return runs
