"""Files of a folder or of a git reference as DataFrames: listing, reading, hashing, extracting.

A folder is listed and read by the data source of ``tree``; a reference by git, in the executors, a slice of the names each.
"""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from spandrel.schema import FACTS, LANGUAGES
from spandrel.sources.tree import DEFAULT_LANGUAGES, OUTPUTS, SKIPPED_FOLDERS, language_of, listing, with_contents

CACHE = ".spandrel_cache"
FILES = "path string, rel string, lang string, file_seq long"
#: Facts that leave an extracting task together, at least.
ROWS = 10_000


def select_languages(python: bool = True, rust: bool = True, cpp: bool = False, typescript: bool = False, javascript: bool = False) -> tuple[str, ...]:
    return tuple(x for x, on in zip(LANGUAGES, (python, rust, cpp, typescript, javascript), strict=True) if on)


def _visible(rel: str) -> bool:
    *folders, _ = rel.split("/")
    return not any(d.startswith(".") or d in SKIPPED_FOLDERS for d in folders)


def list_files(root: str, languages: Iterable[str] = DEFAULT_LANGUAGES) -> list[tuple[str, str, str, int]]:
    """(path, rel, lang, file_seq), sorted by rel; folders that cannot be read are left out."""
    found = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".") and d not in SKIPPED_FOLDERS]
        for n in names:
            if n not in OUTPUTS and (lang := language_of(n)) in set(languages):
                path = os.path.join(folder, n)
                found.append((path, os.path.relpath(path, root).replace("\\", "/"), lang))
    return [(*f, i) for i, f in enumerate(sorted(found, key=lambda f: f[1]))]


def files_frame(spark: SparkSession, rows: list[tuple], slices: int | None = None) -> DataFrame:
    n = slices or max(1, min(len(rows) // 16 + 1, 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(rows, FILES).repartition(n)


def list_git(repo: str, ref: str, languages: Iterable[str] = DEFAULT_LANGUAGES, strict_compat: bool = False) -> list[tuple[str, str, str, int]]:
    """The files of a git reference. ``strict_compat``: without .mjs and .cjs, but with hidden and build folders."""
    out = subprocess.run(["git", "-C", repo, "ls-tree", "-r", "-z", "--name-only", ref], capture_output=True, check=True).stdout
    names = sorted(n for n in out.decode("utf-8", "replace").split("\0") if n)
    keep = (lambda n: not n.endswith((".mjs", ".cjs"))) if strict_compat else _visible
    rows = [(f"{ref}:{n}", n, lang) for n in names if (lang := language_of(n.rpartition("/")[2])) in set(languages) and keep(n) and n.rpartition("/")[2] not in OUTPUTS]
    return [(*r, i) for i, r in enumerate(rows)]


def read_git(files: DataFrame, repo: str) -> DataFrame:
    """Contents by one ``git cat-file --batch`` per slice; what git does not have is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    p.stdin.write(r.path.encode() + b"\n")
                    p.stdin.flush()
                    head = p.stdout.readline().split()
                    if len(head) != 3 or head[1] != b"blob":
                        continue
                    data = p.stdout.read(int(head[2]))
                    p.stdout.read(1)
                    yield pd.DataFrame([(r.path, r.rel, r.lang, r.file_seq, hashlib.sha256(data).hexdigest(), data)], columns=["path", "rel", "lang", "file_seq", "hash", "content"])
        finally:
            p.stdin.close()
            p.wait()

    return files.mapInPandas(run, f"{FILES}, hash string, content binary")


def facts_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """FACTS of files, in frames of ``ROWS`` rows or as many as there are: a frame for each file costs more than reading it."""
    from spandrel.sources.extract import extract

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[f.name for f in FACTS]).astype({"line": "Int64"})

    found: list[tuple] = []
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            text = bytes(r.content).decode("utf-8", "replace")
            try:
                f = extract(r.lang, text, r.rel)
                module, rows = f.module_id, f.rows
            except Exception as e:  # noqa: BLE001  a quarantined file is a row, not a failed job
                module, rows = r.rel, [("error", f"{type(e).__name__}: {e}", None, None, None, None)]
            found += [(r.file_seq, i, module, r.rel, r.lang, r.hash, *x) for i, x in enumerate(rows)]
            if len(found) >= ROWS:
                yield frame(found)
                found = []
    if found:
        yield frame(found)


def extract_facts(files: DataFrame) -> DataFrame:
    """FACTS of files with contents; bytes that are no UTF-8 become U+FFFD. One file that fails spoils no other."""
    return files.mapInPandas(facts_of, FACTS)


def scan(spark: SparkSession, root: str, languages: Iterable[str] = DEFAULT_LANGUAGES) -> DataFrame:
    return with_contents(listing(spark, root, languages))


def sources_frame(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """Files from (rel, text) pairs, with contents."""
    rows = [(rel, rel, language_of(rel.rpartition("/")[2]), i, hashlib.sha256(t.encode()).hexdigest(), t.encode()) for i, (rel, t) in enumerate(sorted(sources))]
    return spark.createDataFrame(rows, f"{FILES}, hash string, content binary")


