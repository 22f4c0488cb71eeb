"""Differences between git references, from the top of their trees down.

Git keeps a hash for every folder, so folders with equal hashes are left closed: in each round the tasks open the folders
that differ, both sides of one in the same task, and hand on what differs in them. Only tree objects are read on the way; the
blobs read are those that changed. Facts of unchanged files are taken from the side that has them, and what the change
doesn't alter isn't resolved again. The repository (or a clone of it, at the same path) has to be on every executor.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators import incremental
from spandrel.operators import resolve as R
from spandrel.operators.analytics import diff
from spandrel.operators.components import checkpoint
from spandrel.operators.graph import Graph
from spandrel.operators.tables import Scratch
from spandrel.schema import FACTS
from spandrel.sources import scan as scans
from spandrel.sources.tree import DEFAULT_LANGUAGES, EXTENSIONS, OUTPUTS, SKIPPED_FOLDERS

ENTRY = "path string, folder boolean, old string, new string"
#: Folders that a task opens.
FOLDERS_PER_TASK = 200


class Objects:
    """Objects of a repository by one ``git cat-file --batch``."""

    def __init__(self, repo: str):
        self.process = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def read(self, name: str) -> tuple[str, bytes] | None:
        """(type, content), None for what git doesn't have."""
        self.process.stdin.write(name.encode() + b"\n")
        self.process.stdin.flush()
        head = self.process.stdout.readline().split()
        if len(head) != 3:
            return None
        data = self.process.stdout.read(int(head[2]))
        self.process.stdout.read(1)
        return head[1].decode(), data

    def folder(self, name: str | None) -> dict[tuple[str, bool], str]:
        """{(name, is folder): hash} of a tree object; links count as files, other repositories inside not at all."""
        kind, data = (self.read(name) if name else None) or ("tree", b"")
        if kind != "tree":
            raise ValueError(f"{name} is no tree")
        found, at, width = {}, 0, len(name or "") // 2
        while at < len(data):
            end = data.index(b"\0", at)
            mode, _, label = data[at:end].partition(b" ")
            if mode != b"160000":
                found[label.decode("utf-8", "replace"), mode == b"40000"] = data[end + 1 : end + 1 + width].hex()
            at = end + 1 + width
        return found

    def close(self) -> None:
        self.process.stdin.close()
        self.process.wait()


def _open(repo: str, hidden: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        git = Objects(repo)
        try:
            for pdf in batches:
                rows = []
                for path, old, new in zip(pdf["path"], pdf["old"], pdf["new"], strict=True):
                    a, b = git.folder(old), git.folder(new)
                    for name, folder in sorted(a.keys() | b.keys()):
                        was, now = a.get((name, folder)), b.get((name, folder))
                        if was != now and (hidden or not folder or not (name.startswith(".") or name in SKIPPED_FOLDERS)):
                            rows.append((f"{path}/{name}" if path else name, folder, was, now))
                yield pd.DataFrame(rows, columns=["path", "folder", "old", "new"]).astype({"folder": "bool"})
        finally:
            git.close()

    return run


def _git(repo: str, *words: str, check: bool = True) -> str:
    return subprocess.run(["git", "-C", repo, *words], capture_output=True, check=check).stdout.decode().strip()


def tree_of(repo: str, ref: str) -> str | None:
    """The hash of the folder ``repo`` in a reference, None if it isn't there; an error where there is no such reference."""
    top = _git(repo, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{ref}^{{tree}}")
    inside = _git(repo, "rev-parse", "--show-prefix").rstrip("/")
    return (_git(repo, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{ref}:{inside}", check=False) or None) if inside else top


def changes(spark: SparkSession, repo: str, old: str | None, new: str, languages: Iterable[str] = DEFAULT_LANGUAGES, strict_compat: bool = False) -> tuple[DataFrame, int]:
    """((rel, lang, old, new), folders opened): source files whose blobs differ between two references, null where there is none.

    ``old`` None is the empty tree: then all files of ``new`` come out. Which files are sources is as in ``scan.list_git``.
    """
    first = (tree_of(repo, old) if old else None, tree_of(repo, new))
    scratch, opened = Scratch(spark), 0
    front = spark.createDataFrame([("", *first)] if first[0] != first[1] else [], "path string, old string, new string")
    out = spark.createDataFrame([], ENTRY)
    while rows := front.count():
        opened += rows
        level = scratch.keep(front.repartition(max(1, -(-rows // FOLDERS_PER_TASK))).mapInPandas(_open(repo, strict_compat), ENTRY))
        out = out.unionByName(level.filter("not folder"))
        front = level.filter("folder").select("path", "old", "new")
    name = F.substring_index("path", "/", -1)
    known = {e: x for e, x in EXTENSIONS.items() if x in set(languages) and not (strict_compat and e in ("mjs", "cjs"))}
    lang = F.lit(None).cast("string")
    for e, x in known.items():
        lang = F.when(name.endswith(f".{e}"), x).otherwise(lang)
    found = out.select(F.col("path").alias("rel"), lang.alias("lang"), "old", "new").filter(F.col("lang").isNotNull() & ~F.substring_index("rel", "/", -1).isin(*OUTPUTS))
    return scratch.close(found), opened


def numbered(files: DataFrame) -> DataFrame:
    """``files`` with file_seq, ascending (with gaps) in the order of rel."""
    return checkpoint(files.repartitionByRange("rel").sortWithinPartitions("rel").withColumn("file_seq", F.monotonically_increasing_id()))


def blobs(files: DataFrame, repo: str) -> DataFrame:
    """Contents of files (rel, lang, file_seq, blob), as ``scan.read_git`` gives them."""
    rows = files.count()
    return scans.read_git(files.select(F.col("blob").alias("path"), "rel", "lang", "file_seq").repartition(max(1, -(-rows // FOLDERS_PER_TASK))), repo)


def blob_hash(content: Column, wide: bool) -> Column:
    """The hash git gives a file of this content (``wide``: SHA-256), where no filter changes it on the way in."""
    whole = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.lit("\0")), "utf-8"), content)
    return F.sha2(whole, 256) if wide else F.sha1(whole)


@dataclass
class GitDiff:
    """Both graphs, the four lists of their differences, and the counts of what was opened and read for the second one."""

    old: Graph
    new: Graph
    changes: dict[str, DataFrame]
    folders: int
    blobs: int


def _kept(facts: DataFrame, files: DataFrame) -> DataFrame:
    """``facts`` of the files (rel, file_seq), under their new numbers."""
    now = files.select(F.col("rel").alias("file"), F.col("file_seq").alias("now"))
    return facts.join(now, "file").withColumn("file_seq", F.col("now")).select(*[f.name for f in FACTS])


def _from(facts: DataFrame, files: DataFrame, stale: DataFrame, repo: str) -> tuple[DataFrame, int]:
    """(facts of ``files`` (rel, lang, blob), blobs read): those not in ``stale`` (rel) from ``facts``, the others from git."""
    files = numbered(files)
    again = checkpoint(files.join(stale, "rel", "left_semi"))
    kept = _kept(facts, files.join(stale, "rel", "left_anti"))
    return checkpoint(kept.unionByName(scans.extract_facts(blobs(again, repo)))), again.count()


def _second(facts: DataFrame, other: DataFrame) -> tuple[Graph, Graph]:
    """The graphs of two sets of facts; of the second, only what differs is resolved."""
    q, p = R.questions(facts), R.questions(other)
    found = R.answers(q)
    return R.assemble(q, found), R.assemble(p, incremental.update(facts, p, found)[0])


def diff_refs(spark: SparkSession, repo: str, old: str, new: str, languages: Iterable[str] = DEFAULT_LANGUAGES, strict_compat: bool = False) -> GitDiff:
    """The difference between two references. ``old`` is read whole, of ``new`` the changed blobs."""
    languages = tuple(languages)
    before, _ = changes(spark, repo, None, old, languages, strict_compat)
    before = numbered(before.select("rel", "lang", F.col("new").alias("blob")))
    facts = checkpoint(scans.extract_facts(blobs(before, repo)))
    moved, opened = changes(spark, repo, old, new, languages, strict_compat)
    same = before.select("rel", "lang", "blob").join(moved.select("rel"), "rel", "left_anti")
    after = same.unionByName(moved.filter("new is not null").select("rel", "lang", F.col("new").alias("blob")))
    other, n = _from(facts, after, moved.select("rel"), repo)
    a, b = _second(facts, other)
    return GitDiff(a, b, diff(a, b), opened, n)


def diff_worktree(spark: SparkSession, repo: str, ref: str = "main", languages: Iterable[str] = DEFAULT_LANGUAGES, strict_compat: bool = False) -> GitDiff:
    """The difference between a reference and the working tree, which is read whole; of the reference only blobs that the tree has not."""
    languages = tuple(languages)
    at, opened = changes(spark, repo, None, ref, languages, strict_compat)
    files = scans.scan(spark, repo, languages)
    facts = checkpoint(scans.extract_facts(files))
    own = checkpoint(files.select("rel", blob_hash(F.col("content"), _git(repo, "rev-parse", "--show-object-format") == "sha256").alias("blob")))
    at = at.select("rel", "lang", F.col("new").alias("blob"))
    other, n = _from(facts, at, at.join(own, ["rel", "blob"], "left_anti").select("rel"), repo)
    new, old = _second(facts, other)
    return GitDiff(old, new, diff(old, new), opened, n)
