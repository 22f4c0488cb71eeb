"""Digests of folders, and differences of git references that open and read only what changed."""

import random
import subprocess

import pytest

from spandrel.operators import merkle
from spandrel.operators.analytics import diff
from spandrel.schema import EDGE_COLUMNS
from spandrel.sources import cache, git, scan

LANGS = ("python", "rust")


def digests(spark, files, **more):
    return merkle.Digests.of(spark.createDataFrame(list(files.items()) if isinstance(files, dict) else files, "rel string, hash string"), **more)


def plain(a, b):
    return {(r, "added" if r not in a else "removed" if r not in b else "changed") for r in a.keys() | b.keys() if a.get(r) != b.get(r)}


@pytest.mark.parametrize("seed", range(3))
def test_random_trees(spark, seed):
    rnd = random.Random(seed)
    name = lambda: "/".join(rnd.choice("abcdeé x") for _ in range(rnd.randint(1, 5)))
    a = {f"{name()}.py": str(rnd.randint(0, 9)) for _ in range(300)}
    b = {r: h for r, h in a.items() if rnd.random() < 0.95} | {f"{name()}.py": "new" for _ in range(5)}
    found, _ = merkle.compare(digests(spark, a, buckets=7), digests(spark, b, buckets=3))
    assert {(r["rel"], r["change"]) for r in found.collect()} == plain(a, b)
    assert all((r["old_hash"], r["new_hash"]) == (a.get(r["rel"]), b.get(r["rel"])) for r in found.collect())


def test_only_differing_folders_are_opened(spark):
    a = {f"d{i}/e{j}/f{k}.py": "x" for i in range(10) for j in range(10) for k in range(5)}
    b = a | {"d3/e4/f1.py": "y"}
    old, new = digests(spark, a, buckets=64), digests(spark, b, buckets=64)
    found, opened = merkle.compare(old, new)
    assert [tuple(r) for r in found.collect()] == [("d3/e4/f1.py", "changed", "x", "y")]
    assert (opened.folders, opened.entries) == (3, 10 + 10 + 5)
    files = new.below(1, spark.createDataFrame([("d3",)], "path string"), 1).inputFiles()
    assert len(files) > 0
    plan = new.below(1, spark.createDataFrame([("d3",)], "path string"), 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "depth" in plan.split("PartitionFilters")[1].split("]")[0]
    same, none = merkle.compare(old, digests(spark, a))
    assert same.count() == 0 and (none.folders, none.entries) == (0, 0)


def test_awkward_trees(spark):
    empty = digests(spark, {})
    assert merkle.compare(empty, empty)[0].count() == 0
    one = digests(spark, [("a", "1"), ("a", "0"), ("b/c", None), (None, "x")])
    assert {tuple(r) for r in merkle.compare(empty, one)[0].collect()} == {("a", "added", None, "0"), ("b/c", "added", None, "")}
    # A file becomes a folder, a file moves, two files change places.
    a, b = {"x": "1", "p/a": "1", "p/b": "2", "q/m": "3"}, {"x/y": "1", "p/a": "2", "p/b": "1", "q/n": "3"}
    assert {(r["rel"], r["change"]) for r in merkle.compare(digests(spark, a), digests(spark, b))[0].collect()} == plain(a, b)
    folders = {r["path"]: (r["old_files"], r["new_files"], r["same"]) for r in merkle.folder_changes(digests(spark, a), digests(spark, b)).collect()}
    assert folders == {"": (4, 4, False), "x": (0, 1, False), "p": (2, 2, False), "q": (1, 1, False)}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    top = tmp_path_factory.mktemp("repo")

    def run(*a):
        subprocess.run(["git", "-C", str(top), "-c", "user.name=x", "-c", "user.email=x@example.org", *a], check=True, capture_output=True)

    def write(rel, text):
        (top / rel).parent.mkdir(parents=True, exist_ok=True)
        (top / rel).write_text(text)

    for i in range(12):
        for j in range(4):
            write(f"pkg{i}/m{j}.py", f"from pkg{(i + 1) % 12}.m{j} import f{j}\n\n\ndef f{j}():\n    helper()\n")
    write("lib/helper.py", "def helper():\n    pass\n")
    write("lib/core.rs", "pub struct A {}\n")
    write("docs/read.md", "x")
    write(".hidden/h.py", "def hidden():\n    pass\n")
    write("target/t.py", "def built():\n    pass\n")
    run("init", "-q", "-b", "main")
    run("add", "-A", "-f")
    run("commit", "-qm", "one")
    run("tag", "one")
    write("pkg3/m1.py", "def f1():\n    pass\n\n\ndef fresh():\n    helper()\n")
    write("lib/more.py", "class More:\n    def go(self):\n        helper()\n")
    write("docs/read.md", "y")
    (top / "pkg7" / "m2.py").unlink()
    run("add", "-A")
    run("commit", "-qm", "two")
    run("tag", "two")
    return top


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def full(spark, repo, ref):
    return cache.analyze_git(spark, str(repo), ref, LANGS)


def assert_same(spark, found, old, new):
    for ours, theirs in ((found.old, old), (found.new, new)):
        assert rows(ours.edges, *EDGE_COLUMNS) == rows(theirs.edges, *EDGE_COLUMNS)
        assert rows(ours.nodes, "id", "name", "kind", "file", "line", "is_external") == rows(theirs.nodes, "id", "name", "kind", "file", "line", "is_external")
    want = diff(old, new)
    for name, df in found.changes.items():
        assert rows(df, *df.columns) == rows(want[name], *df.columns), name


def test_changes_of_references(spark, repo):
    found, opened = git.changes(spark, str(repo), "one", "two", LANGS)
    assert {(r["rel"], r["old"] is None, r["new"] is None) for r in found.collect()} == {("pkg3/m1.py", False, False), ("lib/more.py", True, False), ("pkg7/m2.py", False, True)}
    assert opened == 5  # the root, docs, lib, pkg3, pkg7
    whole, opened = git.changes(spark, str(repo), None, "one", LANGS)
    assert sorted(r["rel"] for r in whole.collect()) == sorted(f[1] for f in scan.list_git(str(repo), "one", LANGS)) and opened == 15
    strict, _ = git.changes(spark, str(repo), None, "one", LANGS, strict_compat=True)
    assert sorted(r["rel"] for r in strict.collect()) == sorted(f[1] for f in scan.list_git(str(repo), "one", LANGS, strict_compat=True))
    assert git.changes(spark, str(repo), "two", "two")[0].count() == 0
    inner, _ = git.changes(spark, str(repo / "lib"), None, "two", LANGS)
    assert sorted(r["rel"] for r in inner.collect()) == ["core.rs", "helper.py", "more.py"]
    with pytest.raises(subprocess.CalledProcessError):
        git.changes(spark, str(repo), None, "nowhere")


def test_diff_of_references_reads_changed_blobs(spark, repo):
    found = git.diff_refs(spark, str(repo), "one", "two", LANGS)
    assert found.blobs == 2 and found.folders == 5
    assert_same(spark, found, full(spark, repo, "one"), full(spark, repo, "two"))
    assert "pkg3.m1.fresh" in {r["id"] for r in found.changes["added_nodes"].collect()}


def test_diff_with_the_working_tree_reads_changed_blobs(spark, repo):
    (repo / "pkg5" / "m0.py").write_text("def other():\n    helper()\n")
    (repo / "pkg6" / "m0.py").unlink()
    found = git.diff_worktree(spark, str(repo), "two", LANGS)
    assert found.blobs == 2
    assert_same(spark, found, full(spark, repo, "two"), cache.analyze(spark, str(repo), LANGS, use_cache=False))
