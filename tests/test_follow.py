"""Following a tree: each change once, over restarts."""

import time

import pytest

from spandrel.sources import scan
from spandrel.streaming import follow


def wait(query, seen, n, seconds=60):
    end = time.time() + seconds
    while len(seen) < n and time.time() < end and query.isActive:
        time.sleep(0.2)
    return seen


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "tree"
    (top / "pkg").mkdir(parents=True)
    (top / "a.py").write_text("x = 1\n")
    (top / "pkg" / "b.py").write_text("y = 1\n")
    return top


def test_changes_once_each_over_restarts(spark, root, tmp_path):
    seen, fail = [], [False]

    def take(changes, number):
        seen.append((number, {(r["rel"], r["change"]) for r in changes.collect()}))
        if fail[0]:
            raise RuntimeError("the handler dies")

    start = lambda: follow.follow(spark, str(root), str(tmp_path / "state"), take, scan.LANGUAGES, "200 milliseconds")
    query = start()
    assert wait(query, seen, 1)[0][1] == {("a.py", "added"), ("pkg/b.py", "added")}
    (root / "graph.html").write_text("x")  # outputs and caches are no sources
    (root / ".spandrel_cache").mkdir()
    (root / ".spandrel_cache" / "c.py").write_text("")
    (root / "a.py").write_text("x = 22\n")
    assert wait(query, seen, 2)[1][1] == {("a.py", "changed")}
    time.sleep(2)
    assert len(seen) == 2
    query.stop()
    time.sleep(3)  # a batch that was under way when the query stopped may still come to its end

    (root / "pkg" / "b.py").unlink()  # while nothing runs
    (root / "c.rs").write_text("fn c() {}\n")
    fail[0] = True
    query = start()
    with pytest.raises(Exception, match="the handler dies"):
        query.awaitTermination(60)
    assert seen[2][1] == {("pkg/b.py", "removed"), ("c.rs", "added")} and len(seen) == 3
    (root / "late.py").write_text("")  # not part of the batch that is given again
    fail[0] = False
    query = start()
    wait(query, seen, 5)
    query.stop()
    assert seen[3] == seen[2] and seen[4][1] == {("late.py", "added")}


def test_analyses(spark, root, tmp_path):
    graphs = []
    query = follow.analyses(spark, str(root), str(tmp_path / "state"), lambda g, n: graphs.append({r["id"] for r in g.nodes.collect()}), ("python",), "200 milliseconds")
    wait(query, graphs, 1)
    (root / "a.py").write_text("def fresh():\n    pass\n")
    wait(query, graphs, 2)
    time.sleep(2)
    query.stop()
    assert len(graphs) == 2 and "a.fresh" in graphs[1] - graphs[0]
