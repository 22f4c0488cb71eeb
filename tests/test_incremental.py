"""Incremental resolution: the same graph as a cold run, with only what a change alters resolved again."""

import random

import pytest

from spandrel.operators import incremental
from spandrel.operators import resolve as R
from spandrel.operators.components import checkpoint
from spandrel.plans import fixtures as X
from spandrel.sources import cache, scan

WORDS = ["Dog", "Cat", "run", "eat", "Base", "helper", "go"]


def source(r, name):
    """A small module: imports, classes with a base and methods, functions that call by name."""
    lines = [f"from {r.choice('abcdefgh')} import {r.choice(WORDS)}" for _ in range(r.randint(0, 2))] + [f"import {r.choice('abcdefgh')} as {r.choice(WORDS)}" for _ in range(r.randint(0, 1))]
    for _ in range(r.randint(0, 2)):
        lines += [f"class {r.choice(WORDS)}({r.choice(WORDS)}):", f"    def {r.choice(WORDS)}(self, x: {r.choice(WORDS)}):", f"        {r.choice(WORDS)}()"]
    for _ in range(r.randint(0, 2)):
        lines += [f"def {r.choice(WORDS)}():", f"    {r.choice(WORDS)}()"]
    return "\n".join([*lines, f"{name}_X = 1", ""])


def facts(spark, tree):
    return checkpoint(scan.extract_facts(scan.sources_frame(spark, [(f"{n}.py", t) for n, t in tree.items()])))


def edges(graph):
    return sorted(map(tuple, graph.edges.select("source", "target", "kind").collect())), sorted(map(str, graph.nodes.drop("seq").collect()))


@pytest.mark.parametrize("seed", [0, 2])
def test_edits_in_turn_give_the_cold_graph(spark, seed):
    r = random.Random(seed)
    tree = {n: source(r, n) for n in "abcdeg"}
    old = facts(spark, tree)
    kept = R.answers(R.questions(old))
    for step in range(2):
        for n in r.sample("abcdefgh", r.randint(1, 3)):  # changed, added or removed
            if n in tree and r.random() < 0.3:
                del tree[n]
            else:
                tree[n] = source(r, n)
        new = facts(spark, tree)
        q = R.questions(new)
        kept, redone = incremental.update(old, q, kept)
        assert redone.names_again <= redone.names and redone.imports_again <= redone.imports
        assert edges(R.assemble(q, kept)) == edges(R.build_graph(new)), (seed, step)
        old = new


def test_only_what_a_change_alters_is_resolved_again(spark):
    """200 files that call a function of their own and one of lib_0: an edit inside one file redoes that file's names; a new function redoes its callers."""
    tree = {f"m{i:03d}": f"import lib{i % 5}\ndef own{i}():\n    shared{i % 5}()\ndef user{i}():\n    own{i}()\n    later{i % 50}()\n" for i in range(200)} | {f"lib{k}": f"def shared{k}():\n    pass\n" for k in range(5)}
    old = facts(spark, tree)
    kept = R.answers(R.questions(old))

    def change(name, text):
        nonlocal old, kept
        tree[name] = text
        new = facts(spark, tree)
        q = R.questions(new)
        kept, redone = incremental.update(old, q, kept)
        old = new
        assert edges(R.assemble(q, kept)) == edges(R.build_graph(new))
        return redone

    same = change("m007", tree["m007"] + "\n# a comment\n")
    assert same.names == 600 and same.names_again == 3 and same.imports_again == 1
    added = change("lib9", "def later3():\n    pass\n")
    assert added.names_again == 4 and added.imports_again == 0  # of the 200 files, m003, m053, m103 and m153 call it
    swapped = change("lib0", "def other():\n    pass\ndef shared0():\n    pass\n")
    assert swapped.names_again == 0 and swapped.imports_again == 0  # shared0 is still the only candidate of its name


def test_analysis_with_a_cache(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.py").write_text(f"import a\ndef f{n}():\n    fa()\n")
    store, scanned = cache.Cache(str(tmp_path)), lambda: scan.scan(spark, str(tmp_path), ("python",))
    assert cache.analyze_again(store, scanned())[1] is None
    (tmp_path / "c.py").write_text("def fc():\n    fb()\n")
    graph, redone = cache.analyze_again(store, scanned())
    assert redone.names_again == 1 and edges(graph) == edges(cache.analyze(spark, str(tmp_path), use_cache=False))
    assert len(store.versions(spark)) == 1


class Dies:
    """Answers that end the run when it comes to one of their tables."""

    def __init__(self, found, part):
        self._found, self._part = found, part

    def __getattr__(self, name):
        if name == self._part:
            raise KeyboardInterrupt
        return getattr(self._found, name)


def test_a_killed_run_leaves_the_version_before(spark, tmp_path):
    """However far saving comes, the cache can be read, and the next run is right."""
    (tmp_path / "a.py").write_text("def fa():\n    pass\n")
    store, scanned = cache.Cache(str(tmp_path)), lambda: scan.scan(spark, str(tmp_path), ("python",))
    cache.analyze_again(store, scanned())
    (tmp_path / "b.py").write_text("def fb():\n    fa()\n")
    q = R.questions(checkpoint(scan.extract_facts(scanned())))
    found = R.answers(q)
    for part in cache.PARTS:
        with pytest.raises(KeyboardInterrupt):
            store.save(q.facts, Dies(found, part))
        assert [r["file"] for r in store.load(spark).select("file").distinct().collect()] == ["a.py"]
    graph, redone = cache.analyze_again(store, scanned())
    assert redone is not None and ("b.fb", "a.fa", "calls") in edges(graph)[0]
    assert [marked for _, marked in store.versions(spark)] == [True]


def test_pages(spark, data):
    old, new = checkpoint(X.page_facts(spark, data, older=True)), checkpoint(X.page_facts(spark, data))
    q = R.questions(new)
    found, redone = incremental.update(old, q, R.answers(R.questions(old)))
    assert edges(R.assemble(q, found)) == edges(R.build_graph(new))
    assert 0 < redone.names_again < redone.names
