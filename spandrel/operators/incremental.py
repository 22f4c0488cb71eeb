"""Resolution after a change: only what a change can alter is resolved again.

The answers of the last run are an inverted index: each says by which names it was found (the path of an import, the name
behind an alias, its last segment). A change of files alters
 * the questions of the modules in those files, and
 * the candidates of some names: a candidate came, went, or moved among the candidates of its name.
So what is asked again are the questions of those modules, and the answers that were looked up by one of those names or
that a path to a new or lost node decides. All others are kept; order between files is that of their paths, which a change elsewhere leaves alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spandrel.operators import resolve as R
from spandrel.operators.components import checkpoint, side
from spandrel.operators.graph import first_nodes


@dataclass
class Redone:
    """How many names and imports there are, and how many of them were resolved again."""

    names: int
    names_again: int
    imports: int
    imports_again: int


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file): files that are in one set of facts only, or with another content."""
    a, b = (f.select("file", "lang", "hash").distinct() for f in (old, new))
    key = ["file", "lang", "hash"]
    return a.join(b, key, "left_anti").unionByName(b.join(a, key, "left_anti")).select("file").distinct()


def _candidates(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """(key, id, kind, file, place) of the nodes ``ids``: their place is that among the candidates of a name in a file."""
    nodes = first_nodes(R.node_facts(facts).join(ids, "id", "left_semi"))
    place = F.row_number().over(Window.partitionBy("file", "key").orderBy("seq", "id"))
    return R.registry(nodes).join(nodes.select("id", "file"), "id").select("key", "id", "kind", "file", place.alias("place"))


def moved(old: DataFrame, new: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key), (id)): names whose candidates changed, and nodes that came or went, between two sets of facts."""
    ids = checkpoint(old.unionByName(new).filter("fact = 'node'").join(files, "file", "left_semi").select(F.col("a").alias("id")).distinct())
    was, now = (checkpoint(_candidates(f, ids)) for f in (old, new))
    keys = was.exceptAll(now).unionByName(now.exceptAll(was)).select("key").distinct()
    a, b = was.select("id").distinct(), now.select("id").distinct()
    return checkpoint(keys), checkpoint(a.join(b, "id", "left_anti").unionByName(b.join(a, "id", "left_anti")))


def _stale(kept: DataFrame, keys: DataFrame, ids: DataFrame, by: list[str], path: str) -> DataFrame:
    """``kept`` with ``stale``: looked up by one of ``keys`` or decided by one of ``ids``."""
    n_keys, n_ids = keys.count(), ids.count()
    for c in by:
        kept = kept.join(side(keys.select(F.col("key").alias(c), F.lit(True).alias(f"by_{c}")), n_keys), c, "left")
    kept = kept.join(side(ids.select(F.col("id").alias(path), F.lit(True).alias("by_path")), n_ids), path, "left")
    flags = [f"by_{c}" for c in by] + ["by_path"]
    return kept.withColumn("stale", F.coalesce(*flags, F.lit(False))).drop(*flags)


def update(old: DataFrame, q: R.Questions, kept: R.Answers, files: DataFrame | None = None) -> tuple[R.Answers, Redone]:
    """Answers to the questions ``q``, given those to the facts ``old``; ``files`` (file) are the changed ones."""
    files = checkpoint(changed_files(old, q.facts) if files is None else files)
    modules = checkpoint(old.unionByName(q.facts).join(files, "file", "left_semi").select("module_id").distinct())
    keys, ids = moved(old, q.facts, files)
    few = modules.count()
    mine = lambda df, how: df.join(side(modules, few), "module_id", how)

    names = ["module_id", "name", "path", "real", "short"]
    same = checkpoint(_stale(mine(kept.names, "left_anti"), keys, ids, ["real", "short"], "path"))
    own = R.asked(mine(q.refs, "left_semi"), R.Names(mine(q.names.imports, "left_semi"), mine(q.names.aliases, "left_semi")))
    todo = checkpoint(own.select(*names).unionByName(same.filter("stale").select(*names)))
    wanted = checkpoint(todo.select(F.explode(F.array("real", "short")).alias("key")).distinct())
    n_wanted = wanted.count()
    some = q.reg.join(side(wanted, n_wanted), "key", "left_semi")
    out = checkpoint(same.filter("not stale").select(*kept.names.columns).unionByName(R.answered(todo, q.nodes, some).select(*kept.names.columns)))

    same_i = checkpoint(_stale(mine(kept.imports, "left_anti"), keys, ids, ["short"], "path"))
    todo_i = same_i.filter("stale").select("module_id", "path", F.lit("").alias("seq")).unionByName(mine(q.names.imports, "left_semi").select("module_id", "path", "seq"))
    todo_i = checkpoint(todo_i)
    shorts = todo_i.select(R.last_segment(F.col("path")).alias("key")).distinct()
    again_i = checkpoint(R.import_targets(todo_i, q.nodes, q.reg.join(shorts, "key", "left_semi")).select(*kept.imports.columns))
    out_i = checkpoint(same_i.filter("not stale").select(*kept.imports.columns).unionByName(again_i))

    wish = q.mods.select("name").distinct()
    good = kept.mods.join(wish, "name", "left_semi").join(keys.withColumnRenamed("key", "name"), "name", "left_anti")
    open_ = wish.join(good, "name", "left_anti")
    out_m = checkpoint(good.select("name", "target").unionByName(R.named_modules(open_, q.nodes, q.reg).select("name", "target")))
    return R.Answers(out, out_i, out_m), Redone(out.count(), todo.count(), out_i.count(), again_i.count())
