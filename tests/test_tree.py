"""The data source of source trees."""

import hashlib

import pytest

from spandrel.sources import scan, tree


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for rel in ["a.py", "__init__.py", ".hid.py", "x.txt", "graph.json", "noext", "pkg/_b.py", "pkg/deep/er/c.rs", "pkg/deep/d.cpp", ".git/e.py", "target/f.py", "pkg/node_modules/g.js", "w/h.ts", "w/i.mjs", "ä ö/j k.py"]:
        p = top / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(f"# {rel}\n".encode() + b"\xff")
    for k in range(2500):
        (top / "flat").mkdir(exist_ok=True)
        (top / "flat" / f"m{k}.py").write_text(f"x = {k}\n")
    return top


SMALL = [".hid.py", "__init__.py", "a.py", "pkg/_b.py", "pkg/deep/d.cpp", "pkg/deep/er/c.rs", "w/h.ts", "w/i.mjs", "ä ö/j k.py"]


def load(spark, root, **options):
    tree.register(spark)
    out = spark.read.format("sourcetree").option("path", str(root)).option("languages", ",".join(scan.LANGUAGES))
    for k, v in options.items():
        out = out.option(k, v)
    return out.load()


@pytest.mark.parametrize("partitions", [1, 4, 256])
def test_every_file_once_however_it_is_split(spark, root, partitions):
    files = load(spark, root, partitions=partitions)
    rels = sorted(r["rel"] for r in files.collect())
    assert rels == sorted(SMALL + [f"flat/m{k}.py" for k in range(2500)])
    assert files.rdd.getNumPartitions() >= (5 if partitions == 256 else 1)  # the flat folder alone is three


def test_contents(spark, root):
    rows = {r["rel"]: r for r in load(spark, f"file://{root}", content="true").filter("rel not like 'flat/%'").collect()}
    assert sorted(rows) == sorted(SMALL)
    for rel, r in rows.items():
        data = (root / rel).read_bytes()
        assert (bytes(r["content"]), r["size"], r["hash"]) == (data, len(data), hashlib.sha256(data).hexdigest())


def reader(root, **options):
    return tree.TreeReader({"path": str(root), "languages": ",".join(scan.LANGUAGES), **options})


def test_conditions_prune_folders_and_languages(spark, root, monkeypatch):
    assert sorted(r["rel"] for r in load(spark, root).filter("lang in ('rust', 'cpp') and rel like 'pkg/%'").collect()) == ["pkg/deep/d.cpp", "pkg/deep/er/c.rs"]
    assert [r["rel"] for r in load(spark, root).filter("rel = 'w/h.ts'").collect()] == ["w/h.ts"]
    assert load(spark, root).filter("lang = 'cobol'").count() == 0
    plan = load(spark, root).filter("lang = 'rust'")._jdf.queryExecution().executedPlan().toString()
    assert "sourcetree" in plan and "= rust" not in plan  # Spark keeps its check for null only
    r = reader(root)
    assert list(r.pushFilters([tree.EqualTo(("lang",), "rust"), tree.StringStartsWith(("rel",), "pkg/deep/")])) == []
    listed = []
    real = tree.TreeReader._list
    monkeypatch.setattr(tree.TreeReader, "_list", lambda self, system, top, folder: (listed.append(folder), real(self, system, top, folder))[1])
    assert [x.to_pylist()[0]["rel"] for p in r.partitions() for x in r.read(p)] == ["pkg/deep/er/c.rs"]
    assert set(listed) == {"", "pkg", "pkg/deep", "pkg/deep/er"}


def test_planning_lists_few_folders(tmp_path, monkeypatch):
    for a in range(30):
        for b in range(10):
            (tmp_path / f"a{a}" / f"b{b}").mkdir(parents=True)
            (tmp_path / f"a{a}" / f"b{b}" / "x.py").write_text("")
    listed = []
    real = tree.TreeReader._list
    monkeypatch.setattr(tree.TreeReader, "_list", lambda self, system, top, folder: (listed.append(folder), real(self, system, top, folder))[1])
    r = reader(tmp_path, partitions="20")
    parts = r.partitions()
    assert listed == [""] and len(parts) == 30
    assert sum(b.num_rows for p in parts for b in r.read(p)) == 300


def test_missing_and_empty_folders(spark, tmp_path):
    assert load(spark, tmp_path / "nowhere").count() == 0 and load(spark, tmp_path).count() == 0
    assert scan.scan(spark, str(tmp_path)).count() == 0


def test_listing_is_numbered_in_order(spark, root):
    rows = scan.listing(spark, str(root), scan.LANGUAGES).orderBy("file_seq").collect()
    assert [r["rel"] for r in rows] == sorted((r["rel"] for r in rows), key=str.encode) and len(rows) == 2509
    got = {r["rel"]: r["hash"] for r in scan.with_contents(scan.listing(spark, str(root), scan.LANGUAGES)).collect()}
    assert len(got) == 2509 and got["flat/m7.py"] == hashlib.sha256(b"x = 7\n").hexdigest()


def test_written_tree_comes_back(spark, tmp_path):
    files = spark.createDataFrame([("a/b.py", bytearray(b"1")), ("c.rs", bytearray(b"")), ("a/d/é.ts", bytearray("é".encode()))], "rel string, content binary")
    assert tree.write_tree(files, f"file://{tmp_path}/new") == 3
    assert {(r["rel"], bytes(r["content"])) for r in load(spark, f"{tmp_path}/new", content="true").collect()} == {(r["rel"], bytes(r["content"])) for r in files.collect()}
