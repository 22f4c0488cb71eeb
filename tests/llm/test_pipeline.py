import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
from test_dedup_and_join import brute
from tokenizers import Tokenizer

import corpus_pipeline
from spandrel.llm import toxicity
from spandrel.llm.common import table


def test_stages_against_brute_force(spark, data, tmp_path):
    """Each stage on what the one before kept, next to a plain version."""
    docs = table(spark, data, "documents")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()} if "text" in docs.columns else {}
        out = stage(spark, docs, data)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = (before, docs.collect())
    before, after = kept["toxicity"]
    lexicon = toxicity.learn(table(spark, data, "documents"), table(spark, data, "labels"))
    assert {r.doc_id for r in after} == {i for i, r in before.items() if lexicon.rate(r.text)[0] < lexicon.cut}
    before, after = kept["exact dedup"]
    first = {}
    for i in sorted(before):
        first.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", before[i].text or "").encode()).digest(), i)
    assert {r.doc_id for r in after} == set(first.values())
    before, after = kept["n-gram Jaccard join"]
    parts = brute([(i, r.text) for i, r in before.items()], 5, 80, 100)
    assert {r.doc_id for r in after} == {i for i, _, c in parts if i == c}
    before, after = kept["PII"]
    assert {r.doc_id for r in after} == set(before)
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r.text or "") for r in after)
    before, after = kept["best-fit packing"]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i in sorted(before)[:40]:
        ids = np.array([*t.encode(before[i].text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = [r for r in after if r.doc_id == i]
        assert sum(r.length for r in mine) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)


def test_run_on_awkward_tables(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, repeated rows, an extra column, and no rows at all."""
    long = " ".join(f"long{i}" for i in range(6000))
    near = " ".join(f"near{i}" for i in range(50))
    rows = [
        (1, "one short text"), (1, "one short text"), (None, "one  short text"), (2, None), (3, ""), (None, "only without an id"), (4, long), (5, near), (6, near + " end"), (5, "another text of id five"),
        (7, "you filthy idiot " * 30), (8, "write to some.body@example.org today"), (9, " \t"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, MARK string")
    labels = spark.createDataFrame([(1, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int")
    for name, d in (("some", docs), ("none", docs.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    kept = sorted({(r.doc_id is None, r.doc_id or 0) for r in out})
    assert kept == [(False, 1), (False, 2), (False, 4), (False, 5), (False, 8), (False, 9), (True, 0)]
    assert sum(r.doc_id == 5 and r.piece == 0 for r in out) == 2 and sum(r.doc_id == 1 for r in out) == 1
    fill = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048
    pieces = {}
    for r in sorted(out, key=lambda r: (str(r.doc_id), r.start)):
        if r.doc_id == 4:
            assert r.start == pieces.get(4, 0)
            pieces[4] = r.start + r.length
    assert pieces[4] > 6000
