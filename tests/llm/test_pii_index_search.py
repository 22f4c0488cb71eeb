import hashlib
import re

import pytest
from helpers import assert_same, duck

from spandrel.llm import maxscore, pii, queries, warc

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(map(int, reversed(digits))):
        total += c if i % 2 == 0 else 2 * c - 9 * (c > 4)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            v, digits = m.group(), re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans(spark, docs, nothing):
    more = [
        "a@b.c_d@e.f", "x@y.z@q.r 1.2.3.4.5.6.7.8 256.1.1.1 001.002.0003.4", "😀 é a.b@c.de 4111 1111 1111 1111, +1 (234) 567-8901.", "4111-1111-1111-1111 5500000000000004", "+" * 50 + "1" * 30,
        "1" * 20_000, "a" * 50_000, "1 " * 5000, "@a.b a@b a@.b.c a@b..c ----@-.-", "1." * 5000, "99999999999999999999.1.1.1",
    ]
    d = docs.select("doc_id", "text", "words").unionByName(spark.createDataFrame([(900 + i, t, "w") for i, t in enumerate(more)], "doc_id long, text string, words string"))
    texts = {(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()}
    digests = {}
    for i, t in texts:
        digests.setdefault(i, set()).add((hashlib.sha256(",".join(brute(t)).encode()).hexdigest(), sum(x[0] == "e" for x in brute(t))))
    rows = pii.report(d).collect()
    assert len(rows) == d.count() and all((r.base_sha256, r.n_email) in digests[r.doc_id] for r in rows)
    assert pii.report(nothing).count() == pii.sanitise(nothing).count() == 0
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()


def test_pii_disclosing_terms(spark):
    rows = [(i, f"filler w{i} text Zorblat Quimby writes to zq@mail.example.org today again number {i}") for i in range(5)]
    rows += [(100 + i, f"some writes to other{i}@x.org today again plain") for i in range(40)] + [(200 + i, f"plain text number without anything writes today again {i}") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(d).collect()}
    assert "email:40:59" in spans[0] and "term:15:22" in spans[0] and "term:23:29" in spans[0]
    assert spans[100] == "email:15:27" and spans[200] == ""
    text = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert "Zorblat" not in text[0] and "<EMAIL>" in text[0] and text[200] == rows[45][1] and "writes to <EMAIL> today" in text[100]


def test_top_k_against_sql(spark, data):
    assert_same(queries.op6_exact_top_k(spark, data), duck(maxscore.ORACLE))


def test_top_k_cases(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0]), (3, [float("nan")]), (4, None), (5, []), (7, [None, 1.0]), (50, [2.0, -1.0]), (100, [1.0, 2.0]), (1, [1.0, 2.0]), (8, [float("inf")]), (None, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for size in (1, 2, 100):
        got = [tuple(r) for r in maxscore.top_k(v, lambda i: i % 50 == 0, k=3, block_rows=size).filter("query_id = 0").orderBy("rank").collect()]
        assert got == [(0, 1, 1, 327680), (0, 2, 100, 327680), (0, 3, 50, 65536)]
    assert maxscore.top_k(v.limit(0), lambda i: i % 50 == 0).count() == 0


def test_maxscore_prunes_and_stays_exact():
    import numpy as np

    r = np.random.default_rng(0)
    x = np.floor(r.normal(size=(3000, 32)) * np.linspace(60, 1, 32))
    q = x[:20]
    b = maxscore.Block(np.arange(20), q, 5)
    at, size = 0, maxscore.FIRST_SHARD
    while at < 3000:
        b.add(np.arange(at, min(at + size, 3000)), x[at : at + size])
        at, size = at + size, size * 2
    for i in range(20):
        s = x @ q[i]
        s[i] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:5]
        assert b.best[i][0].tolist() == best.tolist()
    assert b.probed < 20 * 3000 * 2
    assert 0 < b.products < 0.7 * 20 * 3000 * 32


def test_no_ranges_no_archive(spark, data):
    """Where records cannot be read by ranges there is an error, not a result by another way."""
    with pytest.raises(ValueError, match="ranges"):
        warc.archive_and_read(spark.read.parquet(f"{data}/pages.parquet"), "viewfs://store/x")


def test_warc_against_sql(spark, data):
    assert_same(queries.op7_warc(spark, data), duck(warc.ORACLE))


def test_warc_cases_and_lookup(spark):
    rows = [
        (1, "http://A.com:80/x?y", "a" * 200), (2, "http://a.com/z b", "a" * 200), (2, "http://a.com/z b", "a" * 200), (None, None, "a" * 200), (5, "::bad[", "é" * 99), (6, "http://b.org", None),
        (7, "http://b.org", "short"), (8, "http://b.org", "short"), (None, "u", "q" * 100),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "0 as size")
    folder = warc.shared_folder(spark)
    warc.write_archives(pages, f"{folder}/archives", file_bytes=700)
    captures = warc.read_archives(spark, f"{folder}/archives")
    files = captures.groupBy("file").agg({"length": "sum", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in files) == len(rows) and len(files) > 1 and all(r["sum(length)"] <= 700 or r["count(1)"] == 1 for r in files)
    warc.write_index(captures, f"{folder}/index", lines=2)
    index = warc.CaptureIndex(spark, f"{folder}/archives", f"{folder}/index")
    found = index.lookup("http://B.org/")
    assert sorted(index.fetch(c)["payload"] for c in found) == [b"", b"short", b"short"]
    assert index.lookup("http://nowhere.example/") == [] and len(index.lookup(None)) == 1
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in captures.collect()}
    assert {(1, "response", None), (2, "revisit", 1), (None, "revisit", 1), (7, "response", None), (8, "response", None), (5, "response", None)} <= kinds
    some = spark.createDataFrame([("http://b.org",), ("http://b.org/",), ("http://nowhere.example/",)], "url string")
    assert sorted(r.page_id for r in warc.captures_of(some, f"{folder}/archives", f"{folder}/index").collect()) == [6, 7, 8]
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_warc_finds_every_url(spark, monkeypatch):
    """URLs with spaces, signs that sort around them, no-break spaces, controls and line ends, many captures of one, many blocks and directory passes."""
    import hashlib

    odd = ["/a b", "/a!b", "/a!c", "/a c", "/a%20b", "/a", "/a\u00a0b", "/a  b", "/a\tb", "/a\nb", "/a\u0085b", "/a\u2028b", "/\x00", "/é b", "/😀", "/ x ", "?q= 1", "/a#b c", ""]
    urls = [f"http://h.org{x}" for x in odd] + [None, "", " ", "no url", "http://[bad", "x\x1fy"] + ["http://h.org/hot"] * 9
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string").repartition(3)
    folder = warc.shared_folder(spark)
    warc.write_archives(pages, f"{folder}/archives")
    warc.write_index(warc.read_archives(spark, f"{folder}/archives"), f"{folder}/index", lines=4)
    index = warc.CaptureIndex(spark, f"{folder}/archives", f"{folder}/index")
    for i, u in enumerate(urls):
        assert i in {c["page_id"] for c in index.lookup(u)}
        assert all(warc.key_of(c["url"]) == warc.key_of(u) for c in index.lookup(u))
    assert len(index.lookup("http://h.org/hot")) == 9 and len(index.lookup("http://h.org/a!b")) == 1
    for most in (500_000, 3):
        monkeypatch.setattr(warc, "MOST_BLOCKS", most)
        got = warc.captures_of(pages.select("url"), f"{folder}/archives", f"{folder}/index").collect()
        assert sorted((r.page_id, r.payload_digest) for r in got) == [(i, hashlib.sha256(f"page {i}".encode()).hexdigest()) for i in range(len(urls))]


def test_members_end_with_zero():
    for data in (b"", b"x" * 10, bytes(range(256)) * 70_000):
        assert warc.member(data)[-1] == 0
        assert b"".join(c for _, _, c in warc.members(warc.member(data) * 2)) == data * 2


def test_pii_terms_anywhere_in_the_document(spark):
    """Terms far from the mention, pairs of a single document and short words, next to a plain count."""
    import math

    far = " plain words of no weight" * 20
    rows = [(i, f"Zorblat news{far} by zq@mail.example.org{far} signed Zorblat é") for i in range(5)]
    rows += [(10, f"Li Vexo wrote{far} to li@one.example.org today"), (11, f"äli@two.example.org{far} news of Quorn"), (12, "Zorblat\0alone")]
    rows += [(100 + i, f"news wrote today signed by to x{far}") for i in range(60)]
    docs = {i: (t, [m.span() for m in re.finditer(PLAIN["email"], t)]) for i, t in rows}
    words = {i: [m for m in re.finditer(r"[^\W\d_]+", t) if not any(m.start() < e and m.end() > b for b, e in s)] for i, (t, s) in docs.items()}
    entities = {i: {t[b:e].lower() for b, e in s} for i, (t, s) in docs.items()}
    every = {i: {w.lower() for w in re.findall(r"[^\W\d_]+", t)} for i, (t, _) in docs.items()}
    n_e = lambda e: sum(e in x for x in entities.values())

    def share(e, t):
        n_et = sum(e in entities[i] and t in {m.group().lower() for m in words[i]} for i in docs)
        return math.log2(n_et * len(docs) / (n_e(e) * sum(t in x for x in every.values()))) / math.log2(len(docs) / n_e(e))

    expected = {i: [f"email:{b}:{e}" for b, e in docs[i][1]] + [f"term:{m.start()}:{m.end()}" for m in words[i] if any(share(e, m.group().lower()) >= 0.9 for e in entities[i])] for i in docs}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.report(d).collect()} == {i: ",".join(x) for i, x in expected.items()}
    clean = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert not any("Zorblat" in clean[i] for i in range(5)) and "Li" not in clean[10] and "Vexo" not in clean[10] and "Quorn" not in clean[11]
    assert clean[12] == rows[7][1] and clean[100] == rows[8][1]


def test_pii_many_spans_in_one_text(spark):
    """Thousands of addresses and terms in one text, next to plain replacement; work is not per pair of them."""
    import time

    pii.report(spark.createDataFrame([(0, "a@b.cd")], "doc_id long, text string")).collect()
    many = " ".join(f"Näme{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} user{i}@host{i}.example" for i in range(4000))
    rows = [(0, many)] + [(i, f"plain words and more of number {i} user at host example") for i in range(1, 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    r = pii.report(d).filter("doc_id = 0").collect()[0]
    took = time.time() - began
    assert r.n_email == 4000 and r.spans.startswith(",".join(brute(many))) and r.spans.count("term:") == 4000
    text = pii.sanitise(d).filter("doc_id = 0").collect()[0].text
    assert text == " ".join(["", *["<EMAIL> "] * 4000])[:-1]
    assert took < 60, took


def test_pii_overlaps_and_shapes(spark):
    rows = [(1, "+1 (234) 4111 1111 1111 1111 end"), (2, "\0 a@b.cd\0"), (3, "Zoë Quorn a@x.yz"), (4, "Zoë a@x.yz"), (5, None)] + [(10 + i, f"some plain text {i}") for i in range(30)] + [(50, "zoë alone")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(d).collect()}
    assert [x for x in got[1].spans.split(",") if x[0] != "t"] == brute(rows[0][1])
    text = {r.doc_id: r.text for r in pii.sanitise(d, generalise_at=0.5, remove_at=1.1).collect()}
    assert text[1].startswith("<PHONE>") or text[1].startswith("+1 (234) <CARD>")
    assert not any(c.isdigit() for c in text[1].replace("+1 (234)", "")) and text[2] == "\0 <EMAIL>\0" and text[5] is None
    assert text[3] == "Xxx Xxxxx <EMAIL>" and text[4] == "Xxx <EMAIL>" and text[50] == "zoë alone"
