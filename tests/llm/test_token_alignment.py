"""Alignment against a walk token by token with the libraries' own encoders."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from spandrel.llm import token_alignment as ta

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
HOW = dict(a_path=A, pattern=P.PATTERN, b_path=B)
MORE = ["a <|endoftext|> b", "<s> </s> <unk> <0x41>", "▁ looks like a space", "two  spaces   three", "tab\tand\nline\r\n", "naïve façade 東京 😀", " leading", "trailing ", "é ﬁ ½", "\u0000nul", "x" * 3000, "1234567890 " * 300]


@pytest.fixture(scope="module")
def rows(texts):
    out = [(i, t) for i, t in enumerate([*texts, *MORE])]
    return [*out, out[14], out[14], (None, "null id here"), (3, "one id, another text")]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, chunk string, n long").repartition(3)


@pytest.fixture(scope="module")
def groups(rows):
    """The groups (A ids, B ids) of each row, walked token by token."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in printable} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in printable)}
    out = []
    for _, t in rows:
        found = []
        if t:
            xs = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(f" {t}", add_special_tokens=False).ids]
            ys = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
            if b"".join(x for _, x in xs) == f" {t}".encode() == b"".join(y for _, y in ys):
                p = q = i = j = 0
                ga, gb = [], []
                while i < len(xs) or j < len(ys):
                    if p <= q:
                        ga.append(xs[i][0])
                        p, i = p + len(xs[i][1]), i + 1
                    else:
                        gb.append(ys[j][0])
                        q, j = q + len(ys[j][1]), j + 1
                    if p == q:
                        found.append((ga, gb))
                        ga, gb = [], []
        out.append(found)
    return out


def told(rows, groups, pairs_of):
    counts = Counter(p for g in groups for p in pairs_of(g))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = Counter()
    for (i, _), g in zip(rows, groups, strict=True):
        pairs = pairs_of(g)
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out[i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(line.encode()).hexdigest() if g else ""] += 1
    return out, {(a, b, n, n == most[b]) for (a, b), n in counts.items()}


@pytest.mark.parametrize("chunk_links", [50, 1 << 22])
def test_query_against_a_walk(rows, groups, table, chunk_links):
    documents, pairs = ta.align(table, **HOW, chunk_links=chunk_links)
    want, want_pairs = told(rows, groups, lambda g: [(x[-1], y[-1]) for x, y in g])
    assert Counter(tuple(r) for r in documents.collect()) == want
    assert {tuple(r) for r in pairs.collect()} == want_pairs
    assert any(len(x) > 1 and len(y) > 1 for g in groups for x, y in g) and any(not g and t for g, (_, t) in zip(groups, rows, strict=True))


def test_products_of_groups(rows, groups, table, monkeypatch):
    monkeypatch.setattr(ta, "BROADCAST_IDS", 0)
    monkeypatch.setattr(ta, "STRETCH", 200)
    documents, pairs = ta.align(table, **HOW, link="group", chunk_links=300)
    want, want_pairs = told(rows, groups, lambda g: [(a, b) for x, y in g for a in x for b in y])
    assert Counter(tuple(r) for r in documents.collect()) == want
    assert {tuple(r) for r in pairs.collect()} == want_pairs


def test_overlaps(rows):
    """Each elementary interval is one overlap."""
    a, b = ta.sides(A, P.PATTERN, B)
    for _, t in rows:
        if t and len(t) < 1000:
            (x,), (y,), data = a.encode([t]), b.encode([t]), f" {t}".encode()
            if a.spells(x, data) and b.spells(y, data):
                ea, eb = a.width[x].cumsum(), b.width[y].cumsum()
                i, j, _ = ta.Alignment(ea, eb).links("overlap")
                want = [(k, m) for k in range(len(x)) for m in range(len(y)) if max(ea[k] - a.width[x[k]], eb[m] - b.width[y[m]]) < min(ea[k], eb[m])]
                assert list(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_nothing(nothing):
    documents, pairs = ta.align(nothing, **HOW)
    assert documents.collect() == [] and pairs.collect() == []


def test_only_rows_without_tokens(spark):
    table = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert Counter(tuple(r) for r in ta.report(table, **HOW).collect()) == Counter({(1, 0, 0, 0, 0, 0, 0, ""): 1, (2, 0, 0, 0, 0, 0, 0, ""): 2})
