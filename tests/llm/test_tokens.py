import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from spandrel.llm import bpe, packing, token_counts

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


ALPHABET = ["a", "e", "t", " ", "  ", "\n", "é", "ß", "日本", "😀", "1", "23", "'s", "'re", "!!", "==", "　", "\x1c", "\x85", "ing", "tion", "The", "_", "<|endoftext|>", "́", "Ⅷ", "한"]


def test_transducer_and_decoder(reference):
    e, d = bpe.machines(RANKS, P.PATTERN)
    r = random.Random(3)
    for _ in range(1500):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30)))
        ids = np.frombuffer(e.encode(text), "<u4")
        assert ids.tolist() == reference.encode_ordinary(text)
        assert "".join(bpe.decode(d, ids, chunk=r.choice([1, 2, 5, 100]))) == text
    tokens = sorted(e.machine.bytes_of)
    for _ in range(5000):
        a, b = r.choice(tokens), r.choice(tokens)
        assert e.machine._neighbours(a, b) == (e.machine._merge(e.machine.bytes_of[a] + e.machine.bytes_of[b])[0] == [a, b])


def test_transducer_starts_afresh_when_full(reference):
    t = bpe.Transducer(bpe.load_ranks(RANKS), limit=50)
    for text in ("internationalisation" * 40, "abcdefghij" * 60):
        assert t.encode(text.encode()) == reference.encode_ordinary(text)


def test_decoder_replaces_what_is_no_utf8():
    d = bpe.StreamDecoder({i: bytes([i]) for i in range(256)})
    assert d.feed(np.array([0x61, 0xE3, 0x81])) == "a" and d.feed(np.array([0x82, 0x62])) == "あb"
    assert d.feed(np.array([0xFF, 0x62])) + d.finish() == "�b"
    assert d.feed(np.array([0xF0, 0x9F])) == "" and d.finish() == "�"


def test_round_trip_query(docs, nothing, reference):
    for r in bpe.round_trip(docs, RANKS, P.PATTERN).join(docs.select("doc_id", "text").groupBy("doc_id").agg({"text": "count"}), "doc_id").collect():
        assert r.n_tokens >= 0
    by_id = {}
    for r in docs.select("doc_id", "text").collect():
        by_id.setdefault(r.doc_id, []).append(r.text or "")
    for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect():
        hit = [t for t in by_id[r.doc_id] if hashlib.sha256(t.encode()).hexdigest() == r.decoded_sha256]
        ids = np.array(reference.encode_ordinary(hit[0]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    assert bpe.round_trip(nothing, RANKS, P.PATTERN).count() == 0


def test_edit_aware_counts(reference):
    known = token_counts.piece_counts(RANKS, P.PATTERN)
    r = random.Random(2)
    parts = ["a", "the ", " ing", "\n", "  ", "   ", " ", "1", "23", "!", "'s", "é", "日", "word", " Word"]
    for k in range(400):
        text = "".join(r.choice(parts) for _ in range(r.choice([0, 1, 5, 40, 400, 3000 if k % 40 == 0 else 20])))
        d = token_counts.Document(text, known.split, known.__getitem__)
        for _ in range(r.randint(1, 6)):
            a = r.randint(-2, len(d.text) + 3)
            d.edit(a, a + r.choice([0, 0, 1, 5, 60, 1000]), "".join(r.choice(parts) for _ in range(r.choice([0, 0, 1, 3, 30, 500]))))
            assert d.tokens == len(reference.encode_ordinary(d.text)) and d.tree.total[0] == len(d.text)


def test_edits_touch_little(docs, nothing):
    known = token_counts.piece_counts(RANKS, P.PATTERN)
    d = token_counts.Document("some words of a text. " * 2000, known.split, known.__getitem__)
    before = d.encoded
    d.edit(20_000, 20_005, "other")
    assert d.encoded - before < 200
    rows = token_counts.count_with_edits(docs, RANKS, P.PATTERN).collect()
    assert len(rows) == docs.count() and all(r.n_tokens_edited > 0 for r in rows)
    assert token_counts.count_with_edits(nothing, RANKS, P.PATTERN).count() == 0


def optimal(items, cap):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= items[i]:
                rest = list(bins)
                rest[rest.index(room)] -= items[i]
                place(i + 1, rest)
        place(i + 1, [*bins, cap - items[i]])

    place(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    r = random.Random(1)
    for _ in range(300):
        cap = r.choice([10, 20, 30])
        items = [r.randint(1, cap) for _ in range(r.randint(1, 9))]
        counts = {x: items.count(x) for x in items}
        plan = packing.Plan(counts, cap)
        seen = {}
        for length, first, seq, n, each, offset in plan.placements:
            for q in range(n):
                seen.setdefault(seq + q, []).extend((offset + i * length, length) for i in range(each))
            assert first >= 0
        assert len(seen) == plan.sequences and sum(len(v) for v in seen.values()) == len(items)
        for v in seen.values():
            at = 0
            for o, n in sorted(v):
                assert o == at
                at += n
            assert at <= cap
        only = packing.Plan.__new__(packing.Plan)
        only.capacity, only.left, only.used, only.sequences, only.placements, only.reduced = cap, np.zeros(cap + 2, np.int64), np.zeros(cap + 2, np.int64), 0, [], 0
        for x, n in counts.items():
            only.left[x] += n
        only._reduce()
        rest = [int(x) for x in np.flatnonzero(only.left) for _ in range(int(only.left[x]))]
        assert only.reduced + (optimal(rest, cap) if rest else 0) == optimal(items, cap)


def test_ids_are_those_of_the_default_tokenizer():
    t, own = Tokenizer.from_file(JSON), packing.encoder(JSON, P.PATTERN)
    assert own.fast is not None
    r = random.Random(5)
    texts = ["<|endoftext|>", "a<|endoftext|>b", "<|endoftext|> x", "x <|endoftext|>", "  <|endoftext|>  <|endoftext|>\n\n<|endoftext", "<|endoftext|", ""]
    texts += ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(800)]
    for text, ids in zip(texts, own(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids
    assert 50256 in own(texts[1:2])[0]


def test_reduction_goes_on_below_the_longest():
    plan = packing.Plan({9: 1, 8: 1, 6: 3, 4: 3, 1: 4, 2: 3}, 10)  # three short ones fit beside no 9, but 6 + 4 fills a sequence
    assert plan.reduced >= 5 and plan.alone == 0
    assert packing.Plan({10: 7, 5: 1}, 10).alone == 7


def test_packing(docs, nothing):
    t = Tokenizer.from_file(JSON)
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(r.doc_id, s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n in packing.cut(len(ids), 64)]
    rows = packing.pack(docs, JSON, P.PATTERN, capacity=64, buckets=7).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(expected, key=key)
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 64
    assert packing.pack(nothing, JSON, P.PATTERN).count() == 0
