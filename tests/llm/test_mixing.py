"""The mix against plain loops: targets by resharing round after round, blocks and permutations one index at a time."""

import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from spandrel.llm import mixing

BLOCK, SHARD, SEED = 8, 32, 5


def hash64(*values):
    """Spark's xxhash64: the hash of a value is the seed of the next; ints are marked by a tuple."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def permuted(x, n, *key):
    for r in range(mixing.ROUNDS):
        other = ((hash64(*key, (r,)) % n) - x) % n
        if hash64(*key, (r,), max(x, other)) & 1:
            x = other
    return x


def reshared(sizes, weights=(3, 1, 2)):
    """Targets by the rule: share out, cut those above their cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    given, open_, rest = dict.fromkeys(names, Fraction(0)), set(names), Fraction(3 * sum(sizes.values()), 2)
    while open_ and rest:
        each = rest / sum(w[s] for s in open_)
        rest = Fraction(0)
        for s in list(open_):
            given[s] += each * w[s]
            if given[s] >= 2 * sizes[s]:
                rest += given[s] - 2 * sizes[s]
                given[s] = Fraction(2 * sizes[s])
                open_.discard(s)
    return names, given


def expected(rows, hashes):
    """{row number: taken} and the sources' targets."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for n, r in zip(size, rows, strict=True):
        sizes[r[2]] += n
    names, targets = reshared(sizes)
    taken = Counter()
    for sid, name in enumerate(names):
        own = sorted((h, r[0] is not None, r[0] or 0, d, k) for k, (r, (h, d)) in enumerate(zip(rows, hashes, strict=True)) if r[2] == name)
        words = [k for *_, k in own for _ in range(size[k])]
        n, quota = len(words), int(targets[name] + Fraction(1, 2))
        full, rank = n // BLOCK, 0
        while quota > 0:
            e, i = divmod(rank, -(-n // BLOCK))
            at = (i if i == full else permuted(i, full, (SEED,), sid, e)) * BLOCK
            got = words[at : at + BLOCK][:quota]
            taken.update(got)
            quota, rank = quota - len(got), rank + 1
    return size, sizes, targets, taken


@pytest.fixture(scope="module")
def rows(docs):
    names = [None, "a", "b", "a", "￿", "\U00010000", "a", "B", "a"]
    out = [(r["doc_id"], r["text"], names[k % len(names)]) for k, r in enumerate(docs.select("doc_id", "text").collect())]
    return [*out, *[(900 + k, "w " * 3, "a") for k in range(120)], (77, "same words here", "a"), (77, "same words here", "a"), (78, "", "only empty"), (79, "one", "tiny")]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, f"x{k}", k) for k, r in enumerate(rows)], "doc_id long, text string, source string, size string, sid long").repartition(5)


def test_taken_words_against_plain_loops(spark, rows, table):
    frame = spark.createDataFrame(rows, "d long, t string, s string").withColumn("h", F.sha2(F.coalesce("t", F.lit("")).cast("binary"), 256)).select(F.xxhash64(F.lit(SEED), "d", "h"), "h")
    hashes = [tuple(r) for r in frame.collect()]
    size, sizes, targets, taken = expected(rows, hashes)
    got = mixing.report(table, block=BLOCK, shard=SHARD, seed=SEED)
    found = Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got.collect())
    assert found == Counter((r[0], size[k], sizes[r[2]], round(float(targets[r[2]]), 6), taken[k]) for k, r in enumerate(rows))
    by_source = defaultdict(int)
    for k, r in enumerate(rows):
        assert taken[k] <= 2 * size[k]
        by_source[r[2]] += taken[k]
    assert all(abs(by_source[s] - targets[s]) <= 0.5 for s in sizes)


def test_slots_are_whole_and_counts_are_multinomial(spark, table):
    SHARD = 8  # many shards, so that the spread can be told
    m = mixing.mix(table, block=BLOCK, shard=SHARD, seed=SEED)
    slots = [(r["sid"], r["rank"], r["shard"]) for r in m.slots.collect()]
    want = {r["sid"]: r["slots"] for r in m.sources.collect()}
    assert sorted(s[:2] for s in slots) == [(sid, k) for sid in sorted(want) for k in range(want[sid])]
    per_shard = Counter(s for *_, s in slots)
    assert set(list(per_shard.values())[:-1]) <= {SHARD} and max(per_shard.values()) == SHARD and sum(per_shard.values()) == sum(want.values())
    counts, total = Counter((s[2], s[0]) for s in slots), sum(want.values())
    assert len(per_shard) > 80
    for sid, n in want.items():
        p, each = n / total, [counts[s, sid] for s in per_shard if per_shard[s] == SHARD]
        if n > 100:  # the variance is that of independent draws, not that of an even or a blockwise split
            mean = sum(each) / len(each)
            assert 0.5 < sum((x - mean) ** 2 for x in each) / len(each) / (SHARD * p * (1 - p)) < 1.7


def test_pass_is_a_permutation(spark):
    n = 1000
    got = spark.range(n).select("id", F.lit(n).cast("long").alias("n")).select(mixing.shuffled("id", "n", F.lit(3), F.lit(1).cast("long")).alias("x")).collect()
    places = [r["x"] for r in got]
    assert sorted(places) == list(range(n))
    assert sum(abs(a - b) == 1 for a, b in zip(places, places[1:], strict=False)) < 20  # neighbours part


def test_texts_are_the_documents_words(rows, table):
    m = mixing.mix(table, block=BLOCK, shard=SHARD, seed=SEED)
    words = defaultdict(list)
    for i, t, _ in rows:
        words[i].append(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    out = m.texts(table).collect()
    key = lambda r: (r["shard"], r["rank"], r["at"], r["doc_id"] is None, r["doc_id"] or 0, r["from"], r["length"])
    assert sorted(map(key, out)) == sorted(map(key, m.stream().collect()))
    for r in out:
        mine = r["text"].split(" ")
        assert len(mine) == r["length"] and any(w[r["from"] : r["from"] + r["length"]] == mine for w in words[r["doc_id"]])
    for slot in {(r["shard"], r["order"]) for r in out}:  # a slot's pieces lie side by side
        at = 0
        for r in sorted((r for r in out if (r["shard"], r["order"]) == slot), key=lambda r: r["at"]):
            assert r["at"] == at
            at += r["length"]
        assert 0 < at <= BLOCK


def test_many_sources_and_small_ranges(spark, table, monkeypatch):
    """The ways for tables too large to broadcast, and several range partitions, give the same."""
    plain = Counter(tuple(r) for r in mixing.report(table, block=BLOCK, shard=SHARD).collect())
    monkeypatch.setattr(mixing, "SMALL", 0)
    monkeypatch.setattr(mixing, "ROWS", 20)
    assert Counter(tuple(r) for r in mixing.report(table.repartition(2), block=BLOCK, shard=SHARD).collect()) == plain


def test_many_copies_are_counted_out(spark):
    rows = spark.range(1).select(F.lit(10_000).cast("long").alias("n"))
    assert [r["k"] for r in mixing.many(rows, "n", "k").orderBy("k").collect()] == list(range(10_000))
    assert mixing.many(rows.withColumn("n", F.lit(0).cast("long")), "n", "k").count() == 0


def test_nothing(nothing, spark):
    assert mixing.report(nothing).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.report(one).collect()] == [(1, 0, 0, 0.0, 0)]
