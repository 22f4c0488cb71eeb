import numpy as np

from spandrel.llm import quality, toxicity
from spandrel.llm.common import crc_mod_py

DATA = "/root/testdata/sf0.1"


def accuracy(scored, labels, column, held):
    rows = scored.join(labels, "doc_id").filter(f"held_out = {held}").select("predicted", column).collect()
    return sum(r.predicted == r[column] for r in rows) / len(rows)


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    lexicon = toxicity.learn(docs, labels)
    scored = toxicity.score(docs, lexicon)
    assert accuracy(scored, labels, "toxic", True) > 0.97
    assert all(r.held_out == (crc_mod_py(r.doc_id, 3) == 1) for r in scored.limit(200).collect())
    assert scored.filter("score < 0 or score > 1 or (score >= 0.7) <> (predicted = 1)").count() == 0


def test_toxicity_folding_and_exceptions(spark, docs, nothing):
    lexicon = toxicity.Lexicon({" idiot ": 1.0, " trash ": 1.0, " scu": 1.0}, cut=0.01)
    assert lexicon.rate("You 1d10t, уоu ѕcumbag")[1] == 2
    assert lexicon.rate("put it in the trash can")[1] == 0 and lexicon.rate("it is trash")[1] == 1
    assert lexicon.rate(None) == (0.0, 0, 0) and lexicon.score(0.0) == 0.0
    assert abs(lexicon.score(0.01) - 0.7) < 1e-9
    assert toxicity.score(docs, lexicon).count() == docs.count() and toxicity.score(nothing, lexicon).count() == 0
    kept = toxicity.keep_clean(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_learning_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.learn(docs, none).cut == toxicity.DEFAULT_CUT
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1)], none.schema)
    assert toxicity.learn(docs, nulls).weights
    assert quality.score(docs, quality.learn(docs, nulls)).filter("score = 1.0").count() >= 0


def test_quality_held_out(spark, docs, nothing):
    table, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    forest = quality.learn(table, labels)
    assert accuracy(quality.score(table, forest), labels, "quality", True) > 0.97
    assert quality.score(docs, forest).count() == docs.count() and quality.score(nothing, forest).count() == 0


def test_flat_trees_equal_a_walk():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(400, 5)), r.integers(0, 2, 400)
    y = np.where(x[:, 1] > 0.3, 1, y).astype(float)
    f = quality.fit(x, y, trees=12, depth=3)

    def walk(row):
        total = f.base
        for t in range(len(f.feature)):
            i = 0
            for _ in range(f.depth):
                i = 2 * i + 1 + int(row[f.feature[t, i]] > f.threshold[t, i])
            total += f.value[t, i - 7]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(f.score(x[:50]), [walk(row) for row in x[:50]])
    assert ((f.score(x) > 0.5) == (y > 0.5)).mean() > max(y.mean(), 1 - y.mean())


def test_rates_against_a_plain_count():
    """Every word tried against every entry, exceptions against every place."""
    import random

    r = random.Random(4)
    weights = {" idiot ": 1.0, " scu": 0.5, " trash ": 0.7, " idio": 0.2, " ba": 0.1}
    lexicon = toxicity.Lexicon(weights, cut=0.1, exceptions=("trash can", "the trash can lid", "idiot trash"))
    vocabulary = ["idiot", "1d10t", "idiots", "scum", "trash", "can", "lid", "the", "bad", "banana", "Х", "word", "tr4sh"]
    for _ in range(1500):
        text = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 25)))
        words = toxicity.fold(text)
        spared = set()
        for phrase in lexicon.exceptions:
            p = toxicity.fold(phrase)
            for i in range(len(words)):
                if words[i : i + len(p)] == p:
                    spared |= set(range(i, i + len(p)))
        best = [max([w for e, w in weights.items() if f" {x} ".startswith(e)], default=0.0) for x in words]
        hit = [b for i, b in enumerate(best) if b and i not in spared]
        rate, hits, n = lexicon.rate(text)
        assert n == len(words) and hits == len(hit) and abs(rate - sum(hit) / max(1, n)) < 1e-9


def test_statistics_against_a_plain_count(texts):
    import math
    import re
    from collections import Counter

    for t in texts:
        got = dict(zip(quality.NAMES, quality.statistics(t.encode() if t is not None else None), strict=True))
        if not t:
            assert not any(got.values())
            continue
        b = t.encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", b.lower())
        lines = [x for x in b.split(b"\n") if x]
        pairs = Counter(zip(words, words[1:]))
        plain = {
            "chars": math.log1p(len(b)), "lower": sum(97 <= c < 123 for c in b) / len(b), "digit": sum(48 <= c < 58 for c in b) / len(b), "high": sum(c > 127 for c in b) / len(b), "words": math.log1p(len(words)) if words else 0.0,
            "distinct": len(set(words)) / len(words) if words else 0.0, "commonest": max(Counter(words).values()) / len(words) if words else 0.0, "lines": math.log1p(len(lines)),
            "distinct_lines": len(set(lines)) / max(1, len(lines)), "longest_line": max(map(len, lines), default=0), "entropy": -sum(n / len(b) * math.log2(n / len(b)) for n in Counter(b).values()),
        }
        if len(words) > 1:
            plain |= {"repeated_next": sum(x == y for x, y in zip(words, words[1:])) / (len(words) - 1), "distinct_pairs": len(pairs) / (len(words) - 1), "commonest_pair": max(pairs.values()) / (len(words) - 1)}
        for k, v in plain.items():
            assert abs(got[k] - v) < 1e-9, (k, t)


def test_learning_is_bounded_where_an_id_repeats(spark):
    """A labelled id that repeats many times teaches once."""
    rows = [(1, f"you idiot number {i}") for i in range(3000)] + [(i, f"plain words of number {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, 1, int(i == 1)) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    assert toxicity.learn(docs, labels, max_rows=50).weights and quality.learn(docs, labels, max_rows=50) is not None
