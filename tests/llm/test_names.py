"""Columns of the input that are named like columns of the operators, in any case, keep their values."""

from collections import Counter

import public_tokenizers as P
import pytest

from spandrel.llm import bpe, exact_dedup, jaccard_join, packing, pii, quality, token_counts, toxicity

NAMES = [
    "c0", "C1", "c2", "id", "ID", "Hash", "hash", "mark", "digest", "length", "check", "TEXT", "DOC_ID", "Doc_Id", "sig", "rate", "hits", "words", "base", "terms", "doc", "key", "new", "one", "row", "keep", "size",
    "run", "slice", "least", "bucket", "items", "t", "n", "__id", "__hash", "__base", "__mark", "__text", "__key", "__digest", "__length", "__check", "__terms", "a b", "x`y", "kept", "score",
]
TEXTS = ["one two three four five six seven", "one  two three four five six seven", "mail me at a@b.example now", None, "", "you idiot " * 40, "one two three four five six seven eight nine ten", "Zorblat +1 234 567 8901 x"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, "en", "s", len(t or ""), *[f"{n}-{i}" for n in NAMES]) for i, t in enumerate(TEXTS)]
    plain = spark.createDataFrame(rows, ", ".join(["a0 long, a1 string, a2 string, a3 string, a4 long", *[f"a{k + 5} string" for k in range(len(NAMES))]]))
    return plain.toDF("doc_id", "text", "lang", "source", "n_chars", *NAMES)


def others(df):
    return {r[0]: tuple(r[5:]) for r in df.collect()}


def test_filters_keep_all_columns(clashing):
    expected = others(clashing)
    lexicon = toxicity.Lexicon({" idiot ": 1.0}, cut=0.1)
    for out, ids in (
        (toxicity.keep_clean(clashing, lexicon), {0, 1, 2, 3, 4, 6, 7}),
        (exact_dedup.keep_first(clashing), {0, 2, 3, 5, 6, 7}),
        (jaccard_join.keep_one(clashing, width=2, num=50), {0, 2, 3, 4, 5, 7}),
        (pii.sanitise(clashing), set(range(8))),
    ):
        assert out.columns == clashing.columns
        assert others(out) == {i: expected[i] for i in ids}
    texts = {r[0]: (r[1], r[4]) for r in pii.sanitise(clashing).collect()}
    assert "<EMAIL>" in texts[2][0] and texts[2][1] == len(texts[2][0]) and texts[3][0] is None


def test_reports_look_at_their_columns_only(clashing):
    ids = Counter(range(len(TEXTS)))
    lexicon = toxicity.Lexicon({" idiot ": 1.0}, cut=0.1)
    forest = quality.fit(*[__import__("numpy").zeros((0, len(quality.NAMES))), __import__("numpy").zeros(0)])
    ranks, json = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
    for out in (
        toxicity.score(clashing, lexicon), quality.score(clashing, forest), exact_dedup.exact_dedup(clashing), jaccard_join.near_components(clashing), pii.report(clashing),
        bpe.round_trip(clashing, ranks, P.PATTERN), token_counts.count_with_edits(clashing, ranks, P.PATTERN), packing.pack(clashing, json, P.PATTERN),
    ):
        assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == ids
