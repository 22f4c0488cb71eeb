"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding: compatibility forms, case, letters of other scripts that look like Latin ones, and digits or signs that stand for
letters. What is left of a text is its words between single spaces, so an entry is either a whole word (`` word ``) or a
stem (`` stem``, from the start of a word on). A word counts once, with its heaviest entry; words inside an exception
phrase do not count. The sum over the number of words is the rate, and ``score = 1 / (1 + 3/7 * (cut / rate)^2)``, so that
0.7 is reached at the learned cut and texts without a match score 0.

Learning: a seed list gives the general insults; the labelled rows that are not held out give stems and words. A bounded
sample of ``max_rows`` labelled rows (smallest hashes of the id), without near copies, is counted by document. An entry must be so much
commoner in toxic documents that chance among all candidates explains it with a probability of 0.01 at most. The cut
lies midway (geometrically) between the rates of toxic and of clean rows.

Defined cases: null and empty texts have no words and score 0; ids with several labels count as toxic if any says so,
of texts that repeat an id the least teaches; null labels teach nothing; other columns may have any names; without any usable label the seed list and a default cut remain; repeated rows are scored each.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, crc_mod, plain
from .shingles import U, mix, shingle_set

# Letters of other scripts by the Latin letters they look like, and digits or signs by what they stand for.
LOOKALIKES = {
    "a": "аαɑ", "b": "вβ", "c": "сϲ", "d": "ԁ", "e": "еεё", "g": "ɡ", "h": "һн", "i": "іιı", "j": "ј", "k": "кκ", "l": "ӏ", "m": "м", "n": "ηп",
    "o": "оοσ", "p": "рρ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υц", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e"}
# General insults, and phrases in which such a word is none.
SEEDS = ("bastard", "clown", "cretin", "degenerate", "disgusting", "dumb", "filth", "fool", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
EXCEPTIONS = ("class clown", "clown fish", "trash can", "trash bin", "trash talk show", "sore loser award", "fool proof", "dumb bell", "dumb waiter", "pond scum")

FOLD = str.maketrans({g: a for a, gs in LOOKALIKES.items() for g in gs} | SUBSTITUTES)
WORDS = re.compile(r"[^\W\d_]+")
STEM = range(4, 11)
#: Rates from which a text is toxic, where nothing was learned.
DEFAULT_CUT = 0.004


def fold(text: str | None) -> list[str]:
    """The words of a text after folding."""
    t = text or ""
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    return WORDS.findall(t.casefold().translate(FOLD))


def entries(word: str) -> list[str]:
    """What a word can be matched by: itself and its stems."""
    return [f" {word} ", *(f" {word[:n]}" for n in STEM if n <= len(word))]


@dataclass
class Lexicon:
    weights: dict[str, float]
    cut: float = DEFAULT_CUT
    exceptions: tuple[str, ...] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def _built(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for e, w in self.weights.items():
                a.add_word(e, (len(e), w))
            for phrase in self.exceptions:
                e = f" {' '.join(fold(phrase))} "
                a.add_word(e, (len(e), 0.0))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def rate(self, text: str | None) -> tuple[float, int, int]:
        """(weighted matches per word, matched words, words)."""
        words = fold(text)
        if not words or not self.weights:
            return 0.0, 0, len(words)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in self._built().iter(f" {' '.join(words)} "):
            start = end - n + 1
            if w == 0.0:
                spared.append((start, end))
            else:
                best[start] = max(best.get(start, 0.0), w)
        if spared:  # from left to right, how far exceptions that begin there or before reach
            starts, reach, far = [], [], -1
            for a, b in sorted(spared):
                far = max(far, b)
                starts.append(a)
                reach.append(far)
            best = {at: w for at, w in best.items() if not (i := bisect.bisect_right(starts, at)) or reach[i - 1] <= at}
        return sum(best.values()) / len(words), len(best), len(words)

    def score(self, rate: float) -> float:
        return 1 / (1 + 3 / 7 * (self.cut / rate) ** 2) if rate > 0 else 0.0


def _rates(docs: DataFrame, lexicon: Lexicon, columns: list[str], text: str) -> DataFrame:
    """(columns..., rate, hits, words) for docs of plain names."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1)
            rows = [lex.rate(t) for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]
            out = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out[0], pa.float64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], [*b.schema.names[:-1], "rate", "hits", "words"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, F.col(text).cast("string").alias("text")).mapInArrow(run, f"{kinds}, rate double, hits long, words long")


def _counted(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(entry, n): documents that hold each entry, of the wanted ones or of all."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            n: Counter[str] = Counter()
            for t in b.column(0).to_pylist():
                found = {e for w in set(fold(t)) for e in entries(w)}
                n.update(found if known is None else found & known)
            yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], ["entry", "n"])

    return rows.select("t").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def _without_copies(sample: DataFrame) -> DataFrame:
    """(t, y): one row of those of a bounded sample (id, t, y) that share any of three minhashes of their word triples, so that copies don't count as evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set((t or "").encode(), 3) for t in b.column(1).to_pylist()]
            least = [[int(mix(s, k).min() >> U(1)) if len(s) else 0 for s in sets] for k in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, pa.int64()) for x in least]], ["id", "t", "y", "h0", "h1", "h2"])

    kind = sample.schema["id"].dataType.simpleString()
    rows = checkpoint(sample.select("id", "t", "y").mapInArrow(run, f"id {kind}, t string, y int, h0 long, h1 long, h2 long"))
    left = rows.select(F.xxhash64("id").alias("h"), "h0", "h1", "h2").toArrow().to_pandas().sort_values("h")  # the sample's rows of 32 bytes
    for h in ("h0", "h1", "h2"):
        left = left.drop_duplicates(h)
    kept = rows.sparkSession.createDataFrame([(int(h),) for h in left["h"]], "h long")
    return checkpoint(rows.withColumn("h", F.xxhash64("id")).join(F.broadcast(kept), "h", "left_semi").select("t", "y"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, support: int = 3) -> Lexicon:
    """A lexicon from the labelled rows whose crc32 of the id, modulo 3, is not 1."""
    seeds = {f" {w}": 1.0 for w in SEEDS}
    labels, i, y = plain(labels, id_col, label_col)
    train = labels.filter(F.col(y).isNotNull() & F.col(i).isNotNull() & (crc_mod(i, 3) != 1))
    train = train.groupBy(F.col(i).alias("id")).agg(F.max(y).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    docs, i, t = plain(docs, id_col, text_col)
    sample = docs.select(F.col(i).alias("id"), F.col(t).cast("string").alias("t")).join(F.broadcast(train), "id")
    # Of rows that repeat an id the least text teaches, so the sample has max_rows rows at most whatever the documents.
    sample = _without_copies(sample.groupBy("id").agg(F.min("t").alias("t"), F.first("y").alias("y")))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon(seeds)
    counted = checkpoint(_counted(sample.filter("y = 1"), None).filter(F.col("n") >= support))
    prior, chance = n1 / (n1 + n0), math.log(max(1, counted.count()) / 0.01)
    # No entry of fewer toxic documents can be better than chance, so only these come to the driver.
    least = math.ceil(chance / -math.log(prior))
    pos = {r["entry"]: r["n"] for r in counted.filter((F.col("n") >= least) | F.col("entry").isin(list(seeds))).collect()}
    neg = {r["entry"]: r["n"] for r in _counted(sample.filter("y = 0"), set(pos) | set(seeds)).collect()}

    def gain(p: int, q: int) -> float:
        """How much better a share of its own explains p toxic and q clean documents, where it is far over the prior."""
        share = p / max(1, p + q)
        if p < support or share <= prior or p / n1 < 20 * q / n0:
            return 0.0
        return p * math.log(share / prior) + (q * math.log((1 - share) / (1 - prior)) if q else 0)

    # The best entry of a family first, the longest of equals; a shorter one must be worth it by what it adds.
    weights: dict[str, float] = {}
    ranked = sorted(((g, len(e), e) for e, p in pos.items() if (g := gain(p, neg.get(e, 0))) > chance), reverse=True)
    added: dict[str, list[str]] = {}
    for _, _, e in ranked:
        if any(e[:n] in weights for n in range(2, len(e))):
            continue
        longer = added.get(e, [])
        if gain(pos[e] - sum(pos[x] for x in longer), neg.get(e, 0) - sum(neg.get(x, 0) for x in longer)) > chance:
            weights[e] = round(min(2.0, math.log((pos[e] + 0.5) / n1 * n0 / (neg.get(e, 0) + 0.5)) / 5), 4)
            for n in range(2, len(e)):
                added.setdefault(e[:n], []).append(e)
    for e in seeds:
        if neg.get(e, 0) / n0 <= 0.2 * pos.get(e, 0) / n1 or not neg.get(e) and not pos.get(e):
            weights.setdefault(e, 1.0)
    lexicon = Lexicon(weights)
    rates = _rates(sample, lexicon, ["y"], "t").select("y", "rate").collect()  # max_rows at most
    toxic = sorted(r["rate"] for r in rates if r["y"] == 1 and r["rate"] > 0)
    clean = sorted(r["rate"] for r in rates if r["y"] == 0)
    if toxic:
        low, high = max(5e-4, clean[int(0.9995 * (len(clean) - 1))]), toxic[int(0.02 * len(toxic))]
        lexicon.cut = math.sqrt(low * high) if low < high else high
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, held_out, score, predicted, hits."""
    docs, i, t = plain(docs, id_col, text_col)
    value = F.when(F.col("rate") > 0, 1 / (1 + F.lit(3 / 7) * F.pow(lexicon.cut / F.col("rate"), 2))).otherwise(0.0)
    return _rates(docs, lexicon, [i], t).select(F.col(i).alias(id_col), (crc_mod(i, 3) == 1).alias("held_out"), value.alias("score"), (value >= 0.7).cast("int").alias("predicted"), "hits")


def keep_clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.7, with all their columns."""
    rows, t = plain(docs, text_col)
    return _rates(rows, lexicon, rows.columns, t).filter(F.col("rate") < lexicon.cut).select(*rows.columns).toDF(*docs.columns)
