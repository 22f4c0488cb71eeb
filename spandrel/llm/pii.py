"""Personal data: pattern spans, and terms that give protected entities away, with DataFrame functions only.

Base spans are emails, IPv4 addresses, payment cards (Luhn) and phone numbers. Around them the corpus decides: for every
entity e (the matched text) and every word t, however short and wherever it stands, of a document that mentions e,
pointwise mutual information ``PMI(e;t) = log2(n_et * N / (n_e * n_t))`` over documents is set against the information of
the entity itself, ``IC(e) = log2(N / n_e)``. ``PMI / IC`` is the share of e that t discloses. Words over
``generalise_at`` are generalised to their shape (X for capitals, x for other letters), words over ``remove_at`` removed,
at every place in each document that mentions e. One document is enough to show a pair; ``support`` asks for more.

Entities that are mentioned by the same documents share all their counts, so they count as one, told apart by a checksum of
their documents: a list of thousands of addresses pairs its words once, not once per address. Counting n_t needs words of
all documents, but only of words that stand beside some entity; their hashes modulo 1,048,576 make a table of a proven
bound that is broadcast to leave other words out before anything is shuffled, and again before pairs are joined back.
Words are compared by 64-bit hashes.

Defined cases: a null or empty text has no spans; repeated rows get equal spans each; documents without spans keep their
text; a null id is an id like any other; other columns may have any names. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, plain

KINDS = ("email", "ip", "card", "phone")
# The base patterns, with possessive repeats and a check that a run is tried from its start only. Both
# leave the matches as they are (what follows a run decides, not where in the run one starts) and keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a valid match passes.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
SPAN = "array<struct<kind:string,b:int,e:int,v:string>>"
WORD = r"[\p{L}\p{M}\x00]++"
BUCKETS = 1 << 20


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, r"[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def located(text: Column, pattern: str, kind: str, valid=None, shift: Column | int = 0) -> Column:
    """All leftmost matches as SPAN: the pieces between the matches give the places."""
    match, gap = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        b = acc["at"] + F.length(x["g"])
        e = b + F.length(x["m"])
        span = F.array(F.struct(F.lit(kind).alias("kind"), (b + shift).cast("int").alias("b"), (e + shift).cast("int").alias("e"), x["m"].alias("v"))).cast(SPAN)
        found = F.concat(acc["found"], span)
        return F.struct(e.cast("int").alias("at"), (found if valid is None else F.when(valid(x["m"]), found).otherwise(acc["found"])).alias("found"))

    pairs = F.zip_with(match, F.slice(gap, 1, F.greatest(F.size(match), F.lit(0))), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])


def base_spans(text: Column) -> Column:
    none = F.array().cast(SPAN)
    return F.concat(*[F.coalesce(F.when(text.rlike(HINTS[k]), located(text, PATTERNS[k], k, lambda v, k=k: _valid(k, v))), none) for k in KINDS])


PUT = "array<struct<b:int,e:int,put:string>>"


def disjoint(spans: Column, put, late) -> Column:
    """Sorted spans (b, e, put); what a span has beyond the one that it begins in becomes a span of its own, with ``late(length)``."""
    one = lambda b, e, x: F.array(F.struct(b.alias("b"), e.alias("e"), x.alias("put"))).cast(PUT)
    none = F.array().cast(PUT)

    def step(acc: Column, s: Column) -> Column:
        rest = F.when(s["e"] > acc["at"], one(acc["at"], s["e"], late(s["e"] - acc["at"]))).otherwise(none)
        return F.struct(F.greatest(acc["at"], s["e"]).alias("at"), F.concat(acc["kept"], F.when(s["b"] >= acc["at"], one(s["b"], s["e"], s["put"])).otherwise(rest)).alias("kept"))

    placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["b"].alias("b"), s["e"].alias("e"), put(s).alias("put"))))
    return F.aggregate(placed, F.struct(F.lit(0).alias("at"), none.alias("kept")), step, lambda acc: acc["kept"])


def replaced(text: Column, spans: Column) -> Column:
    """The text with ``put`` in the place of each of the sorted, disjoint ``spans``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    part = lambda acc, n: F.substr(text, acc["at"] + 1, n)
    step = lambda acc, s: F.struct(s["e"].alias("at"), F.concat(acc["out"], F.array(part(acc, s["b"] - acc["at"]), s["put"])).alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), part(acc, F.length(text))))


def masked(text: Column, spans: Column) -> Column:
    """The text with a zero character in the place of each character of a span, and no others."""
    zeros = lambda n: F.repeat(F.lit("\0"), n)
    return replaced(text, disjoint(spans, lambda s: zeros(s["e"] - s["b"]), zeros))


def _words(text: Column) -> Column:
    """Hashes of the distinct lower-cased words of a text. A word is as long as letters and zero characters go, and none if it holds one of the latter."""
    words = F.array_distinct(F.split(text, r"[^\p{L}\p{M}\x00]++"))
    words = F.filter(words, lambda w: (w != "") & ~F.contains(w, F.lit("\0")))
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(F.lower(w))))


def _bucket(term: str) -> Column:
    return F.pmod(F.col(term), F.lit(BUCKETS)).cast("int").alias("bucket")


def profiles(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From documents (doc, entities): (doc, profile) and (profile, n_e). Entities of equal documents have one profile."""
    mentions = near.select("doc", F.explode("entities").alias("entity"))
    half = (1 << 31) - 1
    sums = [F.sum(F.shiftrightunsigned("doc", 33)).alias("s1"), F.sum(F.col("doc").bitwiseAND(F.lit(half))).alias("s2")]
    entities = checkpoint(mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), *sums).select("entity", "n_e", F.xxhash64("n_e", "s1", "s2").alias("profile")))
    return mentions.join(entities.select("entity", "profile"), "entity").select("doc", "profile").distinct(), entities.select("profile", "n_e").distinct()


def disclosing_pairs(docs: DataFrame, near: DataFrame, known: DataFrame, text: str, support: int = 1, generalise_at: float = 0.9, remove_at: float = 0.98) -> DataFrame:
    """(profile, term, share, action) of all pairs over the threshold.

    ``near``: a row per document with doc, ``words`` and its ``profiles``; ``known``: (profile, n_e).
    """
    total = docs.count()
    counted = lambda rows, name, n: rows.groupBy(name).agg(F.count(F.lit(1)).alias(n))
    pairs = near.select(F.explode("profiles").alias("profile"), "words").select("profile", F.explode("words").alias("term"))
    pairs = pairs.groupBy("profile", "term").agg(F.count(F.lit(1)).alias("n_et")).filter(F.col("n_et") >= support)
    pairs = pairs.join(known, "profile")
    info = F.log2(total / F.col("n_e"))
    share = lambda n: F.when(info > 0, F.log2(F.col("n_et") * total / (F.col("n_e") * F.col(n))) / info).otherwise(0.0)
    # A term is in no fewer documents than those that show it beside some entity: what fails with these fails for good.
    close = counted(near.select(F.explode("words").alias("term")), "term", "n_near")
    pairs = checkpoint(pairs.join(close, "term").filter(share("n_near") >= generalise_at).drop("n_near"))
    wanted = F.broadcast(pairs.select(_bucket("term")).distinct())  # BUCKETS rows at most
    everywhere = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "\0", " ")
    terms = docs.select(F.explode(_words(everywhere)).alias("term")).withColumn("bucket", _bucket("term")).join(wanted, "bucket", "left_semi")
    scored = pairs.join(counted(terms, "term", "n_t"), "term").withColumn("share", share("n_t")).filter(F.col("share") >= generalise_at)
    return scored.select("profile", "term", "share", F.when(F.col("share") >= remove_at, "remove").otherwise("generalise").alias("action"))


def term_spans(mask: Column, removed: Column, generalised: Column) -> Column:
    """(b, e, put) of each word of a masked text that is among the hashes of words to remove or to generalise."""
    term = lambda v: F.xxhash64(F.lower(v))
    found = located(mask, WORD, "term", lambda v: F.array_contains(removed, term(v)) | F.array_contains(generalised, term(v)))
    shape = lambda v: F.regexp_replace(F.regexp_replace(v, r"\p{Lu}", "X"), r"[^X]", "x")
    return F.transform(found, lambda w: F.struct(w["b"].alias("b"), w["e"].alias("e"), F.when(F.array_contains(removed, term(w["v"])), "").otherwise(shape(w["v"])).alias("put")))


def find_spans(docs: DataFrame, id_col: str, text_col: str, **thresholds) -> DataFrame:
    """For ``docs`` of plain names, a row per input row: id, hash (of the text), base (SPAN), terms (array of b, e, put)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("t")).withColumn("base", base_spans(F.col("t")))
    some = F.size("base") > 0
    rows = rows.withColumn("t", F.when(some, F.translate("t", "\0", " "))).withColumn("mask", F.when(some, masked(F.col("t"), F.col("base")))).drop("t")
    rows = checkpoint(rows.withColumn("doc", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("null")), "hash")))
    near = rows.filter(F.col("mask").isNotNull()).select("doc", F.array_distinct(F.transform("base", lambda s: F.xxhash64(F.lower(s["v"])))).alias("entities"), _words(F.col("mask")).alias("words"))
    near = checkpoint(near.filter(F.size("words") > 0))
    of, known = profiles(near)
    held = of.groupBy("doc").agg(F.collect_list("profile").alias("profiles"))  # the profiles of one document
    near = checkpoint(near.select("doc", "words").join(held, "doc"))
    found = checkpoint(disclosing_pairs(docs, near, known, text_col, **thresholds))
    wanted = F.broadcast(found.select(_bucket("term")).distinct())  # BUCKETS rows at most
    mentions = near.select("doc", "profiles", F.explode("words").alias("term")).withColumn("bucket", _bucket("term")).join(wanted, "bucket", "left_semi")
    hits = mentions.select("doc", F.explode("profiles").alias("profile"), "term").join(found, ["profile", "term"]).groupBy("doc", "term").agg(F.max("action").alias("action"))
    listed = lambda a: F.collect_list(F.when(F.col("action") == a, F.col("term"))).alias(a)
    hits = hits.groupBy("doc").agg(listed("remove"), listed("generalise"))
    terms = F.when(F.col("remove").isNotNull(), term_spans(F.col("mask"), F.col("remove"), F.col("generalise")))
    rows = rows.join(hits, "doc", "left")
    return rows.select("id", "hash", "base", F.coalesce(terms, F.array().cast(PUT)).alias("terms"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["b"], s["e"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Counts by kind, a digest of the base spans and all spans, the terms after the base kinds."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    terms = F.transform("terms", lambda s: F.struct(F.lit("term").alias("kind"), s["b"].alias("b"), s["e"].alias("e"), F.lit("").alias("v"))).cast(SPAN)
    return find_spans(*plain(docs, id_col, text_col), **options).select(
        F.col("id").alias(id_col), *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", terms)).alias("spans")
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with base spans replaced by their kind in angle brackets, disclosing terms generalised or removed, and ``length_col`` (if there is one) counted anew."""
    rows, i, t = plain(docs, id_col, text_col)
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("key")
    found = find_spans(rows, i, t, **options).filter((F.size("base") > 0) | (F.size("terms") > 0))
    found = found.select(key("id"), "hash", "base", "terms").dropDuplicates(["key", "hash"])
    own = rows.withColumns({"key": key(i), "hash": F.xxhash64(F.coalesce(F.col(t).cast("string"), F.lit("")))}).join(found, ["key", "hash"], "left")
    names = F.transform("base", lambda s: F.struct(s["b"].alias("b"), s["e"].alias("e"), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("put"))).cast(PUT)
    spans = disjoint(F.concat(names, F.col("terms")), lambda s: s["put"], lambda n: F.lit(""))
    own = own.withColumn("new", F.when(F.col("base").isNotNull(), replaced(F.col(t).cast("string"), spans)).otherwise(F.col(t)))
    out = {t: F.col("new")}
    if length_col in docs.columns:
        out[f"c{docs.columns.index(length_col)}"] = F.length("new").cast("long")
    return own.withColumns(out).select(*rows.columns).toDF(*docs.columns)
