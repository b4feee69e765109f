"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are identifiers that their form alone proves: e-mail addresses, IP addresses, card and phone numbers,
and opaque keys behind ``=`` or ``:``. What stands before a seed is a lexical pattern: the word, the word
with its ``=`` or ``:``, and the last two words. Patterns with enough seeds are counted over the whole
corpus; those that introduce seeds often enough stay, and whatever follows one of them is an instance. On the
graph of patterns and instances confidence is scored in turns: a pattern's from its instances, an instance's
from its patterns. Opaque keys are identifiers whatever their pattern is worth, and so are instances that confident
patterns vouch for; both are of kind ``id`` (a key that holds a base match is not seen as one). An instance that occurs more often elsewhere than behind a pattern is
an ordinary word there: it counts against the pattern, which does not vouch for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, materialize

#: Turns of scoring, the least confidence of a found identifier, the fewest distinct seeds behind a pattern, and
#: the least share of a pattern's occurrences in the corpus that introduce a seed.
TURNS, CONFIDENT, SUPPORT, SHARE = 3, 0.9, 3, 0.1
#: What an instance of which nothing is known takes from a pattern's trust, where an ordinary word takes 1: with a digit, and without.
UNKNOWN_DIGIT, UNKNOWN_WORD = 0.05, 0.5
#: Prefix sums are formed in runs of this length, so that their cost stays near linear.
RUN = 256


@dataclass(frozen=True)
class Kind:
    """A kind of identifier. ``pattern`` finds the same matches as the plain form in the contract, in linear time:
    a match can begin only where a run of its first characters begins or the match before it ends."""

    name: str
    guard: Callable[[Column], Column]
    pattern: str
    valid: Callable[[Column], Column]


def _ip(m: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | (F.length(bare) == 3) & (bare <= "255")

    return F.forall(F.split(m, r"\."), small)


def _card(m: Column) -> Column:
    digits = F.translate(m, " -", "")

    def luhn(d: Column) -> Column:
        n = F.length(d)

        def worth(i: Column) -> Column:
            x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
            twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return F.when(i % 2 == 0, twice).otherwise(x)

        return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, b: a + b) % 10 == 0

    return let(digits, lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))


def _phone(m: Column) -> Column:
    return F.length(F.translate(m, "+ ().-", "")).between(10, 15)


#: In the order in which spans that begin together are listed.
KINDS = (
    Kind("email", lambda t: t.contains("@"), r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True)),
    Kind("ip", lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip),
    Kind("card", lambda t: t.rlike(r"[0-9][ -]?[0-9]"), r"[0-9](?:[ -]?[0-9])++", _card),
    Kind("phone", lambda t: t.contains("+"), r"\+[0-9][ ().0-9-]+[0-9]", _phone),
)
#: What the method itself finds.
FOUND = "id"
NAMES = (*(k.name for k in KINDS), FOUND)
SPAN = "array<struct<start:bigint,kind:int,end:bigint,text:string>>"
PLACE = "array<struct<start:bigint,kind:int,end:bigint>>"
#: Quotes and brackets part tokens as white space does; runs of = and : are tokens of their own. A seed is masked
#: as one token: MARK, its hash, MARK where only order matters; MARK and as many FILL as keep places where they do.
MARK, FILL = "\x01", "\x02"
PLAIN = r"[^\x20\x09-\x0D=:\x01\x02\"'()\[\]<>{}|`]++"
HASHED = rf"[=:]++|\x01[^\x01]*+\x01|{PLAIN}"
PLACED = rf"[=:]++|\x01\x02*+|{PLAIN}"
#: Opaque keys: 32 hex digits or more, or 20 characters or more with a digit and letters of both cases.
SECRET = r"^(?:(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+|(?=[^0-9]*+[0-9])(?=[^a-z]*+[a-z])(?=[^A-Z]*+[A-Z])[A-Za-z0-9+/_-]{20,}+)$"
MAYBE_SECRET = r"[=:][\x20\x09-\x0D\"'()\[\]<>{}|`]*+[A-Za-z0-9+/_-]{20}"


def running(values: Column) -> Column:
    """Inclusive prefix sums of an array of longs."""

    def sums(part: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("o"))
        return F.aggregate(part, zero, lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["o"], F.array(a["s"] + x)).alias("o")), lambda a: a["o"])

    def runs(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda j: sums(F.slice(v, j * RUN + 1, F.lit(RUN))))

    def joined(c: Column) -> Column:
        ends = sums(F.transform(c, lambda x: F.element_at(x, -1)))
        return let(ends, lambda e: F.flatten(F.transform(c, lambda x, i: F.transform(x, lambda y: y + F.when(i > 0, F.get(e, i - 1)).otherwise(F.lit(0))))))

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>")).when(F.size(v) <= RUN, sums(v)).otherwise(let(runs(v), joined)))


def _matches(text: Column, pattern: str, body: Callable[[Column, Column], Column]) -> Column:
    """``body(pieces, matches)``: the text cut at the pattern's matches, and these."""
    return let(F.split(text, pattern, -1), lambda p: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: body(p, m)))


def _spans(text: Column, pattern: str, kind: int, valid: Callable[[Column], Column]) -> Column:
    """Valid matches with place (code points, end exclusive)."""

    def body(p: Column, m: Column) -> Column:
        steps = F.zip_with(F.slice(p, F.lit(1), F.size(m)), m, lambda a, b: (F.length(a) + F.length(b)).cast("long"))

        def at(e: Column) -> Column:
            return F.transform(m, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("start"), F.lit(kind).alias("kind"), F.get(e, i).alias("end"), x.alias("text")))

        return F.filter(let(running(steps), at), lambda s: valid(s["text"]))

    return _matches(text, pattern, body)


def base_spans(text: Column) -> Column:
    """The seeds of a text (not null), of all kinds."""
    empty = F.array().cast(SPAN)
    return F.concat(*(F.when(k.guard(text), _spans(text, k.pattern, i, k.valid).cast(SPAN)).otherwise(empty) for i, k in enumerate(KINDS)))


def _masked(text: Column, kind: Kind, mask: Callable[[Column], Column]) -> Column:
    """``text`` with valid matches of ``kind`` replaced by ``mask(match)``."""

    def body(p: Column, m: Column) -> Column:
        new = F.concat(F.transform(m, lambda x: F.when(kind.valid(x), mask(x)).otherwise(x)), F.array(F.lit("")))
        return F.array_join(F.flatten(F.zip_with(p, new, lambda a, b: F.array(a, b))), "")

    return F.when(kind.guard(text), _matches(text, kind.pattern, body)).otherwise(text)


def _bare(text: Column, mask: Callable[[Column], Column], rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: the text with its seeds masked."""
    rows = rows.withColumn(name, F.when(text.contains(MARK) | text.contains(FILL), F.translate(text, MARK + FILL, "\x03\x03")).otherwise(text))
    for k in KINDS:
        rows = rows.withColumn(name, _masked(F.col(name), k, mask))
    return rows


def _joint(token: Column) -> Column:
    return token.startswith("=") | token.startswith(":")


def _word(token: Column) -> Column:
    """A word of a pattern: in lower case, digits alike, any seed like another."""
    low = F.lower(token)
    return F.when(token.startswith(MARK), MARK).when(token.rlike("[1-9]"), F.translate(low, "123456789", "000000000")).otherwise(low)


def _patterns(a: Column, b: Column) -> Column:
    """Patterns of the two words before an instance: one word (with = if it is a key), and two words."""
    key = F.when(a != "", F.concat(a, F.lit(" =")))
    return F.when(_joint(b), F.array(key)).when((a != "") & ~_joint(a), F.array(b, F.concat(a, F.lit(" "), b))).otherwise(F.array(F.when(b != "", b)))


#: What an instance sheds at its ends.
LEAD, TRAIL = r"^[^\p{L}\p{N}\x01]++", r"(?<![^\p{L}\p{N}\x01])[^\p{L}\p{N}\x01]++$"


def _instance(token: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(token, LEAD, ""), TRAIL, ""))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("row", F.xxhash64("key", "t"))


def _opaque(token: Column, before: Column) -> Column:
    """Is the token an opaque key?"""
    return F.when(_joint(before), F.regexp_replace(token, r"[^A-Za-z0-9]++$", "").rlike(SECRET)).otherwise(F.lit(False))


def contexts(texts: DataFrame, seeded: bool = False, placed: bool = False, only: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """One row per token and pattern before it: key, row, pattern, ``token``, ``seed``. With ``seeded``, only texts that may
    have a seed are cut into tokens. With ``only``, a condition on two words and the token after them, other tokens are dropped
    inside the text's row, before they become rows.

    With ``placed``, also what :func:`_end` tells a token's place from: its number ``i`` and the text's pieces ``p`` and
    tokens ``m``. These are the same arrays on all rows of a text, which cost nothing as long as most rows are dropped
    before they are written; and seeds have no text of their own then.
    """
    zero = F.array(F.lit(""), F.lit(""))
    if seeded:  # told by the text itself: a condition on the masked text would have it masked twice
        some = F.col("t").rlike(MAYBE_SECRET)
        for k in KINDS:
            some = some | k.guard(F.col("t"))
        texts = texts.where(some)
    keep = ["key", "row", *(["p", "m"] if placed else [])]
    if placed:
        rows = _bare(F.col("t"), lambda x: F.concat(F.lit(MARK), F.repeat(F.lit(FILL), F.length(x) - 1)), texts, "bare")
        rows = rows.withColumns({"p": F.split("bare", PLACED, -1), "m": F.regexp_extract_all("bare", F.lit(PLACED), F.lit(0))})
        rows = rows.select(*keep, F.concat(zero, "m").alias("w"))
    else:
        rows = _bare(F.col("t"), lambda x: F.concat(F.lit(MARK), F.hex(F.xxhash64(x)), F.lit(MARK)), texts, "bare")
        rows = rows.select(*keep, F.concat(zero, F.regexp_extract_all("bare", F.lit(HASHED), F.lit(0))).alias("w"))
    n = F.size("w") - 2
    zipped = F.arrays_zip(*(F.slice("w", F.lit(i), n) for i in (1, 2, 3)))
    if only is None:
        rows = rows.select(*keep, F.posexplode(zipped).alias("i", "x")).select(*keep, "x.*", "i").toDF(*keep, "a", "b", "token", "i")
    else:
        numbered = F.transform(zipped, lambda x, i: F.struct(x["0"].alias("a"), x["1"].alias("b"), x["2"].alias("token"), i.alias("i")))
        rows = rows.select(*keep, F.explode(F.filter(numbered, lambda x: only(x["a"], x["b"], x["token"]))).alias("x")).select(*keep, "x.*")
    rows = rows.where(~_joint(F.col("token")))
    seed = F.col("token").startswith(MARK) | _opaque(F.col("token"), F.col("b"))
    rows = rows.select(*keep, _word(F.col("a")).alias("a"), _word(F.col("b")).alias("b"), "token", "i", seed.alias("seed"))
    rows = rows.select(*keep, F.explode(_patterns(F.col("a"), F.col("b"))).alias("pattern"), "token", *(["i"] if placed else []), "seed")
    return rows.where("pattern is not null")


def _end(rows: DataFrame) -> DataFrame:
    """Rows of placed contexts with ``end``, where the token ends in the text, for the arrays that it is told from."""

    def total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + F.length(x))

    n = F.col("i") + 1
    return rows.withColumn("end", total(F.slice("p", F.lit(1), n)) + total(F.slice("m", F.lit(1), n))).drop("i", "p", "m")


#: Patterns and hits are joined by broadcast up to so many rows, counted first; beyond, by shuffle.
BROADCAST_ROWS = 50_000


def _few(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _few(df) else df


def score(edges: DataFrame, turns: int = TURNS) -> DataFrame:
    """Score the graph of ``edges`` (pattern, instance, seed, ordinary: distinct); returns ``instance`` and ``score`` of those a pattern vouches for.

    A pattern's trust is what speaks for it over one more than all that speaks: a seed for it with 1, an instance that was
    confident in the turn before with its score; an ordinary word against it with 1, and any other instance with a part of
    that. So a few odd instances cost little, and those that turn out well raise the trust of their other patterns. An
    instance's score is 1 less the product of its patterns' doubts, over patterns of one word or of two, whichever is
    more: they overlap and are not evidence twice. Every sum is formed in part before it is shuffled.
    """
    scores, two = None, F.col("pattern").contains(" ") & ~F.col("pattern").endswith(" =")
    unknown = F.when(F.col("instance").rlike("[0-9]"), UNKNOWN_DIGIT).otherwise(UNKNOWN_WORD)
    for _ in range(turns):
        known = edges if scores is None else edges.join(scores, "instance", "left")
        sure = F.lit(0.0) if scores is None else F.when(F.col("score") >= CONFIDENT, F.col("score")).otherwise(F.lit(0.0))
        good = F.when(F.col("seed"), F.lit(1.0)).otherwise(sure)
        bad = F.when(good > 0, 0.0).when(F.col("ordinary"), 1.0).otherwise(unknown)
        trust = known.groupBy("pattern").agg((F.sum(good) / (F.sum(good) + F.sum(bad) + 1)).alias("trust"))
        vouched = edges.where("seed or not ordinary").join(trust, "pattern")
        doubts = vouched.groupBy("instance", two.alias("two")).agg(F.sum(F.log(1 - F.col("trust"))).alias("doubt"))
        scores = materialize(doubts.groupBy("instance").agg((1 - F.exp(F.min("doubt"))).alias("score")))
    return scores


#: Texts are looked through for so many patterns or instances at most before they are cut into tokens, and tokens for so many;
#: with more of them, all are cut and joined.
SOUGHT, LISTED = 256, 5_000


#: Digits and marks are alike in patterns; and a sigma's form depends on what follows.
_FOLD = dict(zip(f"123456789\u03c2{MARK}{FILL}", "000000000\u03c3\x03\x03", strict=True))


def _says(text: Column, cases: list[list[str | Column]]) -> Column:
    """Does the text, in lower case, have all the words of any of ``cases``, perhaps inside others? It is folded only as far as they need."""
    cases = [[w.translate(str.maketrans(_FOLD)) if isinstance(w, str) else w for w in words] for words in cases]
    used = set("".join(w for words in cases for w in words if isinstance(w, str)))
    fold = {a: b for a, b in _FOLD.items() if b in used}

    def any_of(low: Column) -> Column:
        cond = F.lit(False)
        for words in cases:
            here = F.lit(True)
            for w in words:
                here = here & (low.contains(w) if isinstance(w, str) else w)
            cond = cond | here
        return cond

    return let(F.translate(F.lower(text), "".join(fold), "".join(fold.values())) if fold else F.lower(text), any_of)


def _parts(pattern: str) -> list[str]:
    return pattern.removesuffix(" =").split(" ")


def _mentions(texts: DataFrame, patterns: DataFrame, extra: Column | None = None) -> DataFrame:
    """Texts that may hold one of ``patterns``, by all its words, or that meet ``extra``: only those need to be cut into tokens."""
    some = patterns.limit(SOUGHT + 1).collect()
    if len(some) > SOUGHT:
        return texts
    seed, joint = F.lit(False), F.col("t").contains("=") | F.col("t").contains(":")
    for k in KINDS:
        seed = seed | k.guard(F.col("t"))
    cases = [[*([joint] if p.endswith(" =") else []), *(seed if w == MARK else w for w in _parts(p))] for p in sorted(r["pattern"] for r in some)]
    return texts.where(_says(F.col("t"), cases) if extra is None else extra | _says(F.col("t"), cases))


def _behind(patterns: DataFrame, opaque: bool = False) -> Callable[[Column, Column, Column], Column] | None:
    """For :func:`contexts`: tokens behind the last word of one of ``patterns``, and with ``opaque`` all opaque keys. None where there are too many patterns to list."""
    found = [r["pattern"] for r in patterns.limit(LISTED + 1).collect()]
    if len(found) > LISTED:
        return None
    keys, words = (sorted({_parts(p)[-1] for p in found if p.endswith(" =") == key}) for key in (True, False))

    def among(word: Column, listed: list[str]) -> Column:
        return F.when(word.startswith(MARK), F.lit(MARK in listed)).otherwise(F.translate(F.lower(word), "123456789", "000000000").isin(listed) if listed else F.lit(False))

    def only(a: Column, b: Column, token: Column) -> Column:
        after = F.when(_joint(b), among(a, keys)).otherwise(among(b, words))
        return ~_joint(token) & (after | _opaque(token, b) if opaque else after)

    return only


#: What :func:`_instance` leaves of the words of a text: each from its first letter or digit to its last (behind one beyond
#: 16 bits, which TRAIL doesn't look back at whole, to the word's end).
CORE = rf"[\p{{L}}\p{{N}}](?:{PLAIN.removesuffix('++')}*[\p{{L}}\p{{N}}])?+(?:(?<=[\uDC00-\uDFFF]){PLAIN.removesuffix('++')}*+)?+"


def _elsewhere(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` (pattern, instance, seed, k) with ``ordinary``: the corpus has the instance more often elsewhere than behind the pattern.
    Where every instance is a seed, the texts aren't read for that; and words that aren't sought are dropped inside their text's row."""
    sought = materialize(edges.where("not seed").select("instance").distinct())
    listed = sorted(r["instance"] for r in sought.limit(LISTED + 1).collect())
    if not listed:
        return edges.withColumn("ordinary", F.lit(False))

    if len(listed) <= SOUGHT:
        texts = texts.where(_says(F.col("t"), [[w] for w in listed]))
    words = F.transform(F.regexp_extract_all("t", F.lit(CORE), F.lit(0)), lambda w: F.lower(w))
    counts = texts.select(F.explode(F.filter(words, lambda w: w.isin(listed)) if len(listed) <= LISTED else words).alias("instance"))
    if len(listed) > LISTED:
        counts = counts.join(_small(sought), "instance", "left_semi")
    counts = counts.groupBy("instance").agg(F.count("*").alias("c"))
    return edges.join(counts, "instance", "left").withColumn("ordinary", ~F.col("seed") & (F.coalesce("c", F.lit(0)) > 2 * F.col("k"))).drop("c")


def discover(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Identifiers beyond the base kinds: ``k``, ``r`` (a hash of key and text) and ``found``, an array of spans, for the
    rows that have any. Only texts that may hold a seed or a pattern are cut into tokens, and only what follows a pattern that
    introduces seeds, or is a seed itself, is shuffled."""
    texts = _texts(docs, key, text)
    seeds = materialize(contexts(texts, seeded=True).where("seed").select("pattern", _instance(F.col("token")).alias("instance")).distinct())
    supported = materialize(seeds.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("pattern"))
    # what speaks against a pattern in the texts that have seeds speaks against it in all: so common words go before all texts are counted
    near = contexts(texts, seeded=True).join(_small(supported), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("seed").alias("seeds"))
    supported = materialize(near.where(F.col("seeds") >= SHARE * F.col("n")).select("pattern"))
    counts = contexts(_mentions(texts, supported), only=_behind(supported)).join(_small(supported), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("seed").alias("seeds"))
    patterns = materialize(counts.where(F.col("seeds") >= SHARE * F.col("n")).select("pattern", F.lit(True).alias("kept")))
    after = contexts(_mentions(texts, patterns, F.col("t").rlike(MAYBE_SECRET)), placed=True, only=_behind(patterns, opaque=True)).where(~F.col("token").startswith(MARK))
    if _few(patterns):  # places are told after the join, for the few rows that stay
        after = _end(after.join(F.broadcast(patterns), "pattern", "left").where("kept or seed"))
    else:  # and before it where rows are shuffled, since the arrays would go along
        after = _end(after).join(patterns, "pattern", "left").where("kept or seed")
    lead = F.length("token") - F.length(F.regexp_replace("token", LEAD, ""))
    end = F.col("end") - F.length("token") + F.length(F.regexp_replace("token", TRAIL, ""))
    span = F.struct((F.col("end") - F.length("token") + lead).alias("start"), F.lit(len(KINDS)).alias("kind"), end.alias("end"))
    after = materialize(after.select("key", "row", "pattern", _instance(F.col("token")).alias("instance"), "seed", "kept", span.alias("s")).where("instance <> ''"))
    known = seeds.join(_small(patterns), "pattern", "left_semi").select("pattern", "instance", F.lit(True).alias("seed"), F.lit(0).alias("k"))
    edges = known.unionByName(after.where("kept").select("pattern", "instance", "seed", F.lit(1).alias("k"))).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.sum("k").alias("k"))
    good = score(materialize(_elsewhere(texts, materialize(edges)))).where(F.col("score") >= CONFIDENT).select("instance", F.lit(True).alias("good"))
    hits = after.join(good, "instance", "left").where("seed or good and kept")
    return hits.groupBy(F.col("key").alias("k"), F.col("row").alias("r")).agg(F.collect_set("s").alias("found"))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(n) for n in NAMES))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, counts per base kind, base_sha256, spans.

    A null text is empty and has no spans; a null key is a key like others; repeated rows give repeated
    results; texts of any length are read whole; an empty table gives no rows. Only key and text are read.
    """
    occ = materialize(_texts(docs, key, text).select("key", "row", F.transform(base_spans(F.col("t")), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base")))
    more = discover(docs, key, text)
    rows = occ.join(more, (F.col("row") == F.col("r")) & F.col("key").eqNullSafe(F.col("k")), "left")

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS)]
    every = F.concat("base", F.coalesce("found", F.array().cast(PLACE)))
    return rows.select(F.col("key").alias(key), *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(every).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every identifier in ``text`` replaced by its kind in brackets; other columns as they are.

    A null text stays null. Found identifiers are cut out by their place; between them, base kinds are replaced in
    turn where they are read.
    """
    columns, inner = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    names = dict(zip(columns, inner, strict=True))
    more = _small(materialize(discover(docs, key, text)))
    t, turns = F.col(names[text]), (KINDS[0], KINDS[3], KINDS[2], KINDS[1], KINDS[3])  # the longer forms first; a phone number may come free beside another kind
    rows = docs.toDF(*inner).withColumn("r0", F.xxhash64(F.col(names[key]), F.coalesce(t, F.lit(""))))
    rows = rows.join(more, (F.col("r0") == F.col("r")) & F.col(names[key]).eqNullSafe(F.col("k")), "left")

    def named(x: Column, kind: Kind) -> Column:
        return _masked(x, kind, lambda _: F.lit(f"[{kind.name.upper()}]"))

    def masked(piece: Column, kinds: tuple[Kind, ...] = turns) -> Column:
        return let(named(piece, kinds[0]), lambda x: masked(x, kinds[1:])) if kinds else piece

    def between(spans: Column) -> Column:
        """What lies before, between and after the spans."""
        starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
        ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(t).cast("long")))
        return F.zip_with(starts, ends, lambda a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int")))

    whole = t
    for k in turns:
        rows = rows.withColumn(f"{names[text]}_", named(whole, k))
        whole = F.col(f"{names[text]}_")
    cut = F.array_join(F.transform(let(F.array_sort("found"), between), lambda x: masked(x)), f"[{FOUND.upper()}]")
    return rows.withColumn(names[text], F.when(F.col("found").isNull(), whole).otherwise(cut)).select(*(F.col(i).alias(c) for c, i in names.items()))
