"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Entities are found by pattern. A term discloses an entity as far as seeing the term tells
that the entity is meant: with document frequencies from the whole corpus, the pointwise
mutual information of the pair over the entity's own information,

    log2(P(entity | term) / P(entity)) / -log2 P(entity),

which is 1 where the term never occurs without the entity near it. Terms at ``generalise``
or more are replaced by their kind, those at ``remove`` or more are dropped. A pair counts
only if it occurs in ``support`` different contexts, so that the words of one document and
its copies don't count as evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.session import settle

# The kinds in their order of precedence, and Java patterns of the same matches as the plain
# ones: email local@label(.label)+, ip number(.number){3}, card digits with single spaces or hyphens, phone +digits.
# Quantifiers are possessive where what follows can't match what they took, so nothing is tried again, and a run
# that failed is not tried from its middle; \G lets a match begin right behind the last one.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Words of letters, marks and digits, with hyphens and apostrophes between these; any length, any script.
_INNER, _JOINT = r"[\p{L}\p{M}\p{N}]", r"['\u2019\u2010-]"
WORD = f"{_INNER}++(?:{_JOINT}{_INNER}++)*+"
WORD_START, WORD_END = f"(?<!{_INNER})(?<!{_INNER}{_JOINT})", f"(?!{_JOINT}?{_INNER})"
#: What may belong to one word: where a context is cut or meets its entity, such a run may be part of a longer word.
EDGE = r"[\p{L}\p{M}\p{N}'\u2019\u2010-]+"
#: Code points of a context on either side of an entity.
REACH = 48
#: Matches of a text that are placed one after the other; longer lists are placed chunk by chunk.
CHUNK = 256

SPANS = "array<struct<start:int,kind_no:int,kind:string,end:int,value:string>>"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        # the digits' number decides first; only then is the sum taken
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _any_valid(kind: str, values: Column) -> Column:
    return F.exists(values, lambda v: _valid(kind, v))


def _valid_spans(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _whole_words(part: Column, at_end: Column, left: bool) -> Column:
    """The ``REACH`` code points of ``part`` beside an entity, without words that go on beyond them or touch an entity.

    ``at_end``: the text begins (``left``) or ends with ``part``. One more code point tells whether a word is cut.
    """
    near = (F.right if left else F.left)(part, F.lit(REACH + 1))
    cut = F.regexp_replace(near, f"^{EDGE}" if left else f"{EDGE}$", "")
    near = F.when(at_end & (F.char_length(near) <= REACH), near).otherwise(cut)
    return F.regexp_replace(near, f"{EDGE}$" if left else f"^{EDGE}", "")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once; an expression inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunk(items: Column, number: Column) -> Column:
    return F.slice(items, number * CHUNK + 1, F.lit(CHUNK))


def _running(items: Column, start: Column, total, merge, empty: Column, add) -> Column:
    """What ``add`` appends to ``empty`` along ``items``, one list for all, in time that is linear in their number.

    The state in front of each chunk comes from ``total`` of the chunks before, put together by ``merge`` from ``start`` on; only
    inside a chunk lists are appended to, each time as a whole. ``add`` takes and returns a struct of ``at`` and ``out``.
    """
    chunks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / CHUNK).cast("int"), F.lit(0)))

    def walked(totals: Column) -> Column:
        def of_chunk(_, c: Column) -> Column:
            before = F.aggregate(F.slice(totals, F.lit(1), c), start, merge)
            return F.aggregate(_chunk(items, c), F.struct(before.alias("at"), empty.alias("out")), add)["out"]

        return F.flatten(F.transform(totals, of_chunk))

    return _let(F.transform(chunks, lambda c: total(_chunk(items, c))), walked)


def _located(parts: Column, found: Column) -> Column:
    """Spans of the matches ``found`` that stand between ``parts``, with the text around each."""

    def steps(z: Column) -> Column:
        return F.transform(
            z["parts"],
            lambda p, i: F.struct(
                F.char_length(p).alias("gap"), F.get(z["found"], i).alias("value"),
                F.coalesce(F.char_length(F.get(z["found"], i)), F.lit(0)).alias("length"), _whole_words(p, i == 0, left=True).alias("left"),
                _whole_words(F.get(z["parts"], i + 1), i + 2 == F.size(z["parts"]), left=False).alias("right"),
            ),
        )

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["length"]
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    empty = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    size = lambda some: F.aggregate(some, F.lit(0), lambda a, x: a + x["gap"] + x["length"])
    walked = _let(
        _let(F.struct(parts.alias("parts"), found.alias("found")), steps),
        lambda s: _running(s, F.lit(0), size, lambda a, t: a + t, empty, add),
    )
    return F.filter(walked, lambda s: s["value"].isNotNull())


def _key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("hash"), F.octet_length(text).alias("bytes"))


def base_spans(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``(doc_id, row, key, base, contexts[, text])``: the pattern spans of each row and the text around them.

    ``base`` is ordered by start and kind; ``contexts`` has the entity and its surroundings. ``row`` is a number of the row,
    to be written before it is used, and ``key`` names the text. Null texts are empty. Time is linear in a text's matches.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    none = F.array().cast("array<string>")
    found = {}
    for k in KINDS:
        every = F.regexp_extract_all(F.col("text"), F.lit(PATTERNS[k]), F.lit(0))
        found[f"m_{k}"] = F.when(F.contains("text", F.lit(GUARDS[k])), every).otherwise(none) if GUARDS[k] else every
    df = df.withColumns(found)
    empty = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    located = {}
    for k in KINDS:
        m = F.col(f"m_{k}")
        located[f"s_{k}"] = F.when(_any_valid(k, m), _valid_spans(k, _located(F.split("text", PATTERNS[k], -1), m))).otherwise(empty)
    df = df.withColumns(located)

    def of_kind(i, k):
        return F.transform(
            F.col(f"s_{k}"),
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(i).alias("kind_no"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value")
            ),
        )

    def around(k):
        return F.transform(
            F.col(f"s_{k}"),
            lambda s: F.struct(F.concat(F.lit(f"{k}:"), F.lower(s["value"])).alias("entity"), s["left"].alias("left"), s["right"].alias("right")),
        )

    return df.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), _key(F.col("text")).alias("key"),
        F.array_sort(F.concat(*[of_kind(i, k) for i, k in enumerate(KINDS)])).alias("base"),
        F.concat(*[around(k) for k in KINDS]).alias("contexts"), *(["text"] if keep_text else []),
    )


def _words(text: Column) -> Column:
    # each word is lower-cased by itself: in a text, what follows can change a letter's form
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lower))


def disclosing_terms(
    docs: DataFrame, spans: DataFrame, support: int = 2, generalise: float = 0.9, remove: float = 0.98
) -> DataFrame:
    """``(term, disclosure, action)``: terms that tell some entity of ``spans`` by ``generalise`` or more.

    All counts are numbers of rows of ``docs``, over the whole corpus.
    """
    near = settle(
        spans.where(F.size("contexts") > 0).select("row", F.explode("contexts").alias("c")).select(
            F.col("c.entity").alias("entity"), "row",
            F.xxhash64("c.left", "c.right").alias("context"),
            _words(F.concat(F.col("c.left"), F.lit("\n \n"), F.col("c.right"))).alias("terms"),
        ),
        "entity-contexts",
    )
    pairs = near.select("entity", "row", "context", F.explode("terms").alias("term"))
    different = pairs.groupBy("entity", "term", "context").agg(F.lit(1).alias("one"))
    several = different.groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= support)
    # words of one or two characters stand near anything: one document is no evidence for them
    counts = (F.char_length("term") >= 3) | (F.col("both") >= support)
    together = pairs.select("entity", "term", "row").distinct().groupBy("entity", "term").agg(F.count("*").alias("both"))
    with_entity = near.select("entity", "row").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    near_any = pairs.select("term", "row").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    total = float(max(docs.count(), 1))

    def told(n_term: str) -> Column:
        p = F.col("n_entity") / F.lit(total)
        bits = F.log2(F.least(F.lit(1.0), F.col("both") / F.col(n_term)) / p)
        return F.when(p < 1, bits / -F.log2(p)).otherwise(0.0)

    # A term is in as many rows at least as it is near entities; what that rules out needs no count of the corpus.
    counted = several.join(together, ["entity", "term"]).where(counts).join(with_entity, "entity").join(near_any, "term")
    candidates = settle(counted.where(told("n_near") >= generalise), "disclosure-candidates")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wanted = settle(candidates.select("term").distinct(), "disclosure-terms")
    with_term = docs.select(F.explode(_words(text)).alias("term")).join(wanted, "term").groupBy("term").agg(F.count("*").alias("n_term"))
    scored = candidates.join(with_term, "term").select("term", told("n_term").alias("disclosure"))
    return (
        scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= generalise)
        .withColumn("action", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise"))
    )


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(key, found)``: where the ``terms`` stand, one row for each text that has any."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"))
    hits = texts.select(_key(F.col("text")).alias("key"), F.explode(_words(F.col("text"))).alias("term")).join(terms.select("term", "action"), "term")
    # a text has as many distinct terms at most as it has words
    by_text = settle(
        hits.distinct().groupBy("key").agg(
            F.concat(F.lit(f"(?iu){WORD_START}(?:"), F.array_join(F.sort_array(F.collect_set("term")), "|"), F.lit(f"){WORD_END}")).alias("pattern"),
            F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("actions"),
        ),
        "terms-of-texts",
    )
    # copies of a text are one before it is searched
    named = texts.withColumn("key", _key(F.col("text"))).join(by_text, "key").groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("text", "pattern", "actions")]
    )
    found = named.withColumn("m", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))
    spans = F.transform(
        _located(F.split("text", F.col("pattern"), -1), F.col("m")),
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(len(KINDS)).alias("kind_no"),
            F.when(F.get(F.map_values(F.map_filter("actions", lambda k, _: k == F.lower(s["value"]))), F.lit(0)) == "remove", "removed").otherwise("term").alias("kind"),
            s["end"].alias("end"), s["value"].alias("value"),
        ),
    )
    return found.select("key", spans.alias("found"))


def number_of(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets, or by nothing where the kind is ``removed``.

    Spans are ordered by start; one that begins inside another before it is part of that one.
    """

    def add(acc: Column, s: Column) -> Column:
        outside = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        label = F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        piece = F.when(outside, F.concat(gap, label)).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(acc["out"], piece).alias("out"))

    last = lambda some: F.aggregate(some, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
    pieces = _let(spans, lambda z: _running(z, F.lit(0), last, lambda a, t: F.greatest(a, t), F.array().cast("array<string>"), add))
    return F.concat(F.array_join(pieces, ""), F.substring(text, last(spans) + 1, F.char_length(text)))


def sanitise(
    docs: DataFrame, support: int = 2, generalise: float = 0.9, remove: float = 0.98, with_text: bool = False
) -> DataFrame:
    """``(doc_id, base, spans[, text])`` for each row of ``docs`` (doc_id, text).

    ``base`` are the pattern spans (start, kind_no, kind, end, value; code points, end exclusive), ``spans``
    these and the disclosing terms, of kind ``term`` or ``removed``. With ``with_text``, ``text`` is sanitised.
    Null texts are empty; repeated rows are kept; a corpus without entities has no disclosing terms.
    """
    base = settle(base_spans(docs, with_text), "personal-spans")
    terms = settle(disclosing_terms(docs, base, support, generalise, remove), "disclosing-terms")
    if terms.isEmpty():
        out = base.withColumn("found", F.array().cast(SPANS))
    else:
        out = base.join(settle(term_spans(docs, terms), "term-spans"), "key", "left")
    # what stands inside an entity goes with it
    apart = F.filter("found", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    spans = F.array_sort(F.concat("base", F.coalesce(apart, F.array().cast(SPANS))))
    out = out.withColumn("spans", spans)
    kept = ["doc_id", "base", "spans"]
    return out.select(*kept, redacted(F.col("text"), F.col("spans")).alias("text")) if with_text else out.select(*kept)
