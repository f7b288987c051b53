"""Personal data: patterns propose spans, checksums confirm, context adjusts the score.

Every kind's pattern marks its matches in one pass, which splits the text into pieces;
match positions are running sums of the pieces' lengths. Addresses and phone numbers
are confirmed by their parts, cards by Luhn, bank accounts (IBAN) by mod 97. Kinds
without a checksum that the base does not know, such as plain phone numbers, start
below the limit and need a context word nearby.

An account number is proposed by its first four characters, wherever these stand, and
ends where its country's length is reached. In countries without a listed length every
end of a word is tried that is the first, the last or one of groups of four, the longest
that passes being taken.

All of it is SQL expressions in one narrow pass; a kind's pattern runs only on texts
with a character it needs. The patterns are written so that a failed match is not
tried again inside itself, with the same matches as the plain forms in ``PATTERNS``.

Defined cases: a null or empty text has no spans; a very long text is searched
whole, as one row; repeated rows each get their row; an empty table gives none. Columns that have an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewide.llm.batches import let, quoted

# What base spans of a kind match, leftmost and non-overlapping.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches, without retries inside a failed one.
_FAST = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": PATTERNS["phone"],
}
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
KINDS = tuple(PATTERNS)

#: Kinds the method adds: pattern, what a text must have, and score without context.
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
#: Whole words of capitals and digits, from an account number's first on.
_IBAN_WORDS = r"^[A-Z0-9]++(?![a-z])(?:\x20[A-Z0-9]++(?![a-z]))*+"
#: Characters of an account number by its country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Characters that hold any account number with its spaces and what follows it, and pieces that hold these.
_REACH, _PIECES = 70, 30
_LOCAL_PHONE = r"(?<![0-9A-Za-z+.()-])(?<!\+[0-9]{1,3}[\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])"
_SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
ADDED = ("iban", "local_phone", "ssn")
LIMIT = 0.5
_SCORES = {"iban": 0.9, "local_phone": 0.4, "ssn": 0.4}
# Words that make a proposal of the kind more likely when they stand near it.
CONTEXT = {
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "local_phone": r"(?i)\b(?:phone|tel|telephone|mobile|cell|call|fax|telefon|téléphone|teléfono)\b",
    "ssn": r"(?i)\b(?:ssn|social security|tax id)\b",
}
#: Characters of context on each side, and what a context word adds.
NEAR, CONTEXT_GAIN = 40, 0.3

OUTPUTS = tuple(f"n_{k}" for k in KINDS) + ("base_spans", "all_spans")
_SPAN = "array<struct<kind:string,first:bigint,end:bigint,rank:int,score:double>>"
_BLOCK = 128


def _running(lengths: Column) -> Column:
    """Running sums, in blocks, so that many pieces do not cost their square."""

    def append(a: Column, x: Column) -> Column:
        return F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("bigint")) + x))

    empty = F.array().cast("array<bigint>")

    def with_blocks(n: Column) -> Column:
        count = F.ceil(F.size(n) / F.lit(_BLOCK)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
                             lambda b: F.aggregate(F.slice(n, b * _BLOCK + 1, _BLOCK), empty, append))

        def shifted(inner: Column) -> Column:
            ends = F.aggregate(F.transform(inner, lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0).cast("bigint"))), empty, append)
            return let(ends, lambda e: F.flatten(F.transform(
                inner, lambda x, b: F.transform(x, lambda v: v + F.coalesce(F.get(e, b - 1), F.lit(0).cast("bigint"))))))

        return let(blocks, shifted)

    return let(lengths, with_blocks)


def _matches(text: Column, pattern: str, reach: int = 0) -> Column:
    """Matches with their start: array of (value, first). With ``reach``, ``value`` is so
    much of the text from the match's start on."""
    marked = F.regexp_replace(text, pattern, "\u0001$0\u0001")

    def located(pieces: Column) -> Column:
        ends = _running(F.transform(pieces, lambda p: F.length(p).cast("bigint")))
        numbers = F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2))
        near = F.transform(pieces, lambda p: F.substring(p, 1, reach)) if reach else pieces

        def value(parts: Column, k: Column) -> Column:
            return F.substring(F.array_join(F.slice(parts, k + 1, _PIECES), ""), 1, reach) if reach else F.get(parts, k)

        return F.when(F.size(pieces) < 2, F.array().cast("array<struct<value:string,first:bigint>>")).otherwise(
            let(ends, lambda e: let(near, lambda parts: F.transform(
                numbers, lambda k: F.struct(value(parts, k).alias("value"), F.get(e, k - 1).alias("first"))))))

    return let(F.split(marked, "\u0001", -1), located)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        double = F.when(n >= 5, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 1, double).otherwise(n)

    reverse = F.split(F.reverse(digits), "")
    total = F.aggregate(F.transform(F.filter(reverse, lambda d: d != ""), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces passes the mod 97 check."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _account(near: Column) -> Column:
    """The account number that a stretch of text begins with; null if there is none."""
    listed = F.create_map(*[F.lit(x) for n, names in _IBAN_LENGTHS.items() for name in names.split() for x in (name, n)])
    length = F.try_element_at(listed, F.substring(near, 1, 2))

    def plain(value: Column) -> Column:
        return F.replace(value, F.lit(" "), F.lit(""))

    def grouped(words: Column, k: Column) -> Column:
        fours = F.forall(F.slice(words, 1, k - 1), lambda w: F.length(w) == 4) & (F.length(F.get(words, k - 1)) <= 4)
        return (k == 1) | (k == F.size(words)) | fours

    def longest(words: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.struct(
            k.alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("value")))
        fits = F.filter(ends, lambda e: F.when(length.isNotNull(), F.length(plain(e["value"])) == length).otherwise(
            F.length(plain(e["value"])).between(15, 34) & grouped(words, e["k"])))
        return F.try_element_at(F.filter(fits, lambda e: mod97(plain(e["value"]))), F.lit(-1))["value"]

    return let(F.split(F.regexp_extract(near, _IBAN_WORDS, 0), " "), longest)


def _accounts(text: Column) -> Column:
    """Account numbers with their start."""
    found = F.transform(_matches(text, _IBAN, _REACH), lambda m: F.struct(_account(m["value"]).alias("value"), m["first"].alias("first")))
    return F.filter(found, lambda m: m["value"].isNotNull())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _small(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) < 3) | (F.length(plain) == 3) & (plain <= "255")


_CONFIRM: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _small),
    "card": lambda v: F.length(_digits(v)).between(12, 19) & luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "iban": lambda v: F.lit(True),
    "local_phone": lambda v: F.lit(True),
    "ssn": lambda v: ~F.substring(v, 1, 3).isin("000", "666") & (F.substring(v, 1, 1) != "9"),
}


def _spans(text: Column, kind: str, rank: int, pattern: str, needs: str, score: float, context: str | None) -> Column:
    found = _accounts(text) if kind == "iban" else _matches(text, pattern)
    confirmed = F.filter(found, lambda m: _CONFIRM[kind](m["value"]))

    def span(m: Column) -> Column:
        end = m["first"] + F.length(m["value"])
        near = F.lit(score)
        if context:
            left = F.greatest(m["first"] - NEAR, F.lit(0))
            around = F.concat_ws(" ", F.substring(text, left + 1, m["first"] - left), F.substring(text, end + 1, F.lit(NEAR)))
            near = near + F.when(around.rlike(context), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), m["first"].alias("first"), end.alias("end"), F.lit(rank).alias("rank"), near.alias("score"))

    spans = F.filter(F.transform(confirmed, span), lambda s: s["score"] >= LIMIT) if context else F.transform(confirmed, span)
    return F.when(text.rlike(needs), spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def find_pii(docs: DataFrame, *, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Documents with the number of base spans by kind, ``base_spans`` and
    ``all_spans``: arrays of kind, first, end (code points, exclusive), rank, score,
    by start and kind."""
    kept = [c for c in (docs.columns if carry is None else carry) if c not in OUTPUTS]
    # the mark that splits pieces is no character of any pattern
    t = F.translate(F.coalesce(quoted(text).cast("string"), F.lit("")), "\u0001", "\u0002")
    step = docs.select(F.struct(*[quoted(c) for c in kept]).alias("row"), t.alias("t"))
    x = F.col("t")
    found = {k: _spans(x, k, i, _FAST[k], _NEEDS[k], 1.0, None) for i, k in enumerate(KINDS)}
    added = {"iban": (_IBAN, r"[A-Z]{2}[0-9]{2}"), "local_phone": (_LOCAL_PHONE, "[0-9]{3}[.-][0-9]{4}"), "ssn": (_SSN, "[0-9]{3}-[0-9]{2}-[0-9]{4}")}
    more = [_spans(x, k, len(KINDS) + i, *added[k], _SCORES[k], CONTEXT[k]) for i, k in enumerate(ADDED)]
    step = step.select(
        "row", *[found[k].alias(k) for k in KINDS], F.concat(*more).alias("more"),
    )

    def ordered(spans: Column) -> Column:
        keyed = F.transform(spans, lambda s: F.struct(s["first"], s["rank"], s["end"], s["kind"], s["score"]))
        return F.transform(F.array_sort(keyed), lambda s: F.struct(
            s["kind"].alias("kind"), s["first"].alias("first"), s["end"].alias("end"), s["rank"].alias("rank"), s["score"].alias("score")))

    base = F.concat(*KINDS)
    return step.select(
        "row.*", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        ordered(base).alias("base_spans"), ordered(F.concat(base, "more")).alias("all_spans"),
    )


def joined(spans: Column) -> Column:
    """Spans as ``kind:first:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["end"].cast("string"))), ",")
