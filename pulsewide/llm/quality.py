"""Quality rules: base counts, and divergence from language references.

A document's characters fall into classes and its words into the language's common
words and the rest. Each histogram is held against its language's reference by the
Jensen-Shannon distance (base 2, so 0 to 1). Documents whose distance is above the limit
are rejected, if they are long enough for the histogram to say something. A reference is
the mean histogram of those documents of the language that lie nearest to its medians
(:func:`references`), so junk must be the larger half of a language to shift it. Languages
without a list of common words are not judged by words; a language with fewer than
``MIN_DOCS`` documents to make a reference of is judged by the base rule alone.

One pass over the texts makes all counts, in SQL expressions; references and verdicts
come from the counts, which are written once. References have one row a language.
A very long text is one row of words and window hashes, in memory together.

Defined cases: null and empty texts have no words, so the base rule rejects them; texts
of a null or empty language may be of any, so they are judged by the base rule alone;
repeated rows each get their row; an empty table gives none. Columns that have an
output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewide.llm.batches import let, quoted
from pulsewide.session import materialise

# Common words of a language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that for it with as was on be by this are from at".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par au sur pas ne".split(),
}
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Least characters and words for a judgement by classes and by common words.
MIN_CHARS, MIN_JUDGED_WORDS = 400, 50
#: Least documents that make a language's references.
MIN_DOCS = 20
#: Of the medians: their rank is off by less than one part in this many.
ACCURACY = 1000
N_CLASSES = 6
#: Limits of the distances: the first number plus the second over the root of the length.
CLASS_LIMIT, WORD_LIMIT = (0.14, 3.4), (0.24, 1.2)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUTPUTS = (*BASE, "base_failed", "class_distance", "word_distance", "kept")

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]++"


def repeat_words(words: Column) -> Column:
    """Words in windows that occur twice or more, by 64-bit hashes of the windows."""

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(ordered, lambda s: F.array_sort(F.filter(
            F.transform(s, lambda e, k: F.when(
                (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]), e["i"])),
            lambda i: i.isNotNull())))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0).cast("bigint"), lambda a, x: a + x))

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(covered(windows))

    def hashed(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("bigint")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(hashed(h), count))
    )


def _common(words: Column, lang: Column) -> Column:
    """Counts of the language's common words, then of all others; null without a list."""
    plain = F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(".,;:!?\"'()")))
    out = F.lit(None).cast("array<bigint>")
    for name, listed in COMMON_WORDS.items():
        known = F.lit(listed)
        bins = let(
            F.filter(plain, lambda w: F.array_contains(known, w)),  # noqa: B023 - used at once
            lambda found: F.concat(  # noqa: B023
                F.transform(known, lambda c: F.size(F.filter(found, lambda x: x == c)).cast("bigint")),  # noqa: B023
                F.array((F.size(words) - F.size(found)).cast("bigint")),
            ),
        )
        out = F.when(lang == name, bins).otherwise(out)
    return out


def counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", carry: Sequence[str] | None = None) -> DataFrame:
    """Base counts and histograms of every document."""
    kept = [c for c in (docs.columns if carry is None else carry) if c not in OUTPUTS]
    t = F.coalesce(quoted(text).cast("string"), F.lit(""))
    step = docs.select(
        F.struct(*[quoted(c) for c in kept]).alias("row"), t.alias("t"), quoted(lang).cast("string").alias("lang"),
        F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)).alias("words"),
        F.regexp_replace(t, _SPACE, "").alias("solid"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    step = step.withColumn("rest", F.regexp_replace("solid", "[a-z]+", ""))
    no_upper = F.regexp_replace("rest", "[A-Z]+", "")
    no_digit = F.regexp_replace(no_upper, "[0-9]+", "")
    no_mark = F.regexp_replace(no_digit, "[.,;:!?'\"()-]+", "")
    no_ascii = F.regexp_replace(no_mark, r"[\x00-\x7F]+", "")
    sizes = [F.length(x) for x in ("solid", "rest", no_upper, no_digit, no_mark, no_ascii)]
    classes = F.array(*[(a - b).cast("bigint") for a, b in zip(sizes, [*sizes[1:], F.lit(0)])])
    return step.select(
        "row",
        F.size("words").cast("bigint").alias("n_words"),
        F.length("solid").cast("bigint").alias("word_chars"),
        (F.length("rest") - F.length(F.regexp_replace("rest", "[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.nullif("lang", F.lit("")).alias("lang"),
        classes.alias("classes"),
        _common(F.col("words"), F.col("lang")).alias("common"),
    )


def _shares(bins: Column) -> Column:
    total = F.aggregate(bins, F.lit(0.0), lambda a, x: a + x)
    return let(total, lambda n: F.transform(bins, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares."""

    def half(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m) / 2).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def _middle(value: Column) -> Column:
    return F.percentile_approx(value, F.lit(0.5), F.lit(ACCURACY))


def _means(rows: DataFrame) -> DataFrame:
    n_common = len(next(iter(COMMON_WORDS.values()))) + 1
    return rows.groupBy("lang").agg(
        F.array(*[F.avg(F.col("c")[i]) for i in range(N_CLASSES)]).alias("mean_classes"),
        F.array(*[F.avg(F.get("w", F.lit(i))) for i in range(n_common)]).alias("mean_common"),
    )


def _nearer_half(rows: DataFrame, bins: str, centers: DataFrame, center: str) -> DataFrame:
    """The rows that are no farther from their language's center than its middle row; a
    language without a center for these bins keeps all."""
    far = F.when(F.col(center)[0].isNotNull() & F.col(bins).isNotNull(), js_distance(F.col(bins), F.col(center)))
    # one row a language
    held = rows.join(F.broadcast(centers.select("lang", center)), "lang").withColumn("far", far)
    cuts = materialise(held.groupBy("lang").agg(_middle(F.col("far")).alias("cut")))
    near = held.join(F.broadcast(cuts), "lang").where(F.coalesce(F.col("far") <= F.col("cut"), F.lit(True)))
    return near.select(*rows.columns)


def references(found: DataFrame) -> DataFrame:
    """Mean shares by language over documents that are surely of its kind; one row a language.

    The first center is the median of each class's share, which a minority of odd documents
    cannot move out of the range of the others. The half of the documents nearest to it
    gives mean shares of common words, and the half of these that is nearest in words gives
    the references. So less than half of a language's documents, however odd and alike,
    do not draw its reference to themselves.
    """
    long_enough = found.where((F.col("n_words") >= MIN_JUDGED_WORDS) & (F.col("word_chars") >= MIN_CHARS) & ~F.col("base_failed"))
    rows = long_enough.where("lang is not null").select("lang", _shares(F.col("classes")).alias("c"), _shares(F.col("common")).alias("w"))
    centers = rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.array(*[_middle(F.col("c")[i]) for i in range(N_CLASSES)]).alias("medians"))
    centers = materialise(centers.where(F.col("n_docs") >= MIN_DOCS).select("lang", _shares(F.col("medians")).alias("center")))
    near = _nearer_half(rows, "c", centers, "center")
    near = _nearer_half(near, "w", materialise(_means(near)), "mean_common")
    return _means(near)


def _judged(found: DataFrame, known: DataFrame) -> DataFrame:
    """Distances from the references; null where the text is too short to judge or has no reference."""
    found = found.join(F.broadcast(known), "lang", "left")

    def distance(bins: str, judged: Column) -> Column:
        reference = F.col(f"mean_{bins}")
        return F.when(judged & reference.isNotNull(), js_distance(_shares(F.col(bins)), reference))

    return found.withColumns({
        "class_distance": distance("classes", F.col("word_chars") >= MIN_CHARS),
        "word_distance": distance("common", (F.col("n_words") >= MIN_JUDGED_WORDS) & F.col("lang").isin(*COMMON_WORDS)),
    }).drop("mean_classes", "mean_common")


def _limit(limit: tuple[float, float], n: Column) -> Column:
    return F.lit(limit[0]) + F.lit(limit[1]) / F.sqrt(n.cast("double"))


def judge(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", carry: Sequence[str] | None = None
) -> DataFrame:
    """Documents with base counts, distances (null where not judged) and ``kept``."""
    found = materialise(counts(docs, text=text, lang=lang, carry=carry))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    found = found.withColumn("base_failed", base_failed)
    judged = _judged(found, materialise(references(found)))
    rejected = (
        F.col("base_failed")
        | F.coalesce(F.col("class_distance") > _limit(CLASS_LIMIT, F.col("word_chars")), F.lit(False))
        | F.coalesce(F.col("word_distance") > _limit(WORD_LIMIT, F.col("n_words")), F.lit(False))
    )
    return judged.withColumn("kept", ~rejected).select("row.*", *OUTPUTS)
