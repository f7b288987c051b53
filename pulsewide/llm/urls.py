"""URL filter: rules first, then the ratio of two character language models.

A rule fits its host and all subdomains, if the path starts with the rule's; the longest
rule wins. All other URLs are judged by two smoothed Markov models of variable order
over 32 character symbols, one of accepted and one of rejected URLs. Rejected are
those with a term of ``REJECT_TERMS`` between other characters than letters, accepted
all others that no rule blocks.
A model uses the longest context, of 2 symbols at most, that it has seen ``MIN_CONTEXT``
times, mixed with the shorter ones by how often it was seen (Witten-Bell); so a few bad
URLs among the accepted teach that model nothing of their own. What a URL scores is the mean log-likelihood difference per symbol;
a URL is blocked if it scores below a limit: the score below which ``FALSE_BLOCKS`` of
the accepted URLs lie, or halfway from there to that of the rejected, if these lie lower.

Counts are taken over all URLs. They come to the driver as at most 2 x 32^3 numbers
(the models) and 2 x 4,001 (the scores of labelled URLs in bins), whatever the input.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no
rule and scores nothing: it is allowed; with no accepted or no rejected URLs every
URL without a rule is allowed; a very long URL is one row of as many contexts as it has
characters; repeated rows count each; an empty table gives none. Columns that have an
output's name are replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewide.llm.batches import let, quoted

# Rules as (verdict, host/path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

# Terms that label a URL as rejected when the models are fitted.
REJECT_TERMS = ("casino", "poker", "bets", "betting", "pills", "viagra", "adult", "porn", "xxx", "escort", "payday", "spam", "ads")

FALSE_BLOCKS = 0.005
MIN_CONTEXT = 32
_SYMBOLS = 32
#: Scores are binned for the limit by hundredths, from -20 to 20.
_BINS, _RANGE = 100, 20.0

OUTPUTS = ("host", "path", "rule", "score", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]], value: int) -> Column:
    """The longest fitting rule's text (``value`` 1) or verdict (0); null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1])):
        r_host, _, r_path = rule[1].partition("/")
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith("/" + r_path)
        out = F.when(fits, F.lit(rule[value])).otherwise(out)
    return out


def symbols(host: Column, path: Column) -> Column:
    """Symbol numbers of a URL after two start symbols: letters, digit, marks, other."""
    plain = F.regexp_replace(F.translate(F.concat(host, path), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[0-9]", "0")
    known = F.regexp_replace(plain, "[^a-z0/.-]", "_")
    # the characters from ` to DEL stand for symbols 0 to 31
    marked = F.concat(F.lit("``"), F.translate(known, "0/.-_", "{|}~\x7f"))
    return F.transform(F.filter(F.split(marked, ""), lambda c: c != ""), lambda c: F.ascii(c) - 96)


def trigrams(numbers: Column) -> Column:
    """Each symbol with the two before it, as one number."""

    def made(n: Column) -> Column:
        return F.when(F.size(n) < 3, F.array().cast("array<int>")).otherwise(
            F.transform(F.sequence(F.lit(2), F.size(n) - 1), lambda i: (
                F.get(n, i - 2) * (_SYMBOLS * _SYMBOLS) + F.get(n, i - 1) * _SYMBOLS + F.get(n, i))))

    return let(numbers, made)


def _model(counts: dict[int, int]) -> list[float]:
    """log P(symbol | two before it) for every trigram."""
    zero, one, two = [0] * _SYMBOLS, defaultdict(lambda: [0] * _SYMBOLS), defaultdict(lambda: [0] * _SYMBOLS)
    for t, n in counts.items():
        context, c = divmod(t, _SYMBOLS)
        zero[c] += n
        one[context % _SYMBOLS][c] += n
        two[context][c] += n

    def mixed(seen: list[int], lower: list[float]) -> list[float]:
        total, kinds = sum(seen), sum(1 for x in seen if x)
        if total < MIN_CONTEXT:
            return lower
        return [(n + max(kinds, 1) * p) / (total + max(kinds, 1)) for n, p in zip(seen, lower)]

    order0 = mixed(zero, [1 / _SYMBOLS] * _SYMBOLS)
    order1 = [mixed(one[c], order0) if c in one else order0 for c in range(_SYMBOLS)]
    out: list[float] = []
    for context in range(_SYMBOLS * _SYMBOLS):
        lower = order1[context % _SYMBOLS]
        out.extend(math.log(p) for p in (mixed(two[context], lower) if context in two else lower))
    return out


def _below(bins: dict[int, int], share: float) -> float:
    """The score that at most a share of the binned scores lie below."""
    allowed, lost = share * sum(bins.values()), 0
    for b in sorted(bins):
        if lost + bins[b] > allowed:
            break
        lost += bins[b]
    return b / _BINS


def _limit(bins: dict[bool, dict[int, int]]) -> float:
    accepted, rejected = _below(bins[True], FALSE_BLOCKS), _below(bins[False], 1 - FALSE_BLOCKS)
    return (accepted + rejected) / 2 if rejected < accepted else accepted


def filter_urls(
    pages: DataFrame,
    *,
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    reject_terms: Sequence[str] = REJECT_TERMS,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Pages with ``host``, ``path``, ``rule``, the model's ``score`` (null without
    models or symbols) and ``verdict``."""
    host, path = host_and_path(quoted(url).cast("string"))
    kept = [c for c in (pages.columns if carry is None else carry) if c not in OUTPUTS]
    parsed = pages.select(F.struct(*[quoted(c) for c in kept]).alias("row"), host.alias("host"), path.alias("path"))
    ruled = parsed.withColumns({
        "rule": rule_of(F.col("host"), F.col("path"), rules, 1),
        "by_rule": rule_of(F.col("host"), F.col("path"), rules, 0),
        "grams": trigrams(symbols(F.col("host"), F.col("path"))),
    })
    terms = r"(?i)(?:^|[^a-z])(?:" + "|".join(reject_terms) + r")(?:[^a-z]|$)"
    bad = F.concat("host", "path").rlike(terms) if reject_terms else F.lit(False)
    label = F.when(F.size("grams") == 0, None).when(bad, F.lit(False)).when(F.coalesce(F.col("by_rule") != "block", F.lit(True)), F.lit(True))
    labelled = ruled.withColumn("accepted", label).where("accepted is not null")
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in labelled.select("accepted", F.explode("grams").alias("gram")).groupBy("accepted", "gram").count().collect():
        counts[r["accepted"]][r["gram"]] = r["count"]
    score = F.lit(None).cast("double")
    limit = 0.0
    if counts[True] and counts[False]:
        accepted, rejected = _model(counts[True]), _model(counts[False])
        table = F.split(F.lit(",".join(f"{a - b:.6f}" for a, b in zip(accepted, rejected))), ",").cast("array<double>")
        score = F.when(F.size("grams") > 0, F.aggregate("grams", F.lit(0.0), lambda s, t: s + F.get(table, t)) / F.size("grams"))
        bins: dict[bool, dict[int, int]] = {True: {}, False: {}}
        binned = labelled.select("accepted", F.floor(F.greatest(F.least(score, F.lit(_RANGE)), F.lit(-_RANGE)) * _BINS).alias("bin"))
        for r in binned.where("bin is not null").groupBy("accepted", "bin").count().collect():
            bins[r["accepted"]][r["bin"]] = r["count"]
        limit = _limit(bins)
    return ruled.withColumn("score", score).withColumn(
        "verdict", F.coalesce("by_rule", F.when(F.col("score") < limit, F.lit("block")).otherwise(F.lit("allow")))
    ).select("row.*", *OUTPUTS)
