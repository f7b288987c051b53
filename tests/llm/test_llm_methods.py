"""The methods themselves: automaton, prefixes, filters, models, round trips."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from pulsewide.llm import batches, chat, html, jaccard, licenses, lines, mixing, pii, quality, urls
from pulsewide.llm.components import components

WORDS = st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=4), WORDS)
def test_matching_statistics(templates, text):
    machine = licenses.Automaton([], [("x", b" ".join(t).decode()) for t in templates])
    sub = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    longest = [max((k for k in range(1, e + 1) if tuple(text[e - k : e]) in sub), default=0) for e in range(1, len(text) + 1)]
    want = [(e, n) for e, n in enumerate(longest, 1) if n >= licenses.MIN_RUN and (e == len(text) or longest[e] != n + 1)]
    _, runs = machine.scan(text)
    assert [(e, n) for e, n, _ in runs] == want
    for end, n, state in runs:
        places = {(k, e) for k, t in enumerate(templates) for e in range(n, len(t) + 1) if t[e - n : e] == text[end - n : end]}
        assert {(k, e) for k, e in machine.ends[state] if e >= n} == places


def test_license_chain_bridges_other_words():
    machine = licenses.Automaton(licenses.PHRASES, licenses.TEMPLATES)
    text = licenses.TEMPLATES[6][1].replace("free of charge", "free of any charge").replace("merge", "// merge")
    found = licenses.scan_text(machine, text.encode())
    assert found[5] == "mit" and found[1] == 0 and found[6] > 0.9
    assert licenses.scan_text(machine, b"the license of the software is a free permission")[5] == ""


def test_license_placement():
    machine = licenses.Automaton(licenses.PHRASES, licenses.TEMPLATES)
    assert licenses.scan_text(machine, "Licensed under CC-BY-NC 4.0. The Apache--LICENSE".encode())[1:6] == (2, 2, 8, "apache,cc-by", "apache,cc-by,cc-by-nc-4.0")


PAGES = {
    "article": ("<body><nav><a>Home</a></nav><article><h1>T &amp; x</h1><p>One\n  two<br>three<p>Les.</article><footer>f</footer>", "T & x\nOne two three\nLes."),
    "no article": ("<div class=menu><a>a</a></div><div id=content><h1>Title</h1><p>" + "word " * 30 + "</p><p>Short.</p></div><div class='sidebar'>s</div>", "Title\n" + ("word " * 30).strip() + "\nShort."),
    "comments": ("<article><p>Text here.</p><section id='comments'><article class='comment'><p>Nice!</p></article></section></article>", "Text here."),
    "form": ("<main><p>A</p><form><input value=x><button>Go</button></form><p>B</p></main>", "A\nB"),
    "script": ("<article><p>A</p><script>if (a<b) x='</p>'</script><style>p>a{}</style><p>B</p></article>", "A\nB"),
    "cookie": ("<div class='cookie-notice'>We use cookies on this site.</div><article><p>A</p><aside>ad</aside><p>B</p></article>", "A\nB"),
    "header": ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>A</p></article>", "Title\nA"),
    "attributes": ("<article data-x='>' title=\"a>b\"><p class='lead header-free'>A</p></article>", "A"),
    "unclosed": ("<article><p>A<p>B<ul><li>c<li>d</ul>", "A\nB\nc\nd"),
    "comment": ("<article><!-- <p>no</p> --><p>yes</p><!-- open", "yes"),
    "plain": ("just text", "just text"),
    "references": ("<article><p>&lt;p&gt; &#233;&#x20AC;&nbsp;x</p></article>", "<p> é€ x"),
    "inline": ("<article><p>a<b>b</b>c <i>d</i></p></article>", "abc d"),
    "list": ("<article><p>A</p><ul><li><a href=x>linked</a></li></ul></article>", "A\nlinked"),
}


_BODY = "Long text of a page. " * 6
MARKED_PAGES = {
    "article": "<article class='post has-sidebar'><p>{0}</p></article><p>Other text.</p>",
    "open comments": "<article class='comments-open'><p>{0}</p><div id=comments><p>Nice!</p></div></article>",
    "wrapper": "<div class='content-sidebar-wrap'><article><p>{0}</p></article><div class=sidebar><p>s</p></div></div><p>Other.</p>",
    "section": "<section class='legal'><p>{0}</p><div class=share>Share</div></section>",
    "quoted hidden": "<article><p title='a hidden gem'>{0}</p></article>",
    "quoted data": "<div><div data-x='the hidden'><p>{0}</p></div></div>",
    "side": "<div><p>{0}</p></div><div class='sidebar'><p>{0}</p></div>",
    "teasers aside": "<div><p>{0}</p></div><div class='related-posts'><article><p>Read this.</p></article></div>",
}


@pytest.mark.parametrize("name", MARKED_PAGES)
def test_marked_elements_do_not_empty_a_page(name):
    assert html.main_text(MARKED_PAGES[name].format(_BODY)) == _BODY.strip()


@pytest.mark.parametrize("name", PAGES)
def test_html(name):
    page, text = PAGES[name]
    assert html.main_text(page) == text


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/pab!-='\" \n&;", max_size=60))
def test_html_takes_anything(page):
    html.main_text(page)


def test_js_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = math.sqrt(sum(x * math.log2(x / y) / 2 for d in (p, q) for x, y in zip(d, m) if x))
    row = spark.range(1).select(quality.js_distance(F.lit(p), F.lit(q)), quality.js_distance(F.lit(p), F.lit(p)), quality.js_distance(F.lit([1.0, 0.0]), F.lit([0.0, 1.0]))).first()
    assert tuple(row) == pytest.approx((want, 0, 1))


def test_languages_without_a_list_are_judged_by_their_own(spark):
    r = random.Random(3)

    def text(letters):
        return " ".join("".join(r.choice(letters) for _ in range(r.randrange(3, 9))) for _ in range(150)) + "."

    latin, cyrillic, kana = "abcdefgilmnoprstuvz", "абвгдежзиклмнопрсту", "あいうえおかきくけこさしすせそ"
    rows = [("it", latin)] * 60 + [("ru", cyrillic)] * 25 + [("ja", kana)] * 4 + [(None, latin)] * 40 + [(None, kana)] * 3 + [("", kana)] * 3
    docs = [(i, text(a), lang) for i, (lang, a) in enumerate(rows)]
    odd = [(1000, text("#*$%&|<>0123456789"), "it"), (1001, text("#*$%&|<>0123456789"), "ru"), (1002, text(latin), "ru")]
    d = spark.createDataFrame(docs + odd, "doc_id int, text string, lang string")
    found = {x["doc_id"]: x for x in quality.judge(d).collect()}
    assert [i for i, *_ in docs if not found[i]["kept"]] == []
    assert [i for i, *_ in odd if found[i]["kept"]] == []
    judged = {lang: {found[i]["class_distance"] is not None for i, _, x in docs if x == lang} for _, _, lang in docs}
    assert judged == {"it": {True}, "ru": {True}, "ja": {False}, None: {False}, "": {False}}


def test_luhn_and_mod97(spark):
    d = spark.createDataFrame([("4111111111111111", "GB82WEST12345698765432"), ("4111111111111112", "GB82WEST12345698765431")], "c string, i string")
    assert [tuple(r) for r in d.select(pii.luhn(F.col("c")), pii.mod97(F.col("i"))).collect()] == [(True, True), (False, False)]


def test_added_spans_need_checksum_or_context(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32.", "GB82 WEST 1234 5698 7654 31", "call 555-123-4567 now", "number 555-123-4567", "SSN 123-45-6789", "123-45-6789", "+1 (555) 123-4567 phone"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = [r[0] for r in pii.find_pii(d).orderBy("doc_id").select(pii.joined(F.col("all_spans"))).collect()]
    assert found == ["iban:5:32", "", "local_phone:5:17", "", "ssn:4:15", "", "phone:0:17"]


def test_account_numbers_end_before_other_words(spark):
    german, short, long = "DE89370400440532013000", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"
    spaced = "DE89 3704 0044 0532 0130 00"
    # no listed country
    other = "ZZ" + next(f"{k:02}" for k in range(100) if int("0123456789012345" + "3535" + f"{k:02}") % 97 == 1) + "0123456789012345"
    other_spaced = " ".join(other[i : i + 4] for i in range(0, len(other), 4))
    rows = [
        (f"{german} Please pay", [german]), (f"{spaced} BIC COBADEFFXXX", [spaced]), (f"{german} 12 euros", [german]),
        (f"{spaced} {spaced}", [spaced] * 2), (f"AB12 {spaced} 7", [spaced]), (f"to {short} OR {long} NOW", [short, long]),
        (f"{german}X", []), (f"{german[:-1]}1 Please", []), (f"\u00e9\U0001f600 {other} 12 EUR", [other]), (f"{other_spaced} NOW PAY", [other_spaced]),
        (" ".join(["AB12"] * 300 + [spaced] + ["GB34"] * 300), [spaced]), (f"{german}.\n{spaced}\n", [german, spaced]),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id int, text string")
    spans = pii.find_pii(d).orderBy("doc_id").select(F.filter("all_spans", lambda s: s["kind"] == "iban")).collect()
    assert [[t[s["first"] : s["end"]] for s in r[0]] for (t, _), r in zip(rows, spans)] == [found for _, found in rows]


def test_url_model_learns(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeiou") + r.choice("lmnrst") for _ in range(4))
    good = [f"http://{word()}.com/{word()}/{word()}.html" for _ in range(3000)]
    bad = [f"http://xxx-{r.randrange(10**6)}-qzk.org/zz{r.randrange(10**6)}qq" for _ in range(200)]
    held = [(f"http://{word()}.org/{word()}/{word()}.html", "allow") for _ in range(100)] + [(f"http://qzk-{r.randrange(10**6)}-zz.org/qzk{r.randrange(10**6)}", "block") for _ in range(12)]
    d = spark.createDataFrame([(u,) for u in [*good, *bad, *[u for u, _ in held]]], "url string")
    verdict = {x["url"]: x["verdict"] for x in urls.filter_urls(d).collect()}
    right = sum(verdict[u] == v for u, v in held)
    assert right >= 108


def test_markov_model_is_a_distribution():
    model = urls._model({5 * 1024 + 7 * 32 + 9: 4, 7 * 32 + 1: 2})
    for context in (0, 7, 5 * 32 + 7, 1023):
        assert sum(math.exp(x) for x in model[context * 32 : context * 32 + 32]) == pytest.approx(1)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<[/s>INST]\\|im_end abé", max_size=40))
def test_escape_round_trip(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    for mark in ("<s>", "</s>", "[INST]", "[/INST]", chat.START, chat.END, "<|image|>"):
        assert mark not in out


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="a%0A\n<s>|im_end", max_size=20))
def test_role_round_trip(role):
    out = chat.escape_role(role)
    assert chat.unescape_role(out) == role and "\n" not in out


def test_parts(spark):
    row = (1, 1, "assistant", [
        {"type": "text", "text": "see <|image|> "}, {"type": "image", "ref": "i.png", "width": 28, "height": 15}, None,
        {"type": "audio", "ref": "a.wav", "seconds": 1.5}, {"type": "document", "ref": "d.pdf", "pages": 2}, {"type": "video", "ref": "v"}, {"text": "end"}])
    schema = chat.T.StructType([chat.T.StructField("conv_id", chat.T.IntegerType()), chat.T.StructField("turn", chat.T.IntegerType()),
                                chat.T.StructField("role", chat.T.StringType()), chat.T.StructField("parts", chat.T.ArrayType(chat.PART))])
    r = chat.format_turns(spark.createDataFrame([row, (1, 2, "user", None)], schema), content="parts").orderBy("turn").collect()
    assert r[0]["piece"] == "<|im_start|>assistant\nsee <\\|image|> <|image|><|audio|><|document|><|part|>end<|im_end|>\n"
    assert [(a["place"], a["type"], a["ref"], a["n_tokens"]) for a in r[0]["attachments"]] == [
        (0, "image", "i.png", 4), (1, "audio", "a.wav", 38), (2, "document", "d.pdf", 512), (3, "video", "v", 1)]
    assert r[0]["n_tokens"] == 2 + 4 + 38 + 512 + 1 + 1
    assert r[1]["piece"] == "<|im_start|>user\n<|im_end|>\n"


def near_copies(n_groups, size, words, seed, edits):
    r = random.Random(seed)
    rows = []
    shared = [f"s{i}" for i in range(words // 2)]
    for g in range(n_groups):
        base = shared + [f"g{g}x{i}" for i in range(words)] if g % 2 else [f"g{g}x{i}" for i in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randrange(edits)):
                copy[r.randrange(len(copy))] = f"e{r.randrange(10**6)}"
            rows.append(" ".join(copy))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("words", "edits", "percent", "frequent"), [
    (30, 3, 85, -100), (120, 8, 85, -100), (400, 30, 80, 3)])
def test_no_link_is_lost(spark, monkeypatch, words, edits, percent, frequent):
    """With all tokens frequent (-100) every larger set is found by pairs alone."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = near_copies(6, 12, words, words, edits)
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicate_groups(d, percent=percent).collect()}
    assert found == brute.groups(rows, 4, percent)
    assert 6 <= len({c for _, c in found.values()}) < len(rows)


@pytest.mark.parametrize("percent", [85, 80])
def test_texts_with_longer_copies_link(spark, percent):
    """Pairs without further copies: one text has a passage more, at its end, at its start or inside."""
    rows = []
    for n in (40, 69, 80, 94, 100, 320, 376, 500):
        for gain in (1, 2, 5, 8, 10, 12, 14, 15, 16, 17, 20, 24, 25, 26):
            k = len(rows)
            words = [f"t{k}x{i}" for i in range(n + 3)]
            more = [f"m{k}x{i}" for i in range(n * gain // 100)]
            at = (n + 3, 0, n // 2)[gain % 3]
            rows += [(k, " ".join(words)), (k + 1, " ".join(words[:at] + more + words[at:]))]
    random.Random(percent).shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicate_groups(d, percent=percent).collect()}
    assert found == brute.groups(rows, 4, percent)
    assert len(rows) // 2 < len({c for _, c in found.values()}) < len(rows)


def test_chains_go_on_after_the_star(spark):
    """A chain whose ends do not link."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[k * 6 : k * 6 + 100])) for k in range(50)] + [(100 + k, " ".join(words[200:300]) + f" z{k}") for k in range(9)]
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicate_groups(d).collect()}
    assert found == brute.groups(rows)


def test_entries_of_linked_sets_meet():
    r = np.random.default_rng(7)
    counts = r.integers(0, 200, 1 << jaccard.BUCKETS_LOG2)
    for n in (5, 30, 79, 80, 81, 90, 200, 319, 330, 1000, 3000):
        for _ in range(20):
            a = np.unique(r.integers(0, 1 << 64, n, np.uint64))
            lost = int(r.integers(0, n - jaccard._least(n, 85) + 1))
            rest = r.permutation(a)[lost:]
            gain = max(0, int(100 * len(rest) // 85 - n))
            b = np.unique(np.concatenate([rest, r.integers(0, 1 << 64, gain, np.uint64)]))
            common = len(np.intersect1d(a, b))
            assert 100 * common >= 85 * (len(a) + len(b) - common)
            for limit in (-1, 100, 1000):
                found = [dict(zip(*(y.tolist() for y in jaccard._entries(x, jaccard._seen(x, counts), limit, 85)))) for x in (a, b)]
                # one of them passes the bound by its place
                assert any(min(found[0][e], found[1][e]) >= common for e in found[0].keys() & found[1].keys())


def test_token_hashes():
    texts = [b"A b c d e", b"a B  C\td e", b"", b"a b", b"b a", b"a b a b", b" x ", None]
    sets = list(jaccard.token_sets(texts, 4))
    assert [len(s) for s in sets] == [2, 2, 0, 1, 1, 1, 1, 0]
    assert (sets[0] == sets[1]).all() and sets[3][0] != sets[4][0]


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(50), r.randrange(50)) for _ in range(30)] + [(7, 7)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {x: find(x) for x in parent if find(x) != x}


def test_twice_filter_has_no_false_negative(spark):
    texts = [f"line {i}\nline {i % 700}\nline {i * 7 % 1000}" for i in range(2000)]
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    for bits in (1 << 12, 1 << 20):
        twice = lines.twice_seen(d, "text", 1, bits)
        from collections import Counter

        count = Counter(k for t in texts for k in set(t.encode().split(b"\n")))
        keys = [k for k, n in count.items() if n > 1]
        assert lines._has(twice, lines._places(np.array([lines.xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), bits)).all()
    once = [k for k, n in count.items() if n == 1]
    assert lines._has(twice, lines._places(np.array([lines.xxhash.xxh3_64_intdigest(k) for k in once], np.uint64), bits)).mean() < 0.1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    rows = [(None if i == 3 else f"s{i}", n) for i, n in enumerate(sizes)]
    found = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, size bigint"), (5, 2, 1), 3).collect()}
    assert found == pytest.approx(brute.targets(dict(rows)))


def test_thresholds_are_nested_and_near(spark):
    rows = [(i, "w " * (1 + i % 40), "abc"[(i % 10 > 2) + (i % 10 > 8)]) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(d).collect()
    for s in "abc":
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 40
    assert {r["taken"] // r["size"] for r in out} <= {0, 1, 2, 3}


def test_word_splits_agree():
    text = "Aé-b\tC\x0b1\x85  x\x1fY"
    assert [w.decode() for w in batches.folded_words(text.encode())] == brute.folded(text)
    assert [w.decode() for w in batches.spaced_words(text.encode())] == brute.SPACED.findall(text.translate(brute.LOWER))


ODD = {
    "symbols": "#*$%&|<>0123456789abc", "mild": "#*$%abcdefghijklmn", "digits": "0123456789", "no common words": "abcdefgilmnoprstuv",
}


@pytest.mark.parametrize("share", [10, 25, 40])
def test_junk_does_not_move_the_references(spark, share):
    """A language with up to 40 % of alike junk loses no clean text, long or short, and keeps no junk."""
    r = random.Random(share)

    def letters(alphabet):
        return "".join(r.choice(alphabet) for _ in range(r.randrange(3, 9)))

    def clean(lang, n):
        words = [r.choice(quality.COMMON_WORDS[lang]) if r.random() < 0.45 else letters("abcdefgilmnoprstuv") for _ in range(n)]
        return " ".join(w.capitalize() if k % 12 == 0 else w for k, w in enumerate(words)) + "."

    docs = []
    for lang, alphabet in zip(quality.COMMON_WORDS, ODD.values()):
        for i in range(100):
            odd = i < share
            n = r.choice([150, 1000] if odd else [150, 3000])
            docs.append((len(docs), " ".join(letters(alphabet) for _ in range(n)) if odd else clean(lang, n), lang, odd))
    d = spark.createDataFrame(docs, "doc_id int, text string, lang string, odd boolean").repartition(8)
    found = quality.judge(d).collect()
    assert [(x["lang"], x["n_words"]) for x in found if not x["odd"] and not x["kept"]] == []
    assert [(x["lang"], x["n_words"]) for x in found if x["odd"] and x["kept"]] == []


def test_bitmaps_never_rule_out_a_common_token():
    r = np.random.default_rng(11)
    for n, m in ((1, 1), (5, 300), (64, 65), (400, 420), (400, 5000), (3000, 3100)):
        for share in (0.0, 0.3, 0.9, 1.0):
            common = r.integers(0, 1 << 64, int(share * min(n, m)), np.uint64)
            a, b = (np.unique(np.concatenate([common, r.integers(0, 1 << 64, k - len(common), np.uint64)])) for k in (n, m))
            most = jaccard._most_common(len(a), len(b), jaccard._bitmap(a), jaccard._bitmap(b))
            assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))
            assert most == jaccard._most_common(len(b), len(a), jaccard._bitmap(b), jaccard._bitmap(a))
    a, b = (np.unique(r.integers(0, 1 << 64, 400, np.uint64)) for _ in range(2))
    assert jaccard._most_common(400, 400, jaccard._bitmap(a), jaccard._bitmap(b)) < 330  # texts that have nothing in common
