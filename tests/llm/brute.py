"""Plain versions of the operators' contracts, over lists of rows."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def folded(text):
    return FOLDED.findall((text or "").translate(LOWER))


def licenses(text):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    words, starts, labels = folded(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def quality(text):
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    repeated = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    n = len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return n, sum(map(len, words)), symbols, dup, len(repeated), n < 20 or 100 * len(repeated) > 30 * n


RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def url(text):
    host = path = ""
    if text and "://" in text:
        rest = text.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    best = ("", None)
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best[1] or ""):
            best = (verdict, rule)
    return host, path, best[1], best[0] or None


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    spans, counts = [], []
    for rank, (kind, pattern) in enumerate(PII.items()):
        found = 0
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                found += 1
                spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
        counts.append(found)
    return *counts, ",".join(s[2] for s in sorted(spans))


def tokens(text, k):
    words = SPACED.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def groups(rows, k=4, percent=85):
    """rows: (id, text) with distinct ids; id -> (set size, component)."""
    sets = {i: tokens(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in sets.items():
        common = Counter(j for x in s for j in index[x])
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            index[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contaminated(texts, items):
    windows = defaultdict(set)
    for item, text in items:
        w = folded(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    sizes, out = {len(w) for w in windows}, []
    for text in texts:
        w, hit, found = folded(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                owners = windows.get(tuple(w[i : i + size]))
                if owners is not None:
                    hit.update(range(i, i + size))
                    found |= {str(o) for o in owners if o is not None}
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def kept_lines(texts, least=10):
    def key(line):
        return line.strip(BLANKS).translate(LOWER)

    count = Counter()
    for t in texts:
        count.update({key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or count[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def conversation(turns):
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), sha(whole), len(loss), sha(loss)


def targets(sizes, weights=(5, 2, 1), repeats=3):
    """source -> size to source -> target, by sharing the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed, free = sum(sizes.values()), {}, set(order)
    while free:
        left, shares = total - sum(fixed.values()), sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] > repeats * sizes[s] * shares]
        if not above:
            return fixed | {s: left * weight[s] / shares for s in free}
        for s in above:
            fixed[s] = repeats * sizes[s]
        free -= set(above)
    return fixed


def alignment(texts, a, b):
    """Contract rows of all texts; ``a`` and ``b`` give a text's (id, bytes) list."""
    rows, counts = [], Counter()
    for text in texts:
        both = [tok(text) for tok in (a, b)] if text else [[], []]
        if any(b"".join(x for _, x in t) != b" " + (text or "").encode() for t in both):
            both = [[], []]
        placed = []
        for tokens in both:
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            placed.append(out)
        covers = [[k for k, (_, s, e) in enumerate(p) for _ in range(s, e)] for p in placed]  # a token for each byte
        links = [(placed[0][x][0], placed[1][y][0]) for x, y in dict.fromkeys(zip(*covers))]
        counts.update(links)
        common = sorted({e for *_, e in placed[0]} & {e for *_, e in placed[1]})
        groups, done = [], [0, 0]
        for end in common:
            parts = []
            for k in (0, 1):
                own = []
                while done[k] < len(placed[k]) and placed[k][done[k]][2] <= end:
                    own.append(str(placed[k][done[k]][0]))
                    done[k] += 1
                parts.append(",".join(own))
            groups.append("|".join(parts))
        rows.append((len(placed[0]), len(placed[1]), len(common), links, sha(";".join(groups)) if groups else ""))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [
        (n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for n_a, n_b, n_groups, links, digest in rows
    ]


def tokenizers():
    """Token lists with bytes from the public tokenizers, by their libraries' own decoding."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    a.encode_special_tokens = True
    alphabet = {}
    code = 256
    for n in range(256):
        if 33 <= n <= 126 or 161 <= n <= 172 or n >= 174:
            alphabet[chr(n)] = n
        else:
            alphabet[chr(code)] = n
            code += 1
    b = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")

    def first(text):
        e = a.encode(" " + text, add_special_tokens=False)
        return [(i, bytes(alphabet[c] for c in t)) for i, t in zip(e.ids, e.tokens)]

    def second(text):
        ids = b.encode(text)
        return [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in zip(ids, map(b.id_to_piece, ids))]

    return first, second


def vectors(rows, threshold=0.9):
    """rows: (id, vector or None) -> list of (n_links, component) in their order."""
    import numpy as np

    def unit(v):
        if not v or any(x is None or x != x or abs(x) == float("inf") for x in v) or not any(v):
            return None
        v = np.array(v, float)
        v = v / abs(v).max()
        return v / (v @ v) ** 0.5

    units = [unit(v) if i is not None else None for i, v in rows]
    links, component = [0] * len(rows), [i for i, _ in rows]
    near = {}
    for size in {len(u) for u in units if u is not None}:
        own = [x for x, u in enumerate(units) if u is not None and len(u) == size]
        close = np.array([units[x] for x in own]) @ np.array([units[x] for x in own]).T >= threshold
        for x, row in zip(own, close):
            near[x] = [own[y] for y in np.flatnonzero(row) if own[y] != x]
            links[x] = len(near[x])
    seen = set()
    for x in near:
        group, todo = [], [x]
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                group.append(y)
                todo += near[y]
        for y in group:
            component[y] = min(rows[z][0] for z in group)
    return list(zip(links, component))


def trie(rows):
    """rows: (conv, turn, role, text) -> sorted contract rows."""
    import zlib

    def digest(t):
        return hashlib.md5(f"{len(t[0])}:{t[0]}{t[1]}".encode()).digest()

    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in convs.items():
        convs[c] = [t[2:] for t in sorted(turns, key=lambda t: (*t[:2], digest(t[2:])))]
    built = {}
    for c in list(convs):
        h = zlib.crc32(str(c).encode()) % 6
        rest = abs(c) % 100 * (1 if c > 0 else -1)
        built[c] = tuple(convs.get(c - rest, [])[:h] + convs[c][h:])
    members = defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n in members:
        cost = (len(members[n]) - 1) * len(n[-1][1]) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += cost
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), kids[n], leaves[n], saved[n],
         sha(",".join(str(c) for c in m if len(built[c]) == len(n))))
        for n, m in members.items()
    )
