"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode("utf-8") if isinstance(s, str) else s).hexdigest()


def lower_ascii(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text, n=5):
    words = SPACE.findall(lower_ascii(text or ""))
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    t = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    out.sort()
    n = Counter(x[2] for x in out)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in out))


def quality(text):
    t = text or ""
    w = SPACE.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    rep = {p for i, g in enumerate(grams) if c[g] > 1 for p in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(rep)


def personal(text):
    t = text or ""
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    card = []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0:
            card.append(m.span())
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(x in "0123456789" for x in m[0]) <= 15]
    spans = [(k, a, b) for k, s in (("email", email), ("ip", ip), ("card", card), ("phone", phone)) for a, b in s]
    return len(email), len(ip), len(card), len(phone), sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)), set(spans)


def components(sets):
    """sets: id -> shingle set; smallest id reachable over links of 0.75."""
    ids = sorted(sets)
    by = {}
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = Counter()
    for members in by.values():
        for x in range(len(members)):
            for y in range(x + 1, len(members)):
                pairs[members[x], members[y]] += 1
    for (a, b), n in pairs.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: find(i) for i in ids}


def removed(docs, width=100):
    """docs: list of (id, bytes) by id. -> id: (n_removed, n_spans, sha)."""
    first, out = set(), {}
    for i, b in docs:
        cover = bytearray(len(b))
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            if s in first:
                cover[p : p + width] = b"\x01" * width
            else:
                first.add(s)
        spans = len(re.findall(b"\x01+", bytes(cover)))
        out[i] = (len(b), sum(cover), spans, sha(bytes(x for x, c in zip(b, cover) if not c)))
    return out
