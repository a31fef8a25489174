"""Plain Python versions of what the text queries must return."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import groupby

SF_DIR = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(t):
    return re.findall(WORD, t or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def quality(t):
    t = t or ""
    w = words(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    again = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
    return (*base, len(w) < 10 or 100 * len(again) > 20 * len(w))


def kept_lines(docs, least=10):
    """``docs``: (id, text), where rows equal in both are one document."""
    key = lambda x: lower(x.strip(" \t\n\x0b\f\r"))
    found = Counter(k for _, t in set(docs) for k in {key(x) for x in (t or "").split("\n")} - {""})
    out = []
    for _, t in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if found[key(x)] < least]
        out.append((len(lines), len(lines) - len(left), sha("\n".join(left))))
    return out


def shingles(t, k):
    w = words(lower(t or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def groups(texts, k=4, percent=85):
    """The group of each text by index of its first member, and the number of shingles."""
    sets, parent, seen = [shingles(t, k) for t in texts], list(range(len(texts))), defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in seen[g]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for g in s:
            seen[g].append(i)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def luhn(s):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def personal(t):
    def fits(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        return kind == "email" or (13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15)

    found = [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, t or "") if fits(k, m.group())]
    return [len(list(g)) for k in PII for g in [[f for f in found if f[0] == k]]], ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def rule(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    host = lower(re.match("[^/?#]*", rest).group())
    path = re.match("[^?#]*", rest[re.match("[^/?#]*", rest).end() :]).group()
    fits = []
    for verdict, r in rules:
        own, _, tail = r.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail):
            fits.append((len(r), r, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def runs(xs):
    return [(k, len(list(g))) for k, g in groupby(xs)]
