"""Plain versions of the corpus operators, written from their contracts."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows):
    """(doc_id, text) -> (doc_id, keep_id, group_size, kept, sha), one of equal rows kept."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == top and left > 0
            left -= kept
            out.append((i, top, len(ids), kept, sha(t)))
    return out


def substring(rows, length=20):
    low = float("-inf")
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - length + 1):
            g, at = tuple(w[s : s + length]), (low if i is None else i, s)
            first[g] = min(first.get(g, at), at)
    out = []
    for i, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (low if i is None else i, s):
                keep[s : s + length] = [False] * length
        kept = [x for x, k in zip(w, keep) if k]
        out.append((i, len(w), len(w) - len(kept), " ".join(kept)))
    return out


def line_runs(rows):
    """What is left when every line of a run of two lines or more, with a word, that occurs before is gone."""
    low = float("-inf")
    order = sorted(rows, key=lambda r: low if r[0] is None else r[0])
    lines = [(t or "").split("\n") for _, t in order]
    out = []
    for k, (i, _) in enumerate(order):
        mine, gone = lines[k], set()
        for e in range(k + 1):
            if e < k and order[e] == order[k]:
                continue
            other = lines[e]
            for a in range(len(mine)):
                for b in range(len(other)):
                    n = 0
                    while a + n < len(mine) and b + n < len(other) and mine[a + n] == other[b + n] and not (e == k and b + n >= a):
                        n += 1
                    if n >= 2 and any(WORD.search(x) for x in mine[a : a + n]):
                        gone |= set(range(a, a + n))
        out.append((i, len(mine), len(gone), "\n".join(x for p, x in enumerate(mine) if p not in gone)))
    return out


def counts(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if tri[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def shingles(text, n=4):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


def classes(rows, percent=85, n=4):
    sets = {i: shingles(t, n) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def private(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)
