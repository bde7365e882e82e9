"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text):
    return WORD.findall((text or "").encode())


def shingles(text):
    own = words((text or "").encode().lower().decode())
    if not own:
        return set()
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)}


def components(rows):
    """{doc_id: (n_shingles, component)} by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def quality(text):
    text = text or ""
    own = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    tri = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    often = Counter(tri)
    covered = {p for i, x in enumerate(tri) if often[x] > 1 for p in (i, i + 1, i + 2)}
    chars = sum(len(w.decode()) for w in own)
    failed = len(own) < 50 or 100 * len(covered) > 50 * len(own)
    return len(own), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def kept_words(rows, size=35):
    """{doc_id: (n_words, n_removed, digest)} by counting all windows."""
    count = {}
    own = [(i, words(t)) for i, t in rows]
    for _, w in own:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            count[key] = count.get(key, 0) + 1
    out = {}
    for i, w in own:
        gone = {p for k in range(len(w) - size + 1) if count[tuple(w[k : k + size])] > 1 for p in range(k, k + size)}
        stay = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(stay).hexdigest())
    return out


def redacted(text, spans):
    """The text with spans (start, rank, stop, kind), by start, each replaced by its kind; overlapping ones go together under the first."""
    out, upto = [], 0
    for start, _, stop, kind in spans:
        if start >= upto:
            out.append(text[upto:start] + f"[{kind.upper()}]")
        upto = max(upto, stop)
    return "".join(out) + text[upto:]
