"""Plain, slow versions of operators for comparison."""

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def near_duplicates(rows):
    """rows: (doc_id, text) -> sorted (doc_id, n, component_id, kept)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            root[find(a)] = find(b)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=repr)


def secrets(text):
    """Base spans as (start, kind number, end)."""
    keyword = "".join(f"[{c.upper()}{c}]" for c in "password")
    names = "|".join(
        "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token")
    )
    api = "[aA][pP][iI]_?[kK][eE][yY]"
    assert keyword in names
    out = []
    for m in re.finditer(rf"""({names}|{api})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text or ""):
        if m.end() - m.start() >= 18:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer("[0-9a-f]+", text or ""):
        if m.end() - m.start() >= 16:
            out.append((m.start(), 2, m.end()))
    return sorted(out)


def allowed(value):
    return bool(
        re.search(r"^[A-Za-z+/_=-]*$|^[0-9+/_=-]*$", value)
        or re.search(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", value)
        or re.search(r"example|sample|placeholder|xxxx|0123456789|123456789|abcdefgh", value, re.I)
        or re.search(r"^(?:[A-Za-z]+|[0-9]{1,4})(?:[-_/+=](?:[A-Za-z]+|[0-9]{1,4}))+$", value)
    )


def entropy(value, window):
    def one(part):
        return -sum(n / len(part) * math.log2(n / len(part)) for n in Counter(part).values())

    return max(one(value[i : i + window]) for i in range(len(value) - window + 1))


def all_secrets(text, window=20, limits=(3.0, 3.7)):
    """Base spans and those found by entropy, by looking at all pairs and all windows."""
    base = secrets(text)
    out = list(base)
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{window},}}", text or ""):
        if allowed(m[0]) or any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        kind = 0 if re.fullmatch("[0-9a-fA-F]+", m[0]) else 1
        # Sums in another order differ in the last digits.
        if entropy(m[0], window) >= limits[kind] - 1e-9:
            out.append((m.start(), 3 + kind, m.end()))
    return sorted(out)


def masked(text, spans, mask):
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def listed(spans, names):
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
