"""Plain versions of the operators' rules, one text at a time."""

import re
import zlib
from collections import Counter, defaultdict
from math import log

from sparkloom.llm import decontaminate, quality


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def measures(text):
    """The measures of the quality rules and their verdict."""
    text = text or ""
    w = words(text)
    chars = sum(map(len, w))
    seen, dup_lines, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if words(line):
            dup_lines += line in seen
            dup_chars += sum(map(len, words(line))) * (line in seen)
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    out = {"n_words": len(w), "word_chars": chars, "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup_lines, "n_repeat_words": len(again), "dup_line_chars": dup_chars}
    fine = dup_chars <= quality.LINE_LIMIT * chars and out["n_symbols"] <= quality.SYMBOL_LIMIT * chars
    for k, limit in quality.NGRAM_LIMITS.items():
        met, inside = set(), set()
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            if g in met:
                inside.update(range(i, i + k))
            met.add(g)
        out[f"dup_chars_{k}"] = sum(len(w[i]) for i in inside)
        fine = fine and out[f"dup_chars_{k}"] <= limit * chars
    out["base_failed"] = len(w) < 50 or 100 * len(again) > 50 * len(w)
    out["kept"] = not out["base_failed"] and fine
    return out


def shingle_set(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def nearest_ids(rows, k, num, den):
    """{id: smallest id that links lead to} of (id, text) rows with distinct ids."""
    sets = {d: shingle_set(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def leaks(text, items):
    """{item: score} of the (id, text) items that a text holds: every passage
    is scored against every item without an index."""
    D = decontaminate
    bags = {i: Counter(D.plain(t.encode()).split()) for i, t in items}
    bags = {i: b for i, b in bags.items() if b}
    size = {i: sum(b.values()) for i, b in bags.items()}
    mean, df = sum(size.values()) / max(1, len(size)), Counter(x for b in bags.values() for x in b)
    worth = {i: {x: log(1 + (len(bags) - df[x] + 0.5) / (df[x] + 0.5)) * n * (D.K1 + 1) / (n + D.K1 * (1 - D.B + D.B * size[i] / mean)) for x, n in b.items()} for i, b in bags.items()}
    step = max([D.LEAST_PASSAGE, *size.values()])
    w = D.plain((text or "").encode()).split()
    found, by_id = {}, dict(items)
    for p in range(max(1, -(-len(w) // step))):
        terms = set(w[p * step : (p + 2) * step])
        around = w[max(0, (p - 1) * step) : (p + 3) * step]
        for i, each in worth.items():
            score = sum(s for x, s in each.items() if x in terms) / sum(each.values())
            if score < D.LEAST_SCORE - 1e-9 or found.get(i, (0,))[0] >= score:
                continue
            q, a = D.parts(by_id[i].encode())
            n = min(D.SHINGLE, size[i])
            have = {tuple(around[j : j + m]) for m in {1, 2, n} for j in range(len(around) - m + 1)}
            share = [len(x & have) / len(x) if x else 1.0 for x in map(D._shingles, (q, a))]
            if share[0] >= D.LEAST_QUESTION and share[1] >= D.LEAST_ANSWER:
                found[i] = (score,)
    return {i: x[0] for i, x in found.items()}


BASE = [
    ("assign", re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[1]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def base_secrets(text):
    found = [(m.start(), i, k, m.end()) for i, (k, r, ok) in enumerate(BASE) for m in r.finditer(text or "") if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def pieces(ids, capacity=1024):
    """(start, length, crc) of a document's ids, its end id included."""
    n = len(ids)
    cuts = [0] if n <= capacity else sorted({0, *range(n % capacity, n, capacity)})
    return [(a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for a, b in zip(cuts, [*cuts[1:], n], strict=True)]


def totals(rows):
    out = defaultdict(lambda: [0, 0])
    for *key, docs, tokens in rows:
        out[tuple(key)][0] += docs
        out[tuple(key)][1] += tokens
    return {k: tuple(v) for k, v in out.items() if any(v)}
