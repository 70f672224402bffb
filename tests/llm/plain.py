"""Plain versions of what the operators compute: one text, one row or one pair at a time."""

import math
import random
import re

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
KINDS = list(FORMS)
WORD = re.compile("[^\x20\x09-\x0d]+")


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def word_hash(word):
    raw = word.encode()
    return mix((sum((b + 1) * pow(BASE, k, 1 << 64) for k, b in enumerate(raw)) + len(raw)) & MASK)


def features(text, bits=17, ngrams=(3, 4, 5)):
    text = text or ""
    words = [word_hash(w) for w in WORD.findall(text)]
    rows = [0, *(w >> (64 - bits) for w in words), *(mix(a ^ b) >> (64 - bits) for a, b in zip(words, words[1:], strict=False))]
    c = [0x20 if ch in " \t\n\x0b\x0c\r" else ord(ch) for ch in text]
    for n in ngrams:
        for i in range(len(c) - n + 1):
            if n > 2 and 0x20 in c[i + 1 : i + n - 1]:
                continue
            h = 0x9E3779B1 * n & 0xFFFFFFFF
            for x in c[i : i + n]:
                h = ((h ^ x) * 0x01000193) & 0xFFFFFFFF
                h ^= h >> 15
            rows.append((h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - bits))
    return rows


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(text):
    """(start, kind, end), sorted."""
    out = []
    for n, (k, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or k == "card" and 14 <= len(d) <= 19 and luhn(d) or k == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def added_spans(text, wide, context, model):
    """The spans that trees add: every candidate against every base span and every other candidate."""
    import regex

    text, base, found = text or "", base_spans(text), []
    for kind, name in enumerate(KINDS):
        ahead = 0
        for m in regex.finditer(wide[name], text):
            before, s = text[max(ahead, m.start() - 24) : m.start()], m.group()
            ahead = m.start()
            if any(a < m.end() and m.start() < b for a, _, b in base):
                continue
            d = re.sub("[^0-9]", "", s)
            x = [kind, len(s), len(d), len(re.split("[^0-9A-Za-z]+", s)), bool(d) and luhn(d), d.startswith("0"), "(" in s, s.count("."), s.count("-"), s.count(" "), len(re.sub("[^A-Za-z]", "", s))]
            x += [bool(regex.search(r"[\p{L}0-9]$", before)), bool(regex.search(r"[\p{L}0-9]", text[m.end() : m.end() + 1])), *(bool(regex.search(p, before)) for p in context.values())]
            total = sum(_walk(t, x) for t in model.trees)
            p = 1 / (1 + math.exp(-(model.slope * total + model.shift)))
            if p >= model.thresholds[name]:
                found.append((m.start(), kind, m.end(), p))
    rank = lambda c: (c[3], -c[0], -c[1])
    return sorted(c[:3] for c in found if not any(o[0] < c[2] and c[0] < o[2] and rank(o) > rank(c) for o in found))


def _walk(tree, x):
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if x[f] < cut else high
    return tree


def redacted(text, spans):
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def groups(sets, percent):
    """For each set the number of the first one reachable by links."""
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if v in (x, y) else v for v in root]
    return root


def targets(sizes, weights, total, repeat=2.0):
    """Water-filling by bisection of the level."""
    if not sum(sizes):
        return [0.0] * len(sizes)
    low, high = 0.0, max(repeat * s / w for s, w in zip(sizes, weights, strict=True))
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(w * level, repeat * s) for s, w in zip(sizes, weights, strict=True)) < total else (low, level)
    return [min(w * high, repeat * s) for s, w in zip(sizes, weights, strict=True)]


def some_text(r: random.Random, n: int) -> str:
    parts = ["call (555) 123-4567 now", "a@b.cc", "mail john (at) doe (dot) org", "10.0.0.1", "4111 1111 1111 1111", "order 123-456-7890", "+1 555 123 4567 x", "2001:0db8:1111:2222:3333:4444:5555:6666", "word", "é", "card 4111.1111.1111.1111,", "\n", "at", "1.2.3", "tel 030 1234 5678"]
    return " ".join(r.choice(parts) for _ in range(n))
