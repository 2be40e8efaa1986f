"""Plain versions of the operators, as slow as they are short."""

import hashlib
import re
from collections import defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return SPACE.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, bench):
    tokens = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in bench:
        w = tokens(text)
        size = min(13, len(w))
        for p in range(len(w) - size + 1) if size else ():
            windows[tuple(w[p : p + size])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, items = tokens(text), set(), set()
        for size in {len(k) for k in windows}:
            for p in range(len(w) - size + 1):
                if found := windows.get(tuple(w[p : p + size])):
                    hit.update(range(p, p + size))
                    items |= found
        out.append((doc, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(d, len(s), find(d), find(d) == d) for d, s in sets]


def without_repeats(docs, width):
    seen = defaultdict(int)
    tokens = [(d, words(t)) for d, t in docs]
    for _, w in tokens:
        for p in range(len(w) - width + 1):
            seen[tuple(w[p : p + width])] += 1
    out = []
    for d, w in tokens:
        gone = {k for p in range(len(w) - width + 1) if seen[tuple(w[p : p + width])] > 1 for k in range(p, p + width)}
        out.append((d, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def repeated_spans(docs, width):
    seen = defaultdict(set)
    tokens = [(k, d, words(t)) for k, (d, t) in enumerate(docs)]
    for k, _, w in tokens:
        for p in range(len(w) - width + 1):
            seen[tuple(w[p : p + width])].add(k)
    out = []
    for _, d, w in tokens:
        inside = {j for p in range(len(w) - width + 1) if len(seen[tuple(w[p : p + width])]) > 1 for j in range(p, p + width)}
        for a in sorted(inside):
            if a - 1 not in inside:
                b = a
                while b in inside:
                    b += 1
                out.append((d, a, b, len(w)))
    return out


def measures(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    seen = defaultdict(int)
    for p in range(len(w) - 4):
        seen[tuple(w[p : p + 5])] += 1
    repeated = {k for p in range(len(w) - 4) if seen[tuple(w[p : p + 5])] > 1 for k in range(p, p + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def _mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % (1 << 64)
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % (1 << 64)
    return x ^ x >> 31


def language_scores(text, model):
    """The softmax over languages of the mean of a text's subwords' rows, one subword at a time; None without a word."""
    buckets, total, n = len(model.table), [0.0] * len(model.languages), 0
    for word in words((text or "").translate(LOWER)):
        data = b" " + word.encode() + b" "
        for size in (1, 2, 3, 4):
            for p in range(len(data) - size + 1):
                h = 0
                for byte in data[p : p + size]:
                    h = (h * 0x100000001B3 + byte + 1) % (1 << 64)
                row = model.table[_mixed((h + (size << 56)) % (1 << 64)) % buckets]
                total = [a + float(b) for a, b in zip(total, row, strict=True)]
                n += 1
    if not n:
        return None
    z = [(a / n + b) / model.temperature for a, b in zip(total, model.bias, strict=True)]
    e = [2.718281828459045 ** (x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def jump(key, shards):
    """The published algorithm on a 64-bit key."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def md5_key(key):
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
