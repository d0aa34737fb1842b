"""Plain versions of the contract queries for small tables: text in, tuples out."""

import hashlib
import re
import zlib

import xxhash

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
SPACES = re.compile("[^\x20\x09-\x0d]+")
LETTERS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def op1(docs, n=400):
    """docs: list of texts. Windows are counted over all positions of all texts."""
    data = [(t or "").encode() for t in docs]
    seen = {}
    for d, b in enumerate(data):
        for i in range(len(b) - n + 1):
            seen.setdefault(b[i : i + n], []).append((d, i))
    gone = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + n] = b"\x01" * n
    out = []
    for b, g in zip(data, gone):
        kept = bytes(x for x, y in zip(b, g) if not y)
        out.append((len(b), sum(g), len(re.findall(b"\x01+", bytes(g))), sha(kept)))
    return out


def op5(docs, items, n=13):
    windows = {}
    for key, text in items:
        w = LETTERS.findall(lower(text))
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add("" if key is None else str(key))
    lengths = {len(w) for w in windows}
    out = []
    for text in docs:
        w = LETTERS.findall(lower(text))
        hit, found = set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                keys = windows.get(tuple(w[i : i + m]))
                if keys:
                    found |= keys
                    hit.update(range(i, i + m))
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def op6_fingerprint(text):
    w = SPACES.findall(lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def op6(rows):
    """rows: (doc_id, text) -> {doc_id: (fingerprint, component)}"""
    prints = {d: op6_fingerprint(t) for d, t in rows}
    parent = {d: d for d in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (f"{prints[d]:016x}", top(d)) for d in ids}


def op7(text):
    text = text or ""
    w = SPACES.findall(text)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {j for places in grams.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACES.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def similar_groups(docs, words=5, part=4, whole=5):
    """docs: (id, text). Each id's group: texts whose sets of word shingles are similar by part / whole, through others too."""
    sets, at = {}, {}
    for d, t in docs:
        w = SPACES.findall(lower(t))
        sets[d] = frozenset(" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()
        at[d] = d

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both * whole >= (len(sets[a]) + len(sets[b]) - both) * part:
                at[max(top(a), top(b))] = min(top(a), top(b))
    return {d: top(d) for d in ids}


def op8_pieces(tokenizer, text, capacity=4096):
    import numpy as np

    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    return [(k, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]


def op9(turns):
    """turns: (role, text) in order."""
    learnt = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len(learnt), sha(learnt)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def op4(text):
    text = text or ""
    spans = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    spans += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda x: re.sub("[^0-9]", "", x)
    spans += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    spans += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    spans.sort()
    count = [sum(s[2] == k for s in spans) for k in ("email", "ip", "card", "phone")]
    return *count, sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op3(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
    fit = [(len(h) + len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, None))
    return host, path, best[1], best[2]
