"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import xxhash


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def remainder(doc_id, parts: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % parts


def words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def simhash(text: str | None) -> int:
    w = words(text)
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    votes = [sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) for bit in range(64)]
    return sum(1 << bit for bit in range(64) if votes[bit] * 2 > len(shingles))


def classes(rows) -> list[tuple]:
    fps = [simhash(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, f"{fps[k]:016x}", least.get(root(k))) for k, (i, _) in enumerate(rows)]


def secrets(text: str | None) -> list[tuple]:
    t, out = text or "", []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        out += [(m.start(), 0, m.end(), "assign")] * (len(m[2]) >= 12)
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def personal(text: str | None) -> list[tuple]:
    t = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def named(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)


def contamination(rows, items) -> list[tuple]:
    split = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    windows = []
    for item, text in items:
        w = split(text)
        size = min(13, len(w))
        windows += [(None if item is None else str(item), w[k : k + size]) for k in range(len(w) - size + 1) if w]
    out = []
    for i, text in rows:
        w, hit, found = split(text), set(), set()
        for item, window in windows:
            for k in range(len(w) - len(window) + 1):
                if w[k : k + len(window)] == window:
                    hit.update(range(k, k + len(window)))
                    found.add(item)
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(i for i in found if i is not None))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def unigram(rows) -> list[tuple]:
    counts = Counter()
    for i, text in rows:
        if i is not None and remainder(i, 5) != 1:
            counts.update([*words(text), b" "])
    total, kinds = counts.total(), len(counts)
    out = []
    for i, text in rows:
        tokens = [*words(text), b" "]
        base = sum(log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        out.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), total, base))
    return out
