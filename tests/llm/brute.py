"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(rows, threshold=10, min_chars=1):
    """(doc_id, n_lines, n_dropped, sha) for (doc_id, text) rows."""
    keys = [[line.strip(BLANKS).translate(LOWER) for line in (text or "").split("\n")] for _, text in rows]
    seen: dict[str, int] = {}
    for lines in keys:
        for key in set(lines):
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (doc, text), lines in zip(rows, keys, strict=True):
        whole = (text or "").split("\n")
        kept = [line for line, key in zip(whole, lines, strict=True) if len(key) < min_chars or seen[key] < threshold]
        out.append((doc, len(whole), len(whole) - len(kept), sha("\n".join(kept))))
    return out


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(rows, items, window=10):
    """(doc_id, n_words, n_hit, sorted item ids) for (doc_id, text) rows and (item_id, text) items."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        words = words_of(text)
        n = min(len(words), window)
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        words, hit, named = words_of(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                found = windows.get(tuple(words[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    named |= found
        out.append((doc, len(words), len(hit), sorted(named)))
    return out


def simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(fingerprints, radius=3):
    """Least index reachable, by all pairs."""
    fps = np.array(fingerprints, dtype=np.uint64)
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secrets(text):
    """Base spans (kind, start, end)."""
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Target per source: shares, caps and resharing round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not above:
            target.update({s: unit * weight[s] for s in open_})
            break
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def size_of(text):
    return len([w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w])


def edited(text, following):
    text, following = text or "", following or ""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def xxh(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def _signed(value):
    return value - 2**64 if value >= 2**63 else value


def _hash_of(terms):
    """Spark's hash of an array of longs: each element seeds the next."""
    seed = 42
    for term in terms:
        seed = xxh(struct.pack("<q", term), seed)
    return seed


def terms_of(text):
    return set((text or "").lower().replace("\n", " ").split(" "))


def lexicon(texts, least, most):
    """Hashes of the terms of ``least`` to ``most`` of all distinct texts."""
    distinct = {text or "" for text in texts}
    found = {}
    for text in distinct:
        for word in terms_of(text) - {""}:
            found[word] = found.get(word, 0) + 1
    return {_signed(xxh(w.encode())) for w, n in found.items() if least * len(distinct) <= n <= most * len(distinct)}


def imatch(text, words):
    """(48 parts, whole) of the kept terms; an empty part is None."""
    kept = sorted({_signed(xxh(word.encode())) for word in terms_of(text)} & words)
    parts = []
    for thinned in (0, 7, 63):  # bits above the first four that must be zero
        for part in range(16):
            mine = [term for term in kept if term & 15 == part and term >> 4 & thinned == 0]
            parts.append(_hash_of(mine) & 0xFFFFFF if mine else None)
    return parts, _hash_of(kept) if kept else xxh((text or "").encode())


def digits(fingerprint):
    parts, whole = fingerprint
    return "".join("......" if part is None else f"{part:06x}" for part in parts) + f"{whole:016x}"


def imatch_likeness(one, other):
    if one[1] == other[1]:
        return 1.0
    best = 0.0
    for first in (0, 16, 32):
        pairs = list(zip(one[0][first : first + 16], other[0][first : first + 16], strict=True))
        equal = sum(a is not None and a == b for a, b in pairs)
        best = max(best, equal / max(8, sum(a is not None or b is not None for a, b in pairs)))
    return best


def crc(text):
    return zlib.crc32((text or "").encode())
