"""Pair kernels on Python strings (code points) or sequences; no Spark here."""

from __future__ import annotations

import numpy as np

import difflib
import re
from collections.abc import Sequence


def utf16(text: str) -> list[int]:
    """UTF-16 code units, for callers that count in them."""
    raw = text.encode("utf-16-le", "surrogatepass")
    return [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Longest common subsequence, bit-parallel over Python's whole numbers."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        if m := where.get(c):
            u = rows & m
            rows = ((rows + u) | (rows - u)) & full
    return len(a) - rows.bit_count()


def substring_length(a: Sequence, b: Sequence) -> int:
    """Longest common contiguous run."""
    best, row = 0, {}
    ends: dict = {}
    for j, c in enumerate(b):
        ends.setdefault(c, []).append(j)
    for c in a:
        row = {j: row.get(j - 1, 0) + 1 for j in ends.get(c, ())}
        best = max(best, max(row.values(), default=0))
    return best


def osa(a: Sequence, b: Sequence) -> int:
    """Edits and swaps of neighbours, no part edited twice."""
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def damerau(a: Sequence, b: Sequence) -> int:
    """Unrestricted edits with swaps: transposed letters may have others between."""
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    seen: dict = {}
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            if x == y:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + (x != y), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        seen[x] = i
    return d[len(a), len(b)]


def jaro(a: Sequence, b: Sequence) -> float:
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: Sequence, b: Sequence, weight: float = 0.1) -> float:
    s = jaro(a, b)
    if s <= 0.7:
        return s
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return s + prefix * weight * (1 - s)


def ratcliff(a: Sequence, b: Sequence) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def indel_similarity(a: Sequence, b: Sequence) -> float:
    total = len(a) + len(b)
    return 2 * lcs_length(a, b) / total if total else 1.0


# ---------------------------------------------------------------- fuzzy ratios, 0 to 100


def ratio(a: str, b: str) -> float:
    return 100 * indel_similarity(a, b)


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any window of its length in the longer one, cut
    windows at both ends included."""
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(a, b) if len(a) < len(b) else _windows(b, a)


def _windows(short: str, long: str) -> float:
    m, n, best = len(short), len(long), 0.0
    letters = set(short)
    for start in range(1 - m, n):
        lo, hi = max(0, start), min(n, start + m)
        size = hi - lo
        if 200 * min(m, size) / (m + size) <= best:
            continue  # even a perfect match of this window is no better
        # a window that neither begins nor ends on a letter of the short text is beaten by a neighbour
        if long[hi - 1] not in letters and (start <= 0 or long[lo] not in letters) and best:
            continue
        best = max(best, ratio(short, long[lo:hi]))
        if best == 100:
            break
    return best


def _sorted(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted(a), _sorted(b))


def _token_set(a: str, b: str, score) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(sorted(z)) for z in (x - y, y - x))
    left, right = (f"{both} {z}".strip() if both and z else both or z for z in (left, right))
    return max(score(both, left), score(both, right), score(left, right))


def token_set_ratio(a: str, b: str) -> float:
    return _token_set(a, b, ratio)


def partial_token_sort_ratio(a: str, b: str) -> float:
    return partial_ratio(_sorted(a), _sorted(b))


def partial_token_set_ratio(a: str, b: str) -> float:
    return _token_set(a, b, partial_ratio)


def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if spread < 1.5:
        return max(ratio(a, b), 0.95 * token_sort_ratio(a, b), 0.95 * token_set_ratio(a, b))
    p = 0.6 if spread > 8 else 0.9
    parts = (p * partial_ratio(a, b), 0.95 * p * partial_token_sort_ratio(a, b), 0.95 * p * partial_token_set_ratio(a, b))
    return max(ratio(a, b), *parts)


# ---------------------------------------------------------------- phonetic codes

# Rules in order of trial at each place: a pattern over the prepared word, and its code
# ("=" stands for the matched text).
# The published rules, in their order.
_METAPHONE = [
    ("^[AEIOU]", "="), ("[AEIOU]", ""), ("(?<=M)B$", ""), ("B", "B"),
    ("C(?=H|IA)", "X"), ("C(?=[IEY])", "S"), ("C", "K"), ("DG(?=[IEY])", "J"), ("D", "T"),
    ("GH(?=T)", ""), ("G(?=H)", "K"), ("GN$", ""), ("G(?=[IEY])", "J"), ("G", "K"),
    ("(?<=[CSPT])H", ""), ("(?<=[AEIOU])H(?![AEIOU])", ""), ("H", "H"), ("(?<=C)K", ""), ("K", "K"),
    ("P(?=H)", "F"), ("P", "P"), ("Q", "K"), ("S(?=H|I[OA])", "X"), ("S", "S"),
    ("T(?=I[OA])", "X"), ("T(?=H)", "0"), ("T", "T"), ("V", "F"), ("[WY](?=[AEIOU])", "="),
    ("^X", "S"), ("X", "KS"), ("Z", "S"), ("[FJLMNR]", "="), (".", ""),
]
# The published rules, in their order.
_NYSIIS = [
    ("EV", "AF"), ("[AEIOU]", "A"), ("Q", "G"), ("Z", "S"), ("M", "N"), ("K(?=N)", "N"), ("K", "C"),
    ("SCH", "SSS"), ("PH", "FF"), ("(?<=[AEIOU])H(?=[AEIOU])", "H"), ("(?<=[AEIOU])H", "A"),
    ("H", "<"), ("(?<=[AEIOU])W", "<"), (".", "="),
]


def _compiled(rules):
    return re.compile("|".join(f"({p})" for p, _ in rules), re.S), [c for _, c in rules]


_METAPHONE_RE, _METAPHONE_CODES = _compiled(_METAPHONE)
_NYSIIS_RE, _NYSIIS_CODES = _compiled(_NYSIIS)


def _letters(word: str) -> str:
    return "".join(c.upper() if len(c.upper()) == 1 else c for c in word if c.isalpha())


def metaphone(word: str) -> str:
    w = _letters(word)
    w = re.sub("^(?:AE|GN|KN|PN|WR)", lambda m: m[0][1:], w)
    w = re.sub("^WH", "W", w)
    w = re.sub(r"([^C])\1+", r"\1", w, flags=re.S)
    return _METAPHONE_RE.sub(lambda m: _METAPHONE_CODES[m.lastindex - 1].replace("=", m[0]), w)


def nysiis(word: str) -> str:
    w = _letters(word)
    if not w:
        return ""
    for old, new in (("MAC", "MCC"), ("KN", "N"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if w.startswith(old):
            w = new + w[len(old) :]
            break
    w = re.sub("(?:EE|IE)$", "Y", w) if w.endswith(("EE", "IE")) else re.sub("(?:DT|RT|RD|NT|ND)$", "D", w)

    def code(m):
        return _NYSIIS_CODES[m.lastindex - 1].replace("=", m[0]).replace("<", w[m.start() - 1])

    out, at = [w[0]], 1
    while m := _NYSIIS_RE.match(w, at):
        out.append(code(m))
        at = m.end()
    key = re.sub(r"(.)\1+", r"\1", "".join(out), flags=re.S)
    if len(key) > 1 and key.endswith("S"):
        key = key[:-1]
    if len(key) > 1 and key.endswith("AY"):
        key = key[:-2] + "Y"
    if len(key) > 1 and key.endswith("A"):
        key = key[:-1]
    return key


# ---------------------------------------------------------------- MurmurHash3


def murmur3(text: str, seed: int = 0) -> int:
    """MurmurHash3 x86-32 of the UTF-8 bytes, signed."""
    data = text.encode()
    mask = 0xFFFFFFFF

    def scramble(k):
        k = k * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) & mask
        return k * 0x1B873593 & mask

    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= scramble(int.from_bytes(data[i : i + 4], "little"))
        h = (h << 13 | h >> 19) & mask
        h = (h * 5 + 0xE6546B64) & mask
    if whole < len(data):
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * by & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def murmur3_many(texts: list[str], longest: int = 64) -> np.ndarray:
    """murmur3() of many texts, as int32: block by block over all of them at once."""
    data = [t.encode() for t in texts]
    size = np.array([len(d) for d in data], np.int64)
    out = np.empty(len(data), np.int32)
    for i in np.flatnonzero(size > longest).tolist():
        out[i] = murmur3(texts[i])
    short = np.flatnonzero(size <= longest)
    if not len(short):
        return out
    size = size[short]
    width = int(size.max()) // 4 + 1
    blocks = np.frombuffer(b"".join([data[i].ljust(4 * width, b"\0") for i in short.tolist()]), "<u4").reshape(-1, width)

    def rotate(x, by):
        return x << np.uint32(by) | x >> np.uint32(32 - by)

    h = np.zeros(len(short), np.uint32)
    for i in range(width):
        k = rotate(blocks[:, i] * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        whole, rest = size // 4 > i, (size // 4 == i) & (size % 4 > 0)
        h = np.where(whole | rest, h ^ k, h)
        h = np.where(whole, rotate(h, 13) * np.uint32(5) + np.uint32(0xE6546B64), h)
    h ^= size.astype(np.uint32)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(by)
    out[short] = (h ^ h >> np.uint32(16)).view(np.int32)
    return out
