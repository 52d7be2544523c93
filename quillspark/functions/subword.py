"""Sub-word tokenization kernels: greedy WordPiece, unigram Viterbi, precompiled normalisation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META = "▁"
_SPLIT = re.compile(r"\w+|[^\w\s]+")

#: Piece types as the model format numbers them.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


@dataclass(frozen=True)
class WordPiece:
    """Token ids, the unknown token and the prefix of continuing pieces."""

    vocab: dict[str, int]
    unk: str = "[UNK]"
    prefix: str = "##"
    lowercase: bool = False
    longest_word: int = 100

    def __post_init__(self):
        if self.unk not in self.vocab:
            raise ValueError(f"the vocabulary has no {self.unk}")

    def word(self, w: str) -> list[str]:
        if len(w) > self.longest_word:
            return [self.unk]
        out, at = [], 0
        while at < len(w):
            head = self.prefix if at else ""
            end = next((e for e in range(len(w), at, -1) if head + w[at:e] in self.vocab), None)
            if end is None:
                return [self.unk]
            out.append(head + w[at:end])
            at = end
        return out

    def encode(self, text: str, memo: dict | None = None) -> tuple[list[str], list[int]]:
        memo = {} if memo is None else memo
        tokens = []
        for w in _SPLIT.findall(text.lower() if self.lowercase else text):
            if w not in memo:
                memo[w] = self.word(w)
            tokens += memo[w]
        return tokens, [self.vocab[t] for t in tokens]


class CharsMap:
    """The normalisation table of a model file: a double-array trie over UTF-8 and the texts that
    its values point to. An empty table changes nothing."""

    def __init__(self, blob: bytes = b""):
        self.units: list[int] = []
        self.texts = b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            if size % 4 or 4 + size > len(blob):
                raise ValueError("the normalisation table is cut short")
            self.units = [int.from_bytes(blob[i : i + 4], "little") for i in range(4, 4 + size, 4)]
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(bytes matched, place of the new text); (0, 0) without a match."""
        units, found = self.units, (0, 0)
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1 and node < len(units):
                found = (i - at + 1, units[node] & 0x7FFFFFFF)
        return found

    def normalize(self, text: str) -> str:
        if not self.units:
            return text
        data, out, at = text.encode(), bytearray(), 0
        while at < len(data):
            n, place = self.longest(data, at)
            if n:
                end = self.texts.find(b"\0", place)
                out += self.texts[place : end if end >= 0 else len(self.texts)]
            else:
                first = data[at]
                n = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                out += data[at : at + n]
            at += n
        return out.decode("utf-8", "replace")


@dataclass(frozen=True)
class Unigram:
    """Pieces (piece, score, type); the place is the id."""

    pieces: tuple[tuple[str, float, int], ...]
    unk_id: int = 0
    bos_id: int = -1
    eos_id: int = -1
    pad_id: int = -1
    charsmap: CharsMap = field(default_factory=CharsMap, compare=False)

    def __post_init__(self):
        if not 0 <= self.unk_id < len(self.pieces):
            raise ValueError("the unknown id is no piece")
        # control and unknown pieces never match text
        known = {p: (s, i) for i, (p, s, t) in reversed(list(enumerate(self.pieces))) if t not in (UNKNOWN, CONTROL, UNUSED)}
        object.__setattr__(self, "known", known)
        object.__setattr__(self, "longest", max((len(p) for p in known), default=0))
        object.__setattr__(self, "unk_score", min(0.0, min((s for s, _ in known.values()), default=0.0)) - 10)

    def encode(self, text: str) -> tuple[list[str], list[int]]:
        words = [w for w in self.charsmap.normalize(text).split(" ") if w]
        s = "".join(META + w for w in words)
        n = len(s)
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)] + [(float("-inf"), 0, -1)] * n
        for i in range(n):
            base, single = best[i][0], False
            for e in range(i + 1, min(n, i + self.longest) + 1):
                hit = self.known.get(s[i:e])
                if hit:
                    single |= e == i + 1
                    if base + hit[0] > best[e][0]:
                        best[e] = (base + hit[0], i, hit[1])
            if not single and base + self.unk_score > best[i + 1][0]:
                best[i + 1] = (base + self.unk_score, i, self.unk_id)
        pieces, ids, at = [], [], n
        while at:
            _, start, i = best[at]
            if i == self.unk_id and ids and ids[-1] == self.unk_id:
                pieces[-1] = s[start:at] + pieces[-1]
            else:
                pieces.append(s[start:at])
                ids.append(i)
            at = start
        return pieces[::-1], ids[::-1]


def tokenizer(model: WordPiece | Unigram, df: DataFrame):
    """A column function text -> struct<tokens, ids>. The model is broadcast once; words of a
    WordPiece model are worked out once a batch."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("tokens array<string>, ids array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        m, memo = held.value, {}
        one = (lambda t: m.encode(t, memo)) if isinstance(m, WordPiece) else m.encode
        rows = [(None, None) if t is None else one(t) for t in texts]
        return pd.DataFrame(rows, columns=["tokens", "ids"])

    def column(text) -> Column:
        return run(F.col(text) if isinstance(text, str) else text)

    return column
