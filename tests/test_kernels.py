"""Kernels against published and frozen values, and against plain definitions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.functions import kernels as K
from quillspark.functions import stem as S
from quillspark.functions import subword
from quillspark.sources import vocab as V

texts = st.text(alphabet="abcé😀 ", max_size=9)


@pytest.mark.parametrize(("a", "b", "o", "d"), [("CA", "ABC", 3, 2), ("", "abc", 3, 3), ("ab", "ba", 1, 1), ("", "", 0, 0)])
def test_transpositions(a, b, o, d):
    assert (K.osa(a, b), K.damerau(a, b)) == (o, d)


@settings(max_examples=200, deadline=None)
@given(texts, texts)
def test_distances_hold_their_bounds(a, b):
    lcs = K.lcs_length(a, b)
    assert K.substring_length(a, b) <= lcs <= min(len(a), len(b))
    assert K.damerau(a, b) <= K.osa(a, b) <= max(len(a), len(b))
    assert K.osa(a, b) == K.osa(b, a)
    assert 0 <= K.jaro(a, b) <= K.jaro_winkler(a, b) <= 1 + 1e-12
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert lcs == table[-1][-1]


def plain_partial_ratio(a, b):
    if not a or not b:
        return 100.0 if not a and not b else 0.0

    def best(s, t):
        return max(K.ratio(s, t[max(0, i) : i + len(s)]) for i in range(1 - len(s), len(t)))

    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(a, b) if len(a) < len(b) else best(b, a)


def test_partial_ratio_is_the_best_window():
    r = random.Random(1)
    for _ in range(1500):
        a = "".join(r.choice("abcx ") for _ in range(r.randint(0, 9)))
        b = "".join(r.choice("abcdyz") for _ in range(r.randint(0, 14)))
        assert K.partial_ratio(a, b) == pytest.approx(plain_partial_ratio(a, b))


def test_fuzzy_values():
    a, b = "fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear"
    assert K.ratio(a, b) == pytest.approx(90.90909)
    assert K.partial_ratio(a, b) == pytest.approx(93.02326)
    assert (K.token_sort_ratio(a, b), K.token_set_ratio(a, b), K.wratio(a, b)) == (100, 100, 95)
    assert K.token_set_ratio("", "a") == K.wratio("", "") == 0


@pytest.mark.parametrize(("word", "code"), [("Knuth", "N0"), ("Catherine", "K0RN"), ("Jackson", "JKSN"), ("MacDonald", "MKTNLT"), ("Knighted", "NTT"), ("Thomas", "0MS"), ("", "")])
def test_metaphone(word, code):
    assert K.metaphone(word) == code


@pytest.mark.parametrize(("word", "code"), [("Robert", "RABAD"), ("Honeyman", "HANAYNAN"), ("Knuth", "NAT"), ("MacDonald", "MCDANALD"), ("Brown", "BRAON"), ("1", "")])
def test_nysiis(word, code):
    assert K.nysiis(word) == code


def test_murmur3():
    assert [K.murmur3(w) for w in ("cat", "the", "mat")] == [1751422759, -1132748958, -69083019]


@pytest.mark.parametrize(
    ("language", "pairs"),
    {
        "porter": "caresses:caress ponies:poni hopping:hop relational:relat generalizations:gener",
        "en": "generously:generous skies:sky hopping:hop happiness:happi communism:communism",
        "fr": "finalement:final mangé:mang qualité:qualit technologie:technolog culturel:culturel",
        "de": "füße:fuss ergebnisse:ergebnis freundlichen:freundlich singend:singend männern:mann",
        "it": "musiche:music generazione:gener biologie:biolog capacità:capac cantata:cant",
        "pt": "formosa:formos geração:geraçã biologias:biolog claramente:clar cantasse:cant",
        "es": "escribirle:escrib posibles:posibl existencia:existent generalmente:general cantamos:cant",
    }.items(),
)
def test_stemmers(language, pairs):
    got = {w: S.STEMMERS[language](w) for w, _ in (p.split(":") for p in pairs.split())}
    want = dict(p.split(":") for p in pairs.split())
    assert got == want


def test_wordpiece():
    m = subword.WordPiece({t: i for i, t in enumerate("[UNK] the cat ##s play ##ing".split())})
    assert m.encode("the cats playing !") == (["the", "cat", "##s", "play", "##ing", "[UNK]"], [1, 2, 3, 4, 5, 0])
    assert m.word("c" * 101) == ["[UNK]"]
    with pytest.raises(ValueError):
        subword.WordPiece({"a": 0})


def test_unigram_prefers_the_likeliest_and_fuses_unknowns():
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -5.0, 1)]
    m = subword.Unigram(tuple(pieces))
    assert m.encode("ab") == (["▁a", "b"], [2, 3])
    assert m.encode("zz a") == (["▁", "zz", "▁a"], [1, 0, 2])
    assert m.encode("") == ([], [])


def test_vocab_txt_line_ends():
    m = V.parse_vocab_txt(b"[UNK]\r\na\n\nb\ra\n")
    assert m.vocab == {"[UNK]": 0, "": 2, "b": 3, "a": 4}
    with pytest.raises(ValueError):
        V.parse_vocab_txt(b"a\n")


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def test_model_file():
    import struct

    def piece(p, s, t):
        return field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + field(3, t))

    blob = piece("<unk>", 0, 2) + piece("▁a", -1, 1)
    m = V.parse_sentencepiece(blob + field(2, field(3, 1)) + field(3, b""))
    assert m.encode("a") == (["▁a"], [1])
    for bad in (blob + field(2, field(3, 2)) + field(3, b""), blob + field(2, b""), blob[:-1]):
        with pytest.raises(ValueError):
            V.parse_sentencepiece(bad)


def test_charsmap_replaces_the_longest_match():
    # a trie of one key 'a' with value 0, and the new text 'bc'
    a = ord("a")
    units = [0] * 300
    units[0] = 1 << 10
    units[1 ^ a] = a | 1 << 8 | ((1 ^ a) ^ 200) << 10
    units[200] = 1 << 31
    trie = b"".join(u.to_bytes(4, "little") for u in units)
    m = subword.CharsMap(len(trie).to_bytes(4, "little") + trie + b"bc\0")
    assert m.normalize("xaé") == "xbcé"
