"""Loaders of tokenizer files. Files are read through Spark, so any store that Spark reads will do,
and checked against limits before they are parsed."""

from __future__ import annotations

import json
import re
import struct
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..functions.subword import CONTROL, META, NORMAL, UNKNOWN, CharsMap, Unigram, WordPiece


@dataclass(frozen=True)
class Limits:
    vocabulary: int = 1_000_000
    token_length: int = 1024
    json_depth: int = 32
    file_bytes: int = 256 << 20
    array: int = 1_000_000

    def check(self, tokens) -> None:
        if len(tokens) > self.vocabulary:
            raise ValueError(f"{len(tokens)} tokens are over the limit of {self.vocabulary}")
        if any(len(t) > self.token_length for t in tokens):
            raise ValueError(f"a token is over the limit of {self.token_length} characters")


def read_file(spark: SparkSession, path: str, limits: Limits = Limits()) -> bytes:
    files = spark.read.format("binaryFile").load(path)
    size = files.select("length").first()
    if size is None:
        raise FileNotFoundError(path)
    if size[0] > limits.file_bytes:
        raise ValueError(f"{path} has {size[0]} bytes, over the limit of {limits.file_bytes}")
    return bytes(files.select("content").first()[0])


def parse_vocab_txt(data: bytes, unk: str = "[UNK]", lowercase: bool = False, limits: Limits = Limits()) -> WordPiece:
    """A token a line, its number the id. Line ends are \\n, \\r\\n or \\r; an empty line is a token;
    of equal tokens the last one's id stays."""
    lines = re.split("\r\n|\n|\r", data.decode("utf-8-sig"))
    if lines and lines[-1] == "":
        lines.pop()
    limits.check(lines)
    return WordPiece({t: i for i, t in enumerate(lines)}, unk, lowercase=lowercase)


def vocab_txt(spark: SparkSession, path: str, unk: str = "[UNK]", lowercase: bool = False, limits: Limits = Limits()) -> WordPiece:
    return parse_vocab_txt(read_file(spark, path, limits), unk, lowercase, limits)


def _spec(data: bytes, kind: str, limits: Limits) -> dict:
    spec = json.loads(data)
    if not isinstance(spec, dict):
        raise ValueError("the file is no JSON object")

    def depth(x, d=0):
        if d > limits.json_depth:
            raise ValueError("the JSON is nested too deeply")
        for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            depth(v, d + 1)

    depth(spec)
    if spec.get("model", {}).get("type") != kind:
        raise ValueError(f"the file declares a {spec.get('model', {}).get('type')!r} model, not {kind}")
    for section in ("truncation", "padding", "post_processor"):
        if spec.get(section) is not None:
            raise ValueError(f"the file's {section} isn't reproduced")
    return spec


def _only(spec: dict | None, allowed: dict, what: str) -> None:
    """Refuses a part of the pipeline with settings beyond the allowed ones."""
    for k, v in (spec or {}).items():
        if k != "type" and (k not in allowed or v not in allowed[k]):
            raise ValueError(f"the {what} {spec.get('type')} with {k} = {v!r} isn't reproduced")


def _lowercases(normalizer: dict | None) -> bool:
    if normalizer is None:
        return False
    kind = normalizer.get("type")
    if kind == "Lowercase":
        return True
    if kind == "Sequence" and "normalizers" in normalizer:
        return any([_lowercases(n) for n in normalizer["normalizers"]])
    if kind == "BertNormalizer":
        # accents go with lower case unless told otherwise
        plain = {"clean_text": [False], "handle_chinese_chars": [False], "strip_accents": [False, None], "lowercase": [True, False]}
        _only(normalizer, plain, "normalizer")
        lower = normalizer.get("lowercase", True)
        if lower and normalizer.get("strip_accents") is None or "clean_text" not in normalizer or "handle_chinese_chars" not in normalizer:
            raise ValueError("the BertNormalizer's defaults aren't reproduced")
        return lower
    raise ValueError(f"the normalizer {kind} isn't reproduced")


def parse_wordpiece_json(data: bytes, limits: Limits = Limits()) -> WordPiece:
    spec = _spec(data, "WordPiece", limits)
    model, pre = spec["model"], spec.get("pre_tokenizer")
    if (pre or {}).get("type") != "Whitespace":
        raise ValueError(f"the pre_tokenizer {(pre or {}).get('type')} isn't reproduced")
    vocab = model["vocab"]
    if not vocab or not all(isinstance(i, int) for i in vocab.values()):
        raise ValueError("the vocabulary is empty or has ids that aren't whole numbers")
    for t in spec.get("added_tokens") or []:
        if vocab.get(t["content"]) != t["id"]:
            raise ValueError(f"the added token {t['content']} isn't in the vocabulary")
    limits.check(vocab)
    return WordPiece(dict(vocab), model["unk_token"], model.get("continuing_subword_prefix", "##"), _lowercases(spec.get("normalizer")), model.get("max_input_chars_per_word", 100))


def wordpiece_json(spark: SparkSession, path: str, limits: Limits = Limits()) -> WordPiece:
    return parse_wordpiece_json(read_file(spark, path, limits), limits)


def parse_unigram_json(data: bytes, limits: Limits = Limits()) -> Unigram:
    spec = _spec(data, "Unigram", limits)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is not None or model.get("byte_fallback"):
        raise ValueError("normalizers and byte fallback aren't reproduced")
    if pre.get("type") != "Metaspace":
        raise ValueError(f"the pre_tokenizer {pre.get('type')} isn't reproduced")
    _only(pre, {"replacement": [META], "prepend_scheme": ["always"], "add_prefix_space": [True], "split": [True]}, "pre_tokenizer")
    unk, added = model.get("unk_id"), {t["id"]: t for t in spec.get("added_tokens") or []}
    rows = model["vocab"]
    if not rows or unk is None:
        raise ValueError("the vocabulary is empty or names no unknown piece")
    kinds = [UNKNOWN if i == unk else CONTROL if added.get(i, {}).get("special") else NORMAL for i in range(len(rows))]
    limits.check([p for p, _ in rows])
    return Unigram(tuple((p, float(s), k) for (p, s), k in zip(rows, kinds, strict=True)), unk)


def unigram_json(spark: SparkSession, path: str, limits: Limits = Limits()) -> Unigram:
    return parse_unigram_json(read_file(spark, path, limits), limits)


# ---------------------------------------------------------------- model files in wire format


def wire(data: bytes):
    """(field, value) of a protobuf message; nested messages and strings are bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ValueError("the message is cut short")
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or (varint() if kind == 2 else None)
        if size is None or at + size > len(data):
            raise ValueError("the message is cut short or of an unknown form")
        yield tag >> 3, data[at : at + size]
        at += size


def parse_sentencepiece(data: bytes, limits: Limits = Limits()) -> Unigram:
    """A unigram model file: pieces (field 1), trainer (2) and normalizer (3) settings."""
    pieces, trainer, normalizer = [], {}, None
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    for number, value in wire(data):
        if number == 1:
            p = dict(wire(value))
            pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p.get(2, b"\0" * 4))[0], p.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(wire(value))
        elif number == 3:
            normalizer = dict(wire(value))
    if trainer.get(3, 1) != 1:
        raise ValueError("the model isn't a unigram model")
    if trainer.get(35, 0):
        raise ValueError("byte fallback isn't reproduced")
    if normalizer is None or not all(normalizer.get(f, 1) for f in (3, 4, 5)):
        raise ValueError("the normalizer must prefix a space, remove extra ones and escape them")
    limits.check([p for p, _, _ in pieces])
    ids = [signed(trainer.get(f, d)) for f, d in ((40, 0), (41, 1), (42, 2), (43, (1 << 64) - 1))]
    return Unigram(tuple(pieces), *ids, charsmap=CharsMap(normalizer.get(2, b"")))


def sentencepiece(spark: SparkSession, path: str, limits: Limits = Limits()) -> Unigram:
    return parse_sentencepiece(read_file(spark, path, limits), limits)
