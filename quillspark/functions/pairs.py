"""Arrow-batched kernels as column functions; every distinct input of a batch is computed once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels as K
from . import stem as S


def _pair(kernel: Callable, kind: str, utf16: bool = False) -> Callable[..., Column]:
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict = {}

        def one(x, y):
            if x is None or y is None:
                return None
            if (x, y) not in memo:
                memo[x, y] = kernel(K.utf16(x), K.utf16(y)) if utf16 else kernel(x, y)
            return memo[x, y]

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run


def _single(kernel: Callable, kind: str = "string") -> Callable[..., Column]:
    @F.pandas_udf(kind)
    def run(a: pd.Series) -> pd.Series:
        memo = {x: kernel(x) for x in a.unique() if x is not None}
        return a.map(memo)

    return run


def distance_functions(utf16: bool = False) -> dict[str, Callable[..., Column]]:
    """name -> function of two text columns. Null in, null out. utf16 counts UTF-16 units."""
    ints = {"lcs_length": K.lcs_length, "substring_length": K.substring_length, "osa": K.osa, "damerau": K.damerau, "indel": lambda a, b: len(a) + len(b) - 2 * K.lcs_length(a, b)}
    doubles = {"jaro": K.jaro, "jaro_winkler": K.jaro_winkler, "ratcliff": K.ratcliff, "indel_similarity": K.indel_similarity}
    return {n: _pair(f, "int", utf16) for n, f in ints.items()} | {n: _pair(f, "double", utf16) for n, f in doubles.items()}


def jaro_winkler(weight: float) -> Callable[..., Column]:
    return _pair(lambda a, b: K.jaro_winkler(a, b, weight), "double")


_NAMES = ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "partial_token_sort_ratio", "partial_token_set_ratio", "wratio")


def fuzzy_functions() -> dict[str, Callable[..., Column]]:
    """name -> function of two text columns, 0 to 100."""
    return {n: _pair(getattr(K, n), "double") for n in _NAMES}


def phonetic_functions() -> dict[str, Callable[..., Column]]:
    return {"metaphone": _single(K.metaphone), "nysiis": _single(K.nysiis)}


def stemmer(language: str) -> Callable[..., Column]:
    """porter, en, fr, de, it, pt or es."""
    return _single(S.STEMMERS[language])


def murmur3() -> Callable[..., Column]:
    return _single(K.murmur3, "int")


def hashed_cells(id_col: str, n_features: int, alternate_sign: bool = True, binary: bool = False) -> Callable:
    """For mapInArrow on (id, terms array): (id, col, n), the signed number of terms in each hashed
    column of each row. Each distinct term of a batch is hashed once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            terms = batch.column(1).fill_null([])
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(terms.offsets)))
            words = terms.flatten().dictionary_encode()
            code = np.asarray(words.indices, dtype=np.int64)
            if binary:
                row, code = (x.astype(np.int64) for x in np.unique(np.stack([row, code]), axis=1))
            h = K.murmur3_many(words.dictionary.to_pylist()).astype(np.int64)
            sign = np.where((h < 0) & alternate_sign, -1.0, 1.0)
            cell, at = np.unique(row * n_features + (np.abs(h) % n_features)[code], return_inverse=True)
            n = np.bincount(at, sign[code], len(cell))
            ids = batch.column(0).take(pa.array(cell // n_features))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cell % n_features), pa.array(n)], names=[id_col, "col", "n"])

    return run
