"""Jaro-Winkler similarity, and the fuzzy score of a title, over whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _letters(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points by row, padded with zeros, and the rows' lengths."""
    size = np.array([len(s) for s in strings], dtype=np.int64)
    out = np.zeros((len(strings), int(size.max(initial=0))), dtype=np.uint32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def _in_order(letters: np.ndarray, matched: np.ndarray, most: int) -> np.ndarray:
    """The matched letters of each row, moved to the left."""
    out = np.zeros((len(letters), most), dtype=np.uint32)
    row, column = np.nonzero(matched)
    out[row, (np.cumsum(matched, axis=1) - 1)[row, column]] = letters[row, column]
    return out


def jaro_all(strings: list[str], word: str) -> np.ndarray:
    """The Jaro similarity of each string with a word, letter by letter for all strings together."""
    a, n = _letters(strings)
    b = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(b) or not len(a):
        return np.zeros(len(strings))
    reach = np.maximum(np.maximum(n, len(b)) // 2 - 1, 0)
    place = np.arange(len(b))
    taken = np.zeros((len(a), len(b)), dtype=bool)
    found = np.zeros(a.shape, dtype=bool)
    for i in range(a.shape[1]):
        free = (b == a[:, i, None]) & ~taken & (np.abs(place - i) <= reach[:, None])
        free[i >= n] = False
        hit = np.flatnonzero(free.any(axis=1))
        taken[hit, free[hit].argmax(axis=1)] = True
        found[hit, i] = True
    m = found.sum(axis=1)
    most = int(m.max(initial=0))
    same = np.broadcast_to(b, taken.shape)
    swaps = (_in_order(a, found, most) != _in_order(same, taken, most)).sum(axis=1) // 2
    some = np.maximum(m, 1)
    return np.where(m > 0, (m / np.maximum(n, 1) + m / len(b) + (m - swaps) / some) / 3, 0.0)


def jaro(a: str, b: str) -> float:
    return float(jaro_all([a], b)[0])


def jaro_winkler_all(strings: list[str], word: str) -> np.ndarray:
    """Jaro similarity with Winkler's bonus of 0.1 for each of up to 4 common first letters, above 0.7."""
    s = jaro_all(strings, word)
    common = np.array([next((i for i, (x, y) in enumerate(zip(t[:4], word[:4], strict=False)) if x != y), min(len(t), len(word), 4)) for t in strings], dtype=np.int64)
    return np.where(s > 0.7, s + common * 0.1 * (1 - s), s)


def jaro_winkler(a: str, b: str) -> float:
    return float(jaro_winkler_all([a], b)[0])


def title_similarities(titles: list[str], words: list[list[str]]) -> np.ndarray:
    """How close normalised titles are to the words of a query, each with its spellings.

    The best of: whole against whole, both without spaces, and the weakest word's best match
    among the title's words. Words of under four letters match exactly or not at all.
    """
    flat = [t.strip() for t in titles]
    parts = [t.split(" ") for t in flat]
    codes, tokens = pd.factorize(np.array([p for own in parts for p in own], dtype=object))
    begin = np.concatenate(([0], np.cumsum([len(p) for p in parts])))[:-1].astype(np.int64)
    tokens = list(tokens)

    def best(word: str) -> np.ndarray:
        near = np.array([float(t == word) for t in tokens]) if len(word) < 4 else jaro_winkler_all(tokens, word)
        return np.maximum.reduceat(near[codes], begin)

    if not titles:
        return np.zeros(0)
    typed = [w[0] for w in words]
    token = np.minimum.reduce([np.maximum.reduce([best(s) for s in spellings]) for spellings in words])
    packed = jaro_winkler_all([t.replace(" ", "") for t in flat], "".join(typed))
    return np.maximum.reduce([jaro_winkler_all(flat, " ".join(typed)), packed, token])


def title_similarity(title: str, words: list[list[str]]) -> float:
    return float(title_similarities([title], words)[0])


def similarity_to(words: list[list[str]]):
    """A function of a title column. Titles repeat, so each distinct one of a batch is scored once.

    It is marked nondeterministic so that a filter on it and its projection share one evaluation.
    """

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for titles in batches:
            codes, distinct = pd.factorize(titles)
            yield pd.Series(title_similarities(list(distinct), words)[codes])

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double").asNondeterministic()
