"""Statistics of whole documents, computed batch by batch.

Shared by the quality rules and the weak labellers.  A word is a run of
characters other than the ASCII white space; null has no words.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

#: Column, Spark type.
COLUMNS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "n_lines": "long",
    "n_upper": "long",
    "n_digits": "long",
    "n_stops": "long",
    "n_bangs": "long",
    "n_pipes": "long",
    "n_distinct": "long",
}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())


def _byte_set(members: bytes) -> np.ndarray:
    flags = np.zeros(256, dtype=np.int64)
    flags[list(members)] = 1
    return flags


#: Rows of byte classes, so that one product with a byte histogram counts all.
_CLASSES = np.stack(
    [
        _byte_set(bytes(b for b in range(256) if not 0x80 <= b < 0xC0 and b not in SPACES)),
        _byte_set(SYMBOLS),
        _byte_set(bytes(range(0x41, 0x5B))),
        _byte_set(bytes(range(0x30, 0x3A))),
        _byte_set(b".?"),
        _byte_set(b"!"),
        _byte_set(b"|"),
    ]
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    for step, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * np.uint64(odd) + h[step:]
    order = np.sort(h)
    if not (order[1:] == order[:-1]).any():
        return 0
    ids: dict[bytes, int] = {}
    rows = np.lib.stride_tricks.sliding_window_view(np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int32), WINDOW)
    keys = np.ascontiguousarray(rows).view([("", np.void, WINDOW * 4)]).ravel()
    _, inverse, counts = np.unique(keys["f0"], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse.ravel()] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(lines: list[bytes]) -> int:
    """Lines with a word that equal an earlier line."""
    if len(set(lines)) == len(lines):
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.split(None, 1))


def document_stats(texts: list[str | None]) -> pd.DataFrame:
    """One row of statistics for each text."""
    rows = np.zeros((len(texts), len(COLUMNS)), dtype=np.int64)
    for row, text in zip(rows, texts, strict=True):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        words, lines = data.split(), data.split(b"\n")
        chars, symbols, upper, digits, stops, bangs, pipes = _CLASSES @ np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
        row[:] = (len(words), chars, symbols, duplicate_lines(lines), repeated_words(words), len(lines), upper, digits, stops, bangs, pipes, len(set(words)))
    return pd.DataFrame(rows, columns=list(COLUMNS))


def document_stats_udf():
    """A column function that gives ``SCHEMA`` as a struct."""

    @F.pandas_udf(SCHEMA)
    def stats(texts: pd.Series) -> pd.DataFrame:
        return document_stats(texts.tolist())

    return stats


def ratio_features(stats: pd.DataFrame) -> np.ndarray:
    """Scale-free features of the statistics, one column each of ``FEATURES``."""
    s = {c: stats[c].to_numpy(dtype=np.float64) for c in COLUMNS}
    words, chars, lines = (np.maximum(s[c], 1) for c in ("n_words", "word_chars", "n_lines"))
    return np.column_stack(
        [
            np.log1p(s["n_words"]),
            s["word_chars"] / words,
            s["n_symbols"] / words,
            s["n_dup_lines"] / lines,
            s["n_repeat_words"] / words,
            s["n_upper"] / chars,
            s["n_digits"] / chars,
            s["n_stops"] / words,
            s["n_bangs"] / words,
            s["n_pipes"] / words,
            s["n_distinct"] / words,
            s["n_words"] / lines,
        ]
    )


FEATURES = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "stop_rate", "bang_rate", "pipe_rate", "distinct_rate", "line_length")
