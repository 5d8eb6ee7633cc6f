"""Counts over whole texts, many documents at a time."""

from __future__ import annotations

import numpy as np

from .common import WordHashes, mixed, window_hashes

NAMES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper",
    "n_digits", "n_punct", "n_bang", "n_chars", "n_repeat_words_3", "n_capital_words", "n_breaks", "longest_word",
]
WINDOW = 8

_SPACE, _SYMBOL, _UPPER, _DIGIT, _PUNCT, _BANG, _CHAR, _BREAK = (1 << k for k in range(8))


def _classes() -> np.ndarray:
    """A bit mask of classes for every byte value."""
    out = np.zeros(256, np.uint8)
    for chars, bit in ((b" \t\n\x0b\x0c\r", _SPACE), (b"#*$%&|<>", _SYMBOL), (bytes(range(65, 91)), _UPPER), (bytes(range(48, 58)), _DIGIT), (b".,;:?'\"()-_/", _PUNCT), (b"!", _BANG), (b"\n", _BREAK)):
        out[list(chars)] |= bit
    out[[b for b in range(256) if b & 0xC0 != 0x80]] |= _CHAR
    return out


CLASSES = _classes()


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(words: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Words per document inside runs of ``width`` words that the document has twice or more."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    runs = window_hashes(words, width)
    if not len(runs):
        return np.zeros(len(bounds) - 1, np.int64)
    whole = rows[: len(runs)] == rows[width - 1 :]
    at = np.flatnonzero(whole)
    keys = mixed(runs[at] + mixed(rows[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    starts = at[twice]
    for k in range(width):
        covered[starts + k] = True
    return _per_row(covered, bounds)


def statistics(blobs: list[bytes | None], hashes: WordHashes) -> np.ndarray:
    """One row of NAMES for each UTF-8 text; null counts as empty."""
    blobs = [b or b"" for b in blobs]
    n = len(blobs)
    ends = np.concatenate([[0], np.cumsum([len(b) for b in blobs], dtype=np.int64)])
    joined = np.frombuffer(b"".join(blobs), np.uint8)
    kinds = CLASSES[joined]
    count = lambda bit: _per_row((kinds & bit) != 0, ends)

    words: list[bytes] = []
    counts = np.zeros(n, np.int64)
    distinct, lines, twin_lines, longest, capital = (np.zeros(n, np.int64) for _ in range(5))
    for i, blob in enumerate(blobs):
        own = blob.split()
        counts[i] = len(own)
        if own:
            distinct[i] = len(set(own))
            longest[i] = max(map(len, own))
            capital[i] = sum(map(bytes.isupper, own))
            full = [x for x in blob.split(b"\n") if x.strip()]
            lines[i], twin_lines[i] = len(full), len(full) - len(set(full))
            words += own
    bounds = np.concatenate([[0], np.cumsum(counts)])
    hashed = hashes(words)
    chars, spaces = count(_CHAR), count(_SPACE)
    columns = {
        "n_words": counts, "word_chars": chars - spaces, "n_symbols": count(_SYMBOL), "n_dup_lines": twin_lines,
        "n_repeat_words": _repeated(hashed, bounds, WINDOW), "n_lines": lines, "n_distinct_words": distinct, "n_upper": count(_UPPER),
        "n_digits": count(_DIGIT), "n_punct": count(_PUNCT), "n_bang": count(_BANG), "n_chars": chars,
        "n_repeat_words_3": _repeated(hashed, bounds, 3), "n_capital_words": capital, "n_breaks": count(_BREAK), "longest_word": longest,
    }
    return np.stack([columns[k] for k in NAMES], axis=1)


#: What models see: ratios, so that long and short texts compare, and three sizes on a log scale.
RATIOS = [
    "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "repeat_share_3", "upper_share", "digit_share", "punct_share",
    "bang_share", "distinct_share", "capital_share", "words_per_line", "log_words", "log_lines", "log_longest_word",
]


def ratios(counts: np.ndarray) -> np.ndarray:
    c = {k: counts[:, i].astype(np.float64) for i, k in enumerate(NAMES)}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    columns = [
        c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_repeat_words_3"] / words,
        c["n_upper"] / chars, c["n_digits"] / chars, c["n_punct"] / words, c["n_bang"] / words, c["n_distinct_words"] / words,
        c["n_capital_words"] / words, np.log1p(c["n_words"] / lines), np.log1p(c["n_words"]), np.log1p(c["n_lines"]), np.log1p(c["longest_word"]),
    ]
    return np.stack(columns, axis=1)
