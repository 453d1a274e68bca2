"""Document features for the quality classifier: one vectorised pass over the bytes of a text."""

from __future__ import annotations

import numpy as np

from lumenrel.llm import _common as c

NAMES = (
    "log_words", "word_length", "symbols", "marks", "digits", "upper", "upper_words", "not_ascii", "dup_lines", "repeats", "distinct", "line_words", "longest_word", "commas", "stops", "spaces",
)

_SYMBOL, _MARK, _STOP = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[list(b"#*$%&|<>@^~\\{}[]=+_")] = True
_MARK[list(b"!?;:")] = True
_STOP[list(b".")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text; texts without words give zeros. Word and line repeats go by 64-bit hashes."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    if not len(data):
        return out
    sizes = np.maximum(np.diff(offsets), 1).astype(float)
    starts, ends, text = c.words_of(data, offsets)

    def each(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])

    words = np.bincount(text, minlength=n)
    some = np.maximum(words, 1).astype(float)
    letters = each((data & 0xC0) != 0x80)  # code points
    spaces = each(c.IS_SPACE[data])
    upper = _UPPER[data]
    lengths = ends - starts
    up = np.diff(np.concatenate(([0], np.cumsum(upper, dtype=np.int64)))[np.column_stack((starts, ends))], axis=1)[:, 0] if len(starts) else np.zeros(0)
    hashes = c.span_hashes(data, starts, ends)
    key = c.mix64(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    distinct = np.bincount(text[order][fresh], minlength=n) if len(key) else np.zeros(n)
    pair = c.mix64(hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7)) if len(key) > 2 else np.zeros(0, np.uint64)
    inside = text[:-2] == text[2:] if len(key) > 2 else np.zeros(0, bool)
    pair = c.mix64(pair[inside] + text[:-2][inside].astype(np.uint64)) if len(pair) else pair
    owner = text[:-2][inside] if len(key) > 2 else np.zeros(0, np.int64)
    po = np.argsort(pair, kind="stable")
    again = np.zeros(len(pair), bool)
    again[1:] = pair[po][1:] == pair[po][:-1]
    repeats = np.bincount(owner[po][again], minlength=n) if len(pair) else np.zeros(n)

    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], breaks + 1)))
    line_start = line_start[line_start < len(data)]
    owner_line = np.searchsorted(offsets, line_start, side="right") - 1
    line_end = np.minimum(np.concatenate((line_start[1:], [len(data)])), offsets[owner_line + 1])
    full = line_end > line_start + 1
    lines = c.mix64(c.span_hashes(data, line_start[full], line_end[full]) + owner_line[full].astype(np.uint64))
    lo = np.argsort(lines, kind="stable")
    same = np.zeros(len(lines), bool)
    same[1:] = lines[lo][1:] == lines[lo][:-1]
    n_lines = np.maximum(np.bincount(owner_line[full], minlength=n), 1).astype(float)
    dup = np.bincount(owner_line[full][lo][same], minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, text, lengths)

    out[:, 0] = np.log1p(words)
    out[:, 1] = (letters - spaces) / some
    out[:, 2] = each(_SYMBOL[data]) / sizes
    out[:, 3] = each(_MARK[data]) / some
    out[:, 4] = each(_DIGIT[data]) / sizes
    out[:, 5] = each(upper) / sizes
    out[:, 6] = np.bincount(text, weights=up * 2 > lengths, minlength=n) / some
    out[:, 7] = each(data >= 0xC0) / np.maximum(letters, 1)
    out[:, 8] = dup / n_lines
    out[:, 9] = repeats / some
    out[:, 10] = distinct / some
    out[:, 11] = np.log1p(words / n_lines)
    out[:, 12] = np.log1p(longest)
    out[:, 13] = each(data == 44) / some
    out[:, 14] = each(_STOP[data]) / some
    out[:, 15] = spaces / sizes
    out[words == 0] = 0
    return out
