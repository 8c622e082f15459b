"""Quality rules: repetition coverage by rolling hashes of several lengths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.common import map_text, text_bytes
from ledgermatch.llm.words import _BASES, _BYTE, grams, mixed, powers, spans_rows, split_words

#: The largest share of word characters in n-grams that occurred before, by n, and in lines that occurred before. A first
#: occurrence is not counted, so that a short text is not lost for one line that stands twice.
MOST_REPEATED = {5: 0.20, 6: 0.20, 7: 0.20, 8: 0.20, 9: 0.20, 10: 0.20}
MOST_LINE_CHARS = 0.20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[cut])


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a key occurs twice or more, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, before


def _covered(w, hashes: np.ndarray, size: int, first: bool) -> np.ndarray:
    """Words inside a run of ``size`` words that is found twice or more in its row, with or without its first occurrence."""
    inside = spans_rows(w, size)
    where = np.flatnonzero(inside)
    mark = np.zeros(len(hashes) + 1, np.int32)
    if len(where):
        salt = mixed(w.doc[where].astype(np.uint64) + np.uint64(1))
        where = where[_repeated(grams(hashes, size)[where] ^ salt)[0 if first else 1]]
        np.add.at(mark, where, 1)
        np.add.at(mark, where + size, -1)
    return np.cumsum(mark)[:-1] > 0


def _measure(column):
    raw, at = text_bytes(column)
    w = split_words(raw, at)
    h = w.hashes()
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    chars = points[w.ends] - points[w.starts]
    # lines: cut at line feeds and at row ends
    feeds = np.flatnonzero(raw == 10)
    begin = np.sort(np.concatenate((at[:-1], feeds + 1)))
    row = np.searchsorted(at[:-1], begin, side="right") - 1
    stop = np.minimum(np.concatenate((begin[1:], at[-1:])), at[1:][row])
    stop = np.where((stop > begin) & (raw[np.maximum(stop - 1, 0)] == 10) if len(raw) else False, stop - 1, stop)
    low, high = np.searchsorted(w.starts, begin), np.searchsorted(w.starts, stop)
    real = (high > low) & (at[row] < at[row + 1])
    begin, stop, row, low, high = begin[real], stop[real], row[real], low[real], high[real]
    up, down = powers(_BASES[2], len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)))
    again = _repeated(mixed((sums[stop] - sums[begin]) * down[begin]) ^ mixed(row.astype(np.uint64) + np.uint64(1)))[1] if len(begin) else np.zeros(0, bool)
    total = np.concatenate(([0], np.cumsum(chars)))
    by_row = np.searchsorted(row, np.arange(len(at)))
    line_chars = _sums(np.where(again, total[high] - total[low], 0), by_row)
    word_chars = _sums(chars, w.first)
    share = lambda part: part / np.maximum(word_chars, 1)
    covers = [share(_sums(np.where(_covered(w, h, n, False), chars, 0), w.first)) for n in MOST_REPEATED]
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[raw])))
    return [np.diff(w.first), word_chars, np.diff(symbols[at]), _sums(again, by_row), _sums(_covered(w, h, 3, True), w.first), share(line_chars), *covers]


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, repetition coverage and verdict of every text; one pass without a shuffle.

    ``cover_n`` is the share of word characters inside runs of n words that occurred before in the text, ``line_cover`` the
    share inside lines equal to an earlier line. ``kept`` is false if the base rule fails (fewer than 50 words, or more
    than half of the words in repeated runs of three) or a share exceeds ``MOST_REPEATED`` or ``MOST_LINE_CHARS``.

    Null or empty texts have no words and fail the base rule. Repeated rows and null ids are rows like any other. Other columns
    are ignored, whatever their names.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["line_cover", *(f"cover_{n}" for n in MOST_REPEATED)]
    fields = [T.StructField(c, T.LongType()) for c in counts] + [T.StructField(c, T.DoubleType()) for c in shares]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = map_text(rows, "_text", lambda: _measure, fields).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    fine = F.col("line_cover") <= MOST_LINE_CHARS
    for n, most in MOST_REPEATED.items():
        fine &= F.col(f"cover_{n}") <= most
    return out.withColumn("kept", ~F.col("base_failed") & fine).withColumnRenamed("_id", id_col)
