"""Operator 5: quality rules by repetition coverage.

Word sequences of several lengths get rolling polynomial hashes in numpy; every character of a word that lies in
a sequence met twice or more in the text counts as covered, and so does every character of a line equal to an
earlier one.  A text is rejected when the covered share is too large for a length, when lines repeat too much,
when symbols stand for words, or when the plain base rules fail.

Defined results: a null, empty or wordless text has zero counts and fails the base rules; very long texts are
processed whole in memory that grows with their words; repeated rows are judged each on their own; an empty
table gives an empty table; ``keep_good`` keeps all columns and ``judge`` reads only the id and the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import in_pieces, spread

#: The window of ``n_repeat_words``.
REPEAT_WINDOW = 5
#: Base rules.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Rejected when a larger share of the words' characters lies in repeated sequences of this many words.
#: Short sequences also repeat by chance, so they may cover more.  All limits lie below what the base rule rejects (a
#: fifth of the words in repeated sequences of five); of documents labelled good that pass it, 0.5 % are above one.
MAX_COVERED = {2: 0.16, 3: 0.15, 5: 0.13, 7: 0.12, 10: 0.05}
#: Rejected when a larger share of the lines, or of the characters, are in lines equal to an earlier one.
MAX_DUPLICATE_LINE_SHARE = 0.50
MAX_DUPLICATE_LINE_CHARS = 0.30
#: Rejected when symbols are more than this many times the words.
MAX_SYMBOLS_PER_WORD = 0.10
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: An odd multiplier for the rolling hashes, and two for mixing word numbers.
BASE, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Columns of ``judge`` after the id.
COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "covered": "double", "dup_line_chars": "double", "reason": "string"}


def mixed(numbers: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hashes of small numbers."""
    x = (numbers + np.uint64(1)) * BASE
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """The polynomial hash of every window of ``size`` words, modulo 2^64."""
    out = hashes[: len(hashes) - size + 1].copy()
    for i in range(1, size):
        out *= BASE
        out += hashes[i : len(hashes) - size + 1 + i]
    return out


def repeated(hashes: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a window of ``size`` words found twice or more."""
    n = len(hashes)
    if n <= size:
        return np.zeros(n, bool)
    windows = rolling(hashes, size)
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(n, bool)
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.searchsorted(twice, windows)
    starts = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == windows)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change[:n]) > 0


def measure(text: str | None) -> tuple:
    """The values of ``COLUMNS`` for one text."""
    text = text or ""
    found = WORD.findall(text)
    n = len(found)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dup_lines = dup_chars = line_count = 0
    seen: set[str] = set()
    for line in lines if len(lines) > 1 else ():
        if line.strip(SPACES):
            line_count += 1
            if line in seen:
                dup_lines += 1
                dup_chars += len(line)
            else:
                seen.add(line)
    numbers: dict[str, int] = {}
    fresh = count()
    hashes = mixed(np.fromiter((numbers[w] if w in numbers else numbers.setdefault(w, next(fresh)) for w in found), np.uint64, n))
    sizes = np.fromiter(map(len, found), np.int64, n)
    covers = {k: repeated(hashes, k) for k in {*MAX_COVERED, REPEAT_WINDOW}} if len(numbers) < n else {}
    repeat_words = int(covers[REPEAT_WINDOW].sum()) if covers else 0
    shares = {k: float(sizes[covers[k]].sum()) / word_chars if covers and word_chars else 0.0 for k in MAX_COVERED}
    base_failed = n < MIN_WORDS or 100 * repeat_words > MAX_REPEAT_PERCENT * n
    line_chars = dup_chars / max(len(text), 1)
    reason = (
        "base" if base_failed
        else "symbols" if symbols > MAX_SYMBOLS_PER_WORD * n
        else "lines" if dup_lines > MAX_DUPLICATE_LINE_SHARE * line_count or line_chars > MAX_DUPLICATE_LINE_CHARS
        else next((f"coverage_{k}" for k, most in MAX_COVERED.items() if shares[k] > most), None)
    )
    return n, word_chars, symbols, dup_lines, repeat_words, base_failed, reason is None, shares[REPEAT_WINDOW], line_chars, reason


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``COLUMNS`` of every row, in one pass without a shuffle."""
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(measure(t.as_py()) for t in batch.column(1)))) or [[]] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds[k]) for v, k in zip(found, COLUMNS.values()))], names=["id", *COLUMNS])

    source = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    out = source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, " + ", ".join(f"{c} {k}" for c, k in COLUMNS.items()))
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    at, verdict = docs.columns.index(text_col), list(COLUMNS).index("kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, at):
            yield batch.filter(pa.array([measure(t.as_py())[verdict] for t in batch.column(at)], pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)
