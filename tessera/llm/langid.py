"""Operator 2: language identification by compression.

For each language a zstandard raw-content dictionary is made from training texts.  A text is cut into blocks,
each block is compressed with every dictionary, and the language whose blocks come out smallest in total wins;
a narrow margin to the next language rejects the text.

Training rows are labelled rows outside the held-out fold.  The dictionaries hold a documented, bounded sample
of them (``DICTIONARY_BYTES`` for each of at most ``MAX_LANGUAGES`` languages); predictions use the text alone
and read all of it.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is rejected; ties go to the
alphabetically first language; a single learned language wins with score 1 where there is any letter; without
training rows everything is ``und``; repeated rows are judged each on their own; an empty table gives an empty table;
very long texts are read whole, block by block; further columns are kept by ``keep_known`` and not read by ``identify``.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold, in_pieces, spread

#: Bytes of training text in each language's dictionary.
DICTIONARY_BYTES = 64 * 1024
#: Training texts drawn for each language, on average; enough to fill the dictionary with room to spare.
SAMPLE_ROWS = 300
#: Characters of one drawn text that may enter the dictionary, so that no single text fills it.
SHARE_CHARS = 1_500
#: All labels are learned; with more than this their dictionaries would be over 32 MiB, and an error is raised.
MAX_LANGUAGES = 512
#: Characters compressed at a time.
BLOCK_CHARS = 1_200
#: zstandard's level: the lower ones look for long matches only and miss most of the dictionary.
LEVEL = 6
#: Rejected below this relative margin between the best and the next language.
MIN_MARGIN = 0.004
#: Relative margin at which the score is 0.88.
SCALE = 0.03

LETTER = regex.compile(r"\p{L}")
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The text in lower case with one space for each run of anything but letters, as these tell no language."""
    return OTHER.sub(" ", text.lower())


def training_texts(docs: DataFrame, held_out: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict[str, list[str]]:
    """A bounded sample of training texts by language, the same for the same rows.

    Rows are drawn by a hash of id and text with a rate that gives about ``SAMPLE_ROWS`` rows of each language, whatever
    the size of the table and however often an id is repeated; equal rows count once.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"), held_out.alias("out"))
    rows = rows.where(~F.col("out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages; raise MAX_LANGUAGES if each worker can hold {DICTIONARY_BYTES} bytes of each")
    if not counts:
        return {}
    space = 1 << 40
    rate = F.lit(0).cast("long")
    for r in counts:
        rate = F.when(F.col("lang") == r["lang"], F.lit(min(space, math.ceil(space * SAMPLE_ROWS / r["count"])))).otherwise(rate)
    drawn = rows.withColumn("draw", F.pmod(F.xxhash64("id", "text"), F.lit(space))).where(F.col("draw") < rate)
    # texts longer than the share give a window that the hash places: the dictionary needs no whole texts
    start = F.pmod(F.xxhash64("id", F.lit(7)), F.greatest(F.length("text") - SHARE_CHARS, F.lit(1))) + 1
    drawn = drawn.select("lang", "draw", F.expr("id").cast("string").alias("id"), F.col("text").substr(start.cast("int"), F.lit(SHARE_CHARS)).alias("text"))
    texts = defaultdict(list)
    # repeated rows share a draw: one of them comes
    for r in sorted(drawn.distinct().collect(), key=lambda r: (r["lang"], r["draw"], r["id"] or "", r["text"])):
        texts[r["lang"]].append(r["text"])
    return dict(texts)


def dictionaries(texts: dict[str, list[str]]) -> dict[str, bytes]:
    """Raw dictionary content by language."""
    return {lang: b"\n".join(letters(t).encode("utf-8", "replace") for t in found)[:DICTIONARY_BYTES] for lang, found in sorted(texts.items())}


@functools.lru_cache(maxsize=2)
def _compressors(content: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    found = []
    for lang, raw in content:
        data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        found.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return found


def blocks(text: str) -> list[bytes]:
    """The whole text in blocks of ``BLOCK_CHARS`` characters."""
    return [text[i : i + BLOCK_CHARS].encode("utf-8", "replace") for i in range(0, len(text), BLOCK_CHARS)]


def classify(text: str | None, compressors: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, float]:
    """The language, a score from 0 to 1, and the relative margin to the next language."""
    if not text or not compressors or LETTER.search(text) is None:
        return "und", 0.0, 0.0
    parts = blocks(letters(text))
    sizes = sorted((sum(len(c.compress(b)) for b in parts), lang) for lang, c in compressors)
    if len(sizes) == 1:
        return sizes[0][1], 1.0, 1.0
    margin = (sizes[1][0] - sizes[0][0]) / max(sizes[1][0], 1)
    return sizes[0][1], 1 / (1 + math.exp(-2 * margin / SCALE)), margin


def identify(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score``, ``margin`` and ``rejected`` for every row."""
    known = tuple(sorted(content.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(known)
        for batch in batches:
            found = [classify(t.as_py(), compressors) for t in batch.column(1)]
            lang, score, margin = (list(x) for x in zip(*found)) if found else ([], [], [])
            columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([m < MIN_MARGIN or v == "und" for m, v in zip(margin, lang)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "lang_pred", "score", "margin", "rejected"])

    source = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    out = source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, lang_pred string, score double, margin double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, content: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns, in one pass."""
    known = tuple(sorted(content.items()))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(known)
        for batch in in_pieces(batches, at):
            found = (classify(t.as_py(), compressors) for t in batch.column(at))
            yield batch.filter(pa.array([lang != "und" and margin >= MIN_MARGIN for lang, _, margin in found], pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)


def train(docs: DataFrame, held_out: Column | None = None) -> dict[str, bytes]:
    """Dictionary content by language from the rows outside ``held_out`` (by default, fold 0 of 5)."""
    return dictionaries(training_texts(docs, fold("doc_id") == 0 if held_out is None else held_out))
