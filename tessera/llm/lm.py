"""Operator 6: language-model scores of whole documents by a gated recurrent model.

Training documents are counted word by word over the whole corpus.  The most frequent words form the vocabulary
of the recurrent model (``gru``); all other words fall in ``TAILS`` kinds by a hash of their last letters, which the
model predicts like words.  The model is trained on all training documents: these are dealt to ``ROUNDS`` rounds and
to independent trainers in each, whose weights are averaged after the round and start the next.  A word outside the
vocabulary is scored as its kind times its share of the kind's unigram mass (with one unseen word in each kind), so
the score is a proper log-likelihood of the complete document.

Word counts are looked up in two ways: words frequent enough to be among ``HEAD_WORDS`` go to every worker (a
bounded table), the others are joined.

Defined results: a null or wordless text has one token, its end; words are compared by bytes with A-Z lowered;
of words that are equally frequent the lesser in bytes comes first, also at the edge of the vocabulary; repeated
rows are scored each on their own; a null id counts as not held out; without training documents all counts are zero
and the model is the uniform start; very long texts keep one state throughout; an empty table gives an empty table;
only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import gru
from tessera.llm.common import delete, fold, materialize, spread

#: Words whose counts go to every worker, at most.
HEAD_WORDS = 1 << 18
#: Bytes of texts that are split into words at a time, about (a longer text is split on its own).
SLICE_BYTES = 16 << 20
#: Parts of the training documents; the trainers' weights are averaged after each.
ROUNDS = 3
#: Bytes of symbols that one trainer reads, about.
TRAINER_BYTES = 8_000_000
#: Pieces in which models are averaged.
PIECES = 64
#: Kinds of words outside the vocabulary, and the last bytes that tell them.
TAILS, TAIL_BYTES = 1023, 3
#: Symbols before they are put in order of frequency: the end, the kinds, then the vocabulary.
END, FIRST = 0, 1 + TAILS


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of about ``SLICE_BYTES``; null texts become empty."""
    texts = pc.fill_null(texts, "")
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for i, j in zip(at, at[1:]):
        if i < j:
            yield texts.slice(i, j - i)


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and the place of each word's text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    found = lists.flatten()
    real = pc.not_equal(found, "")
    return found.filter(real), owner[real.to_numpy(zero_copy_only=False)]


def count_words(rows: DataFrame) -> DataFrame:
    """``word`` and ``c`` over the texts of ``rows``; the null word counts the texts themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                counts = flat_words(part)[0].value_counts()
                own = pa.concat_arrays([counts.field(0).cast(pa.binary()), pa.nulls(1, pa.binary())])
                yield pa.RecordBatch.from_arrays([own, pa.concat_arrays([counts.field(1), pa.array([len(part)], pa.int64())])], names=["word", "n"])

    return spread(rows.select("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def head(counts: DataFrame) -> tuple[list[bytes], np.ndarray, int]:
    """The most frequent words with their counts, most frequent first, and the least count among them.

    All words with at least that count are in; the count is the least for which they are ``HEAD_WORDS`` or fewer.
    """
    step = F.when(F.col("c") <= 256, F.col("c")).otherwise(256 + F.floor(F.log2(F.col("c") / 256) * 8)).cast("long")
    steps = counts.where("word is not null").groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("low")).orderBy(F.desc("step")).collect()
    least, total = 0, 0
    for s in steps:
        total += s["n"]
        if total > HEAD_WORDS:
            break
        least = s["low"]
    if not least:
        return [], np.empty(0, np.int64), 1 << 62
    table = counts.where((F.col("c") >= least) & F.col("word").isNotNull()).toArrow()
    found, c = table.column("word").to_pylist(), table.column("c").to_numpy()
    order = sorted(range(len(found)), key=lambda i: (-c[i], found[i]))
    return [found[i] for i in order], c[order], least


def kind_of(word: bytes) -> int:
    """The kind of a word outside the vocabulary, from 1."""
    return 1 + zlib.crc32(word[-TAIL_BYTES:]) % TAILS


def kinds_of(found: pa.Array) -> np.ndarray:
    """The kinds of many words; each distinct ending is hashed once."""
    endings = pc.binary_slice(found.cast(pa.binary()), -TAIL_BYTES).dictionary_encode()
    return np.array([*map(kind_of, endings.dictionary.to_pylist())], np.int64)[endings.indices.to_numpy()]


def kind_sums(counts: DataFrame) -> np.ndarray:
    """By kind, the number of words and of their tokens, those of the vocabulary included: a (``FIRST``, 2) array."""
    kind = F.crc32(F.substring("word", -TAIL_BYTES, TAIL_BYTES)) % TAILS + 1
    out = np.zeros((FIRST, 2))
    for r in counts.where("word is not null").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect():
        out[r["kind"]] = r["n"], r["c"]
    return out


def averaged(models: DataFrame) -> bytes:
    """The weighted mean of trained models (``weight``, ``model``), summed in ``PIECES`` pieces by as many tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                pieces = np.array_split(np.frombuffer(m.as_py(), np.float32) * np.float64(w), PIECES)
                yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([w] * PIECES), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["piece", "weight", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[float, np.ndarray]] = {}
        for batch in batches:
            for p, w, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                before = totals.get(p, (0.0, 0.0))
                totals[p] = before[0] + w, before[1] + np.frombuffer(sums.as_py(), np.float64)
        for p, (w, sums) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([(sums / max(w, 1.0)).astype(np.float32).tobytes()], pa.binary())], names=["piece", "mean"])

    pieces = models.select("weight", "model").mapInArrow(cut, "piece int, weight double, sums binary").repartition("piece").mapInArrow(add, "piece int, mean binary")
    return b"".join(bytes(r["mean"]) for r in sorted(pieces.collect(), key=lambda r: r["piece"]))


def train(encoded: DataFrame, frequency: np.ndarray) -> gru.Model:
    """The recurrent model after learning from all rows of ``encoded`` (``draw``, ``ids``), each of them once."""
    spark = encoded.sparkSession
    model = gru.initial(np.log(frequency / frequency.sum()))
    sizes = encoded.groupBy(F.pmod("draw", F.lit(ROUNDS)).alias("round")).agg(F.sum(F.octet_length("ids")).alias("size")).collect()
    for part, size in sorted((r["round"], r["size"]) for r in sizes):
        trainers = max(1, -(-size // TRAINER_BYTES))
        start = spark.sparkContext.broadcast(gru.pack(model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: B023  pickled in the round that defines it
            rows = pa.Table.from_batches(list(batches), dealt_schema)
            for trainer in pc.unique(rows.column("trainer")).to_pylist():
                own = rows.filter(pc.equal(rows.column("trainer"), trainer)).sort_by("draw").column("ids").to_pylist()
                stream = np.frombuffer(b"".join(own), np.int16)
                found = gru.pack(gru.train(gru.unpack(start.value), stream))
                yield pa.RecordBatch.from_arrays([pa.array([trainer], pa.int64()), pa.array([float(len(stream))]), pa.array([found], pa.binary())], names=["trainer", "weight", "model"])

        trainer = F.pmod(F.expr(f"draw div {ROUNDS}"), F.lit(trainers)).cast("int")
        dealt = encoded.where(F.pmod("draw", F.lit(ROUNDS)) == part).select(trainer.alias("trainer"), "draw", "ids")
        dealt_schema = pa.schema([("trainer", pa.int32()), ("draw", pa.int64()), ("ids", pa.binary())])
        # one trainer a task
        trained = dealt.repartitionById(trainers, "trainer").mapInArrow(run, "trainer long, weight double, model binary")
        models = materialize(trained, "models")
        model = gru.unpack(averaged(models))
        delete(spark, models._tessera_path)
        start.destroy()
    return model


def score_documents(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row: ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``held_out`` (by default, fold 1 of 5) marks the rows that nothing is learned from.
    """
    spark = docs.sparkSession
    out_of = fold(docs[id_col]) == 1 if held_out is None else held_out
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), out_of.alias("held_out"))
    counts = materialize(count_words(rows.where(~F.col("held_out"))), "words")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("docs")).first()
    tokens, distinct, ends = (total["n"] or 0), total["v"], (total["docs"] or 0)
    found, c, least = head(counts)

    def log_base(count: np.ndarray | float) -> np.ndarray | float:
        return np.log10((count + 0.5) / (tokens + 0.5 * (distinct + 1)))

    known = min(len(found), gru.VOCABULARY - FIRST)
    kinds = kind_sums(counts)
    for w, n in zip(found[:known], c[:known].tolist()):
        kinds[kind_of(w)] -= 1, n
    frequency = np.full(gru.VOCABULARY, 0.5)
    frequency[END], frequency[1:FIRST] = ends + 0.5, kinds[1:, 1] + 0.5
    frequency[FIRST : FIRST + known] += c[:known]
    # log10 of the unigram mass of each kind, and nothing for the end and the vocabulary
    mass = np.zeros(gru.VOCABULARY)
    mass[1:FIRST] = np.log10((kinds[1:, 1] + 0.5 * kinds[1:, 0] + 0.5) / (tokens + 0.5 * (distinct + 1)))
    # frequent symbols first, as they cost the model least; the end stays 0
    order = np.r_[END, 1 + np.argsort(-frequency[1:], kind="stable")]
    number = np.empty(gru.VOCABULARY, np.int16)
    number[order] = np.arange(gru.VOCABULARY)
    frequency, mass = frequency[order], mass[order]
    symbols = number[[i + FIRST if i < known else kind_of(w) for i, w in enumerate(found)]]
    shared = spark.sparkContext.broadcast((b"\n".join(found), symbols, number[:FIRST], log_base(c.astype(float)), mass))
    log_end, end_known = float(log_base(float(ends))), int(ends > 0)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, symbols, kinds, logs, mass = shared.value
        vocabulary = pa.array(joined.decode().split("\n") if joined else [], pa.string())
        symbols, logs = np.append(symbols, 0), np.append(logs, 0.0)
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                n = len(texts)
                own, owner = flat_words(texts)
                places = pc.fill_null(pc.index_in(own, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                rare = places < 0
                tail = own.filter(pa.array(rare))
                ids, base = symbols[places], logs[places]
                ids[rare] = kinds[kinds_of(tail)]
                lengths = np.bincount(owner, minlength=n)
                # each document's symbols with an end behind them
                stream = np.zeros(len(ids) + n, np.int16)
                stream[np.arange(len(ids)) + owner] = ids
                bounds = np.r_[0, np.cumsum(2 * (lengths + 1))].astype(np.int32)
                tails = np.r_[0, np.cumsum(np.bincount(owner[rare], minlength=n))].astype(np.int32)
                columns = {
                    "row": pa.array(np.arange(row, row + n)),
                    "n_tokens": pa.array(lengths + 1),
                    "n_known": pa.array(np.bincount(owner[~rare], minlength=n) + end_known),
                    "base": pa.array(np.bincount(owner, weights=base, minlength=n).astype(np.float64) + log_end),
                    "outside": pa.array(np.bincount(owner, weights=np.where(places >= known, base, 0.0) - mass[ids], minlength=n).astype(np.float64)),
                    "tail": pa.ListArray.from_arrays(pa.array(tails), tail.cast(pa.binary())),
                    "ids": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(stream)]),
                }
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, n) for i in (0, 2, 3)), *columns.values()], names=["id", "held_out", "draw", *columns])
                at, row = at + n, row + n

    # the text deals rows without an id, or with one in common, to several trainers
    drawn = spread(rows.withColumn("draw", F.xxhash64("id", "text")))
    schema = f"id {dict(rows.dtypes)['id']}, held_out boolean, draw long, row long, n_tokens long, n_known long, base double, outside double, tail array<binary>, ids binary"
    encoded = materialize(drawn.mapInArrow(encode, schema), "encoded")
    packed = spark.sparkContext.broadcast(gru.pack(train(encoded.where(~F.col("held_out")), frequency)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = gru.unpack(packed.value)
        for batch in batches:
            scores = gru.score(model, [np.frombuffer(ids.as_py(), np.int16) for ids in batch.column(5)]) / math.log(10)
            outside = pc.add(batch.column(6), pa.array(scores))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], outside, batch.column(7)], names=["id", "held_out", "row", "n_tokens", "n_known", "score", "base"])

    chosen = encoded.select("id", "held_out", "row", "n_tokens", "n_known", "ids", "outside", "base")
    scored = chosen.mapInArrow(score, f"id {dict(rows.dtypes)['id']}, held_out boolean, row long, n_tokens long, n_known long, score double, base double")
    # words that only the counts' table knows, or that no training document has
    tails = encoded.select("row", F.explode("tail").alias("word"))
    rare = counts.where((F.col("c") < least) & F.col("word").isNotNull())
    joined = tails.join(rare.hint("shuffle_hash"), "word", "left")
    lowest = F.lit(tokens + 0.5 * (distinct + 1))
    each = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / lowest)
    sums = joined.groupBy("row").agg(F.sum(each).alias("tail_base"), F.count_if(F.col("c") > 0).alias("tail_known"))
    tail_base = F.coalesce("tail_base", F.lit(0.0))
    return scored.join(sums, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + tail_base).alias("base_score"),
        (F.col("score") + tail_base).alias("score"),
    )
