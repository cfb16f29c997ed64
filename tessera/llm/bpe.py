"""Operator 1: BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring byte symbols that occurs inside no vocabulary token can never be merged over, so a
word may be cut there for certain.  The fragments between such cuts are encoded independently (and kept in a
bounded memo, as fragments repeat far more often than words) and their ids are concatenated.  The results are
those of the ``tokenizers`` library for the same file.

Defined results: a null text counts as empty and has no ids; very long words are merged with a queue, so time
grows as n log n; repeated rows are encoded each on their own; an empty table gives an empty table; only the
id and text columns are read, so further columns never clash.
"""

from __future__ import annotations

import functools
import hashlib
import json
import operator
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.models import BPE

from tessera.llm.common import spread

#: The pre-tokenisation pattern that byte-level BPE files imply when they say ``use_regex``.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters, numbers and white space among the characters below U+0250, as classes for ``re``.
LATIN_CLASSES = {
    r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ɏ",
    r"\p{N}": "0-9²³¹¼½¾",
    r"\s": "\\t-\\r \\x85\\xa0",
}
#: A text with none of these takes the fast patterns made of ``LATIN_CLASSES``.
NOT_LATIN = re.compile("[^\u0000-ɏ]")
#: Entries in each of the two generations that a worker keeps of words and of fragments.
MEMO_ENTRIES = 300_000
#: Longer words are not kept.
MEMO_LENGTH = 48


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if visible Latin-1, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


ALPHABET = byte_alphabet()
TO_SYMBOLS = {b: c for b, c in enumerate(ALPHABET)}
TO_BYTE = {c: b for b, c in enumerate(ALPHABET)}


def _latin(pattern: str) -> str:
    """``pattern`` with its Unicode classes spelled out for characters below U+0250."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        took = next((k for k in LATIN_CLASSES if pattern.startswith(k, i)), None)
        if took:
            out.append(LATIN_CLASSES[took] if depth else f"[{LATIN_CLASSES[took]}]")
            i += len(took)
        elif pattern.startswith(r"\S", i):
            out.append(f"[^{LATIN_CLASSES[chr(92) + 's']}]")
            i += 2
        else:
            depth += (pattern[i] == "[") - (pattern[i] == "]")
            out.append(pattern[i])
            i += 1
    return "".join(out)


class _Memo(dict):
    """A dict that fills itself with ``make(key)`` and holds two generations of at most ``entries`` each.

    When the younger generation is full it becomes the older one; what is met again moves back, so frequent
    keys stay and rare ones go.
    """

    def __init__(self, make: Callable[[str], bytes], entries: int):
        super().__init__()
        self.make, self.older = make, {}
        self.entries = entries

    def __missing__(self, key: str) -> bytes:
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_LENGTH:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class ForcedBoundaryBpe:
    """A BPE vocabulary read from a ``tokenizers`` JSON file; ids are bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, memo: int = MEMO_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # the library's merge engine, for fragments that end a word and for the others
        self.inside = BPE(vocab=self.vocab, merges=pairs)
        self.ending = BPE(vocab=self.vocab, merges=pairs, end_of_word_suffix=self.suffix) if self.suffix else self.inside
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.joins_bytes = bool(spec.get("decoder")) and spec["decoder"]["type"] == "ByteLevel"
        self._normalizers = self._read_normalizers(spec.get("normalizer"))
        pattern = self._read_pattern(spec["pre_tokenizer"])
        self._fast = re.compile(_latin(pattern))
        self._full = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.tokens = [""] * size
        for token, i in {**self.vocab, **self.added}.items():
            self.tokens[i] = token
        self.token_bytes = [t.encode() if t in self.added else bytes(map(TO_BYTE.__getitem__, t)) for t in self.tokens] if self.joins_bytes else []
        self.inner = self._inner_pairs()
        self.words, self.fragments = _Memo(self._word, memo), _Memo(self._fragment, memo)
        self._path, self._library = path, None

    @staticmethod
    def _read_normalizers(spec: dict | None) -> list[str]:
        steps = [] if spec is None else spec["normalizers"] if spec["type"] == "Sequence" else [spec]
        names = []
        for step in steps:
            if step["type"] == "Replace" and (step["pattern"], step["content"]) != ({"Regex": r"\s+"}, " ") or step["type"] not in ("NFC", "Lowercase", "Replace"):
                raise ValueError(f"normalizer {step} isn't known")
            names.append(step["type"])
        return names

    @staticmethod
    def _read_pattern(spec: dict) -> str:
        steps = spec["pretokenizers"] if spec["type"] == "Sequence" else [spec]
        last = steps[-1]
        if last["type"] != "ByteLevel" or last["add_prefix_space"]:
            raise ValueError(f"pre-tokenizer {spec} isn't known")
        if last["use_regex"] and len(steps) == 1:
            return BYTE_LEVEL_PATTERN
        if len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]:
            return steps[0]["pattern"]["Regex"]
        raise ValueError(f"pre-tokenizer {spec} isn't known")

    def _inner_pairs(self) -> tuple[frozenset[str], frozenset[str]]:
        """The pairs of symbols inside tokens: those before a word's last symbol, and those that end a word."""
        inside, ending = set(), set()
        for token in self.vocab:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: len(token) - len(self.suffix)] if ends else token
            pairs = [body[i : i + 2] for i in range(len(body) - 1)]
            if ends and pairs:
                ending.add(pairs.pop())
            inside.update(pairs)
        return frozenset(inside), frozenset(ending) if self.suffix else frozenset(inside)

    def cuts(self, symbols: str) -> list[int]:
        """The places in a word's byte symbols where no token can lie across."""
        inside, ending = self.inner
        last = len(symbols) - 1
        if last < 1 or symbols[last - 1 :] in ending and inside.issuperset(map(operator.concat, symbols[: last - 1], symbols[1:last])):
            return []
        return [i for i in range(1, last) if symbols[i - 1 : i + 1] not in inside] + ([last] if last > 0 and symbols[last - 1 :] not in ending else [])

    def _word(self, word: str) -> bytes:
        symbols = word.encode("utf-8", "replace").decode("latin-1").translate(TO_SYMBOLS)
        cuts = self.cuts(symbols)
        if not cuts:
            return self._fragment(symbols + " ")
        at = [0, *cuts, len(symbols)]
        parts = [symbols[a:b] for a, b in zip(at, at[1:])]
        # a space never is a byte symbol: it marks the fragment that ends the word
        return b"".join(map(self.fragments.__getitem__, parts[:-1])) + self.fragments[parts[-1] + " "]

    def _fragment(self, fragment: str) -> bytes:
        merged = self.ending.tokenize(fragment[:-1]) if fragment[-1] == " " else self.inside.tokenize(fragment)
        return b"".join([t.id.to_bytes(4, "little") for t in merged])

    def _split(self, text: str) -> list[str]:
        """Normalise and split into the words that the merges work on."""
        if NOT_LATIN.search(text) is None:
            # NFC leaves these characters alone, and white space is either dropped or kept as it is by the pattern
            if "Replace" in self._normalizers:
                text = re.sub(f"[{LATIN_CLASSES[chr(92) + 's']}]+", " ", text) if not self._drops_space else text
            return self._fast.findall(text.lower() if "Lowercase" in self._normalizers else text)
        if any(unicodedata.category(c) == "Cn" for c in set(NOT_LATIN.findall(text))):
            return self._by_library(text)
        for step in self._normalizers:
            if step == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif step == "Replace":
                text = regex.sub(r"\p{White_Space}+", " ", text)
            else:
                text = text.replace("Σ", "σ").lower()  # each character alone: no final sigma
        return self._full.findall(text)

    @functools.cached_property
    def _drops_space(self) -> bool:
        return not self._fast.findall(" \t\n")

    def _by_library(self, text: str) -> list[str]:
        """For characters that one of the Unicode versions at hand doesn't know, the words are those of the library."""
        from tokenizers import Tokenizer

        self._library = self._library or Tokenizer.from_file(self._path)
        if self._library.normalizer is not None:
            text = self._library.normalizer.normalize_str(text)
        if self.joins_bytes or not self._drops_space:
            return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]
        return [bytes(map(TO_BYTE.__getitem__, w)).decode() for w, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; the strings of special tokens give their ids, as is the library's default."""
        if not text:
            return b""
        get = self.words.__getitem__
        if self.specials is None or self.specials.search(text) is None:
            return b"".join(map(get, self._split(text)))
        out = []
        for part in self.specials.split(text):
            out.append(self.added[part].to_bytes(4, "little") if part in self.added else b"".join(map(get, self._split(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included, as the library's ``decode(ids, skip_special_tokens=False)``."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if not self.joins_bytes:
            return " ".join(map(self.tokens.__getitem__, numbers))
        return b"".join(map(self.token_bytes.__getitem__, numbers)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def bpe(path: str, memo: int = MEMO_ENTRIES) -> ForcedBoundaryBpe:
    """The vocabulary at ``path``, read once in a worker; its memos hold two generations of ``memo`` entries."""
    return ForcedBoundaryBpe(path, memo)


#: Results that ``codec`` can give, with their types.
RESULTS = {"ids": "binary", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def codec(docs: DataFrame, tokenizer_path: str, results: tuple[str, ...] = ("ids",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, and where asked for decode again, every whole text in one pass without a shuffle.

    Returns ``id_col`` and the asked ``results``: ``ids`` (little-endian unsigned 32-bit), ``n_tokens``,
    ``ids_sha256``, ``decoded``, ``decoded_sha256``.
    """
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(tokenizer_path)
        for batch in batches:
            out: dict[str, list] = {r: [] for r in results}
            for text in batch.column(1):
                ids = coder.encode(text.as_py())
                text_back = coder.decode(ids) if "decoded" in out or "decoded_sha256" in out else ""
                for r, values in out.items():
                    if r == "ids":
                        values.append(ids)
                    elif r == "n_tokens":
                        values.append(len(ids) // 4)
                    elif r == "ids_sha256":
                        values.append(hashlib.sha256(ids).hexdigest())
                    elif r == "decoded":
                        values.append(text_back)
                    else:
                        values.append(hashlib.sha256(text_back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds[RESULTS[r]]) for r, v in out.items())], names=["id", *results])

    source = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    kind = dict(source.dtypes)["id"]
    coded = source.mapInArrow(run, f"id {kind}, " + ", ".join(f"{r} {RESULTS[r]}" for r in results))
    return coded.withColumnRenamed("id", id_col)
