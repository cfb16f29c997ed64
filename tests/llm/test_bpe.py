import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
POOL = "abcdeXYZ  \n\t'’s,.!?0129²½éèÉßΣσςİıǅﬁ中文字テ한글🙂́ \u0085\x1c\x00ЖжאبǄ"


def texts(n=400):
    rnd = random.Random(5)
    made = ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    wide = ["".join(chr(rnd.choice([rnd.randint(32, 0x250), rnd.randint(0x250, 0x3000), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(n)]
    return made + wide + ["", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>c", "ΑΣ", "a" * 3000, "é" * 300, "don't we'll I'M", "x y " * 4000]


@pytest.mark.parametrize("name", FILES)
def test_encode_and_decode_equal_the_library(name):
    own, library = bpe.ForcedBoundaryBpe(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for text in texts():
        ids = own.encode(text)
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted, text[:80]
        assert own.decode(ids) == library.decode(wanted, skip_special_tokens=False)


@pytest.mark.parametrize("name", FILES)
def test_no_token_lies_across_a_cut(name):
    own = bpe.ForcedBoundaryBpe(public_tokenizers.path(name))
    rnd = random.Random(2)
    cut = 0
    for token in rnd.sample(sorted(own.vocab), 3000):
        ends = own.suffix and token.endswith(own.suffix)
        body = token.removesuffix(own.suffix) if ends else token
        inside = [i for i in own.cuts(body + ("" if ends or not own.suffix else "a")) if i < len(body)]
        assert not inside, token
    for _ in range(300):
        word = "".join(rnd.choice("qxzjkvbpw") for _ in range(12))
        cut += len(own.cuts(word))
    assert cut > 300


def brute_merge(symbols, ranks):
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not found:
            return symbols
        i = min(found)[1]
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


def test_fragments_give_the_ids_of_whole_words():
    path = public_tokenizers.path(FILES[0])
    own = bpe.ForcedBoundaryBpe(path)
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    ranks = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): r for r, m in enumerate(merges)}
    rnd = random.Random(3)
    several = 0
    for _ in range(300):
        word = "".join(rnd.choice("theinratoqxzkv") for _ in range(rnd.randint(1, 40)))
        several += len(own.cuts(word)) > 1
        merged = brute_merge([*word[:-1], word[-1] + own.suffix], ranks)
        assert own._word(word) == b"".join(own.vocab[m].to_bytes(4, "little") for m in merged)
    assert several > 100


def test_codec_handles_nulls_repeats_and_clashing_columns(spark):
    path = public_tokenizers.path(FILES[0])
    rows = [(1, None, "x", 5), (2, "", "y", 6), (3, "Hello world", None, None), (3, "Hello world", "z", 7), (None, "a", "b", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    found = bpe.codec(docs, path, ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(found) == 5
    by = {r["doc_id"]: r for r in found}
    assert by[1]["n_tokens"] == 0 and by[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest() == by[2]["decoded_sha256"]
    assert by[3]["decoded"] == "hello</w> world</w>" and by[None]["n_tokens"] == 1
    assert bpe.codec(docs.limit(0), path, ("n_tokens",)).collect() == []
