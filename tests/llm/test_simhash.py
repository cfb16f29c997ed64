import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import fingerprints, neighbours, simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def planted(n=400, seed=4):
    rnd = random.Random(seed)
    values = []
    for _ in range(n):
        base = rnd.choice(values) if values and rnd.random() < 0.7 else rnd.getrandbits(64)
        for b in rnd.sample(range(64), rnd.randint(0, 5)):
            base ^= 1 << b
        values.append(base)
    return values


def test_fingerprints_equal_brute_force():
    for text in [None, "", " \n\t ", "One", "one TWO", "A b c", "ÀÉ è\u00a0x y z w", "a b " * 3000, "x\x0by\x0cz\rw v", "the same the same the same"]:
        assert simhash.fingerprint(text) == brute_print(text)


def test_sparks_hash_is_the_same(spark):
    rows = [("a b c",), ("é" * 40,), ("",), ("x" * 33,)]
    for r in spark.createDataFrame(rows, "s string").select("s", F.xxhash64("s").alias("h")).collect():
        assert r["h"] & (1 << 64) - 1 == xxhash.xxh64_intdigest(r["s"].encode(), seed=42)


def test_golay_code_is_perfect_and_keys_meet():
    rng = np.random.default_rng(1)
    segment = rng.integers(0, 1 << 23, 3000).astype(np.uint64)
    for flips in range(3):
        other = segment.copy()
        for row in range(len(other)):
            for b in rng.choice(23, flips, replace=False):
                other[row] ^= np.uint64(1 << int(b))
        a, b = simhash.codeword_indices(segment), simhash.codeword_indices(other)
        assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist()))


def shares(keys_of, n=4000, seed=2):
    rng = np.random.default_rng(seed)
    one = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    other = one.copy()
    for row in range(n):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            other[row] ^= np.uint64(1) << np.uint64(b)
    return all(set(x) & set(y) - {0} for x, y in zip(keys_of(one).tolist(), keys_of(other).tolist()))


def test_every_near_pair_shares_a_key():
    assert shares(simhash.golay_keys)
    assert shares(fingerprints.block_keys)


def test_spanning_edges_connect_what_pairs_connect():
    values = np.unique(np.array(planted(300), np.uint64))
    a, b = neighbours.spanning_edges(values, 3)
    assert len(a) < len(values)
    wanted = brute_components(values.tolist())
    index = {v: i for i, v in enumerate(values.tolist())}
    root = list(range(len(values)))
    for x, y in zip(a.tolist(), b.tolist()):
        i, j = index[x], index[y]
        old, new = max(root[i], root[j]), min(root[i], root[j])
        root = [new if r == old else r for r in root]
    assert len(set(root)) == len(set(wanted))


def components_of(spark, values, keys_of):
    rows = [(10 + i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    return {r["doc_id"] - 10: r["component_id"] - 10 for r in simhash.components(prints, keys_of=keys_of).collect()}


def test_components_equal_brute_force(spark):
    for seed, keys_of in ((7, simhash.golay_keys), (8, fingerprints.block_keys)):
        values = planted(500, seed)
        values += values[:50] + [0, 0, 7]
        found = components_of(spark, values, keys_of)
        assert [found[i] for i in range(len(values))] == brute_components(values)


def test_a_dense_group_gives_few_edges(spark):
    rnd = random.Random(9)
    base = rnd.getrandbits(64)
    values = {base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(900)}
    prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    edges = simhash.links(prints, simhash.golay_keys, 3).count()
    assert edges < 40 * len(values)
    assert len(set(components_of(spark, sorted(values), simhash.golay_keys).values())) == 1


def test_near_duplicates_cases(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(5, None, "a"), (3, "", "b"), (9, "one two three four", "c"), (9, "one two three four", "d"), (4, "ONE two  three\nfour", "e"), (8, long, "f"), (7, long + " end", "g"), (None, "alone here now", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert len(found) == len(rows)
    by = {i: (f, c) for i, f, c in found}
    assert by[5] == by[3] == ("0" * 16, 3) and by[9][1] == by[4][1] == 4 and by[8][1] == by[7][1] == 7 and by[None][1] is None
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "7", "None"]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def edited(words, n, rnd):
    words = list(words)
    for at in rnd.sample(range(len(words)), n):
        words[at] = f"new{rnd.randrange(10**6)}"
    return words


def test_copies_with_scattered_edits_go_and_others_stay(spark):
    rnd = random.Random(6)
    rows, families = [], []
    for f in range(40):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(150, 400))]
        texts = [base] + [edited(base, max(1, len(base) // 60), rnd) for _ in range(3)]
        families.append(range(len(rows), len(rows) + len(texts)))
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(texts)]
    shared = [f"s{i}" for i in range(60)]
    alone = len(rows)
    rows += [(alone + i, " ".join([f"x{rnd.randrange(3000)}" for _ in range(200)] + shared)) for i in range(60)]
    sets = {i: set(simhash.shingle_set(simhash.words(t)).tolist()) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_first(docs).select("doc_id").collect()}
    missed = sum(len(sets[f[0]] & sets[i]) / len(sets[f[0]] | sets[i]) >= 0.8 and i in kept for f in families for i in f[1:])
    assert missed <= 1 and all(f[0] in kept for f in families)
    assert set(range(alone, alone + 60)) <= kept


def test_a_large_group_of_copies_is_one(spark):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(3000)}" for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(edited(base, 2, rnd) if i else base)) for i in range(400)], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.keep_first(docs).collect()] == [0]


def groups_kept(rows, least=0.8):
    """By brute force: the smallest id of each group of texts with similar shingle sets."""
    sets = [set(simhash.shingle_set(simhash.words(t)).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def test_copies_similar_to_their_original_only_are_one_group(spark):
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(300)]
    # the original isn't the smallest id, and has no smaller digest than the copies
    rows = [(i, " ".join(edited(base, 6, rnd))) for i in range(400)] + [(900, " ".join(base))]
    sets = [set(simhash.shingle_set(simhash.words(t)).tolist()) for _, t in rows]
    alike = [len(a & sets[-1]) / len(a | sets[-1]) for a in sets[:-1]]
    assert min(alike) >= 0.8 and max(alike) < 0.9
    assert sum(len(a & b) / len(a | b) >= 0.8 for a, b in zip(sets[:-1], sets[1:-1])) < 40
    kept = {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == groups_kept(rows) == {0}


def test_every_pair_at_the_bound_is_found(spark):
    rnd = random.Random(13)
    rows, pairs = [], 0
    for _ in range(250):
        n = rnd.randint(40, 200)
        base = [f"v{rnd.randrange(2000)}" for _ in range(n)]
        whole = n - 4
        rows.append((len(rows), " ".join(base)))
        # a fifth of the shingles is cut off, or a few less or one more
        rows.append((len(rows), " ".join(base[: -(whole // 5) + rnd.choice((-1, 0, 0, 1, 2))])))
    # alike as sets, with other repeats
    for k in range(10):
        turn = [f"t{k}x{i}" for i in range(30)]
        rest = [f"r{k}x{i}" for i in range(60)]
        rows.append((len(rows), " ".join(turn * 2 + rest)))
        rows.append((len(rows), " ".join(turn * 40 + rest)))
    sets = [set(simhash.shingle_set(simhash.words(t)).tolist()) for _, t in rows]
    pairs = sum(0.8 <= len(a & b) / len(a | b) < 0.85 for a, b in zip(sets[::2], sets[1::2]))
    assert pairs > 150
    kept = {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == groups_kept(rows)


def test_rows_that_share_an_id_are_told_apart_by_text(spark):
    one, other, third = (" ".join(f"{c}{i}" for i in range(80)) for c in "abc")
    rows = [(9, one, "x"), (9, other, "y"), (9, other, "y"), (3, third, "z"), (7, third + " end", "u"), (7, one + " more", "v"), (5, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted((r["doc_id"], r["source"]) for r in simhash.keep_first(docs).collect())
    # 7 keeps the text that is no copy, as its smaller id names that group
    assert kept == [(3, "z"), (5, "n"), (7, "v"), (9, "y")]
    near = spark.createDataFrame([(4, one, "a"), (4, one + " more", "b")], docs.schema)
    assert simhash.keep_first(near).count() == 1


def test_own_columns_of_any_name_stay(spark):
    rows = [(i, text, f"k{i}", f"t{i}", i, f"id{i}", f"d{i}", f"r{i}", i, i) for i, text in enumerate(["one two three four five six seven"] * 3 + ["other words here and there and so on"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _text string, _n int, id string, digest string, row string, n int, fp long")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[3]]
