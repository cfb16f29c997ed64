import hashlib
import math
import random

import pytest

from tessera.llm import fingerprints


def brute(rows):
    ordered = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    out = []
    for i, (key, text) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        n = len(text) // 3
        changed = (text[:-n] if n else text) + following[:n]
        a, b, c = map(fingerprints.fingerprint, (text, changed, following))
        out.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    return out


@pytest.mark.parametrize("size, quantiles", [(5000, 1024), (7, 1024), (1, 1024), (1, 4), (9, 2)])
def test_next_and_edited_texts(spark, small, monkeypatch, size, quantiles):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", size)
    monkeypatch.setattr(fingerprints, "QUANTILES", quantiles)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").limit(120).collect()]
    rows += [(500, None), (501, ""), (502, "é🙂 x"), (502, "é🙂 a"), (502, "é🙂 x")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    found = [tuple(r) for r in fingerprints.with_next(docs).collect()]
    assert len(found) == len(rows)
    mask = (1 << 64) - 1
    assert sorted((r[0], r[1], r[2], r[3] & mask, r[4] & mask, r[5], r[6]) for r in found) == sorted(brute(rows))


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert fingerprints.with_next(docs).first()["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprints.with_next(docs.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, "abc"), (None, "abd"), (2, "xyz")], "doc_id long, text string")
    found = {r["edited_sha256"] for r in fingerprints.with_next(nulls).collect()}
    assert found == {hashlib.sha256(t).hexdigest() for t in (b"xya", b"aba", b"abx")}


def test_fingerprints_tell_edited_from_other_texts(spark):
    rows = fingerprints.with_next(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("n_chars > 300").collect()
    near, far = sorted(r["near_edited"] for r in rows), sorted(r["near_next"] for r in rows)
    assert near[len(near) // 10] > far[9 * len(far) // 10]


def test_likeness():
    assert fingerprints.likeness(5, 5) == 1 and fingerprints.likeness(0, (1 << 64) - 1) == 0
    assert fingerprints.likeness(0, 1) == pytest.approx(math.cos(math.pi / 64))
    assert fingerprints.fingerprint(None) == fingerprints.fingerprint(" \n") == 0
    assert fingerprints.fingerprint("one") == fingerprints.fingerprint("ONE ")


def test_classes(spark):
    rows = [(3, 0), (1, 7), (2, 0x7000000), (9, 0xFFFF << 20)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in fingerprints.near_classes(prints).collect()}
    assert found == {3: (1, 2), 1: (1, 1), 2: (1, 1), 9: (9, 0)}
    assert fingerprints.near_classes(prints.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fingerprints.near_classes(prints, radius=4)


def test_search_equals_brute_force(spark):
    rnd = random.Random(3)
    values = [rnd.getrandbits(63)]
    for _ in range(400):
        base = rnd.choice(values) if rnd.random() < 0.7 else rnd.getrandbits(63)
        for b in rnd.sample(range(63), rnd.randint(0, 4)):
            base ^= 1 << b
        values.append(base)
    prints = spark.createDataFrame(list(enumerate(values)), "doc_id long, fp long")
    found = {tuple(r) for r in fingerprints.search(prints.where("doc_id % 10 = 0"), prints).collect()}
    wanted = {(i, j, d) for i, a in enumerate(values) if i % 10 == 0 for j, b in enumerate(values) if (d := (a ^ b).bit_count()) <= 3}
    assert found == wanted and len(wanted) > 100


def test_ids_must_be_numbers(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(TypeError, match="numbers"):
        fingerprints.with_next(docs)


def test_many_rows_of_one_id_and_without_one(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 50)
    rows = [(7, f"text {i}") for i in range(400)] + [(None, f"none {i}") for i in range(300)] + [(i, f"own {i} words") for i in range(20)]
    found = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(found) == len(rows) and len([r for r in found if r["doc_id"] is None]) == 300


def test_links_are_counted_as_by_brute_force(spark, monkeypatch):
    from tessera.llm import neighbours

    rnd = random.Random(5)
    values = [0, 0, 0, (1 << 63) - 1]
    for _ in range(900):
        # copies, near copies of a few texts (some in a dense group), and others
        base = rnd.choice(values[: rnd.choice((3, 40, len(values)))]) if rnd.random() < 0.8 else rnd.getrandbits(63)
        for b in rnd.sample(range(63), rnd.choice((0, 1, 1, 2, 4))):
            base ^= 1 << b
        values.append(base)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    wanted = {i: sum((a ^ b).bit_count() <= 3 for b in values) - 1 for i, a in enumerate(values)}
    assert {r["doc_id"]: r["n_links"] for r in fingerprints.near_classes(prints).collect()} == wanted and max(wanted.values()) > 50
    # the same where long runs are cut
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    assert {r["doc_id"]: r["n_links"] for r in fingerprints.near_classes(prints).collect()} == wanted


def test_the_query_gives_the_links_of_the_table(spark, small):
    from tessera.llm import queries

    rows = queries.op9_fingerprints(spark, small).collect()
    values = [int(r["fingerprint"], 16) for r in rows]
    assert [r["n_links"] for r in rows] == [sum((a ^ b).bit_count() <= 3 for b in values) - 1 for a in values]
