import hashlib
import io

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def made(n):
    return [(i, f"http://x/{i}", f"<p>body {i} é</p>" * (i % 5), "clash") for i in range(n)]


def test_records_are_laid_out_in_order(spark):
    rows = made(60) + [(None, None, None, None), (5, "http://x/5", "", "")]
    found = warc.records(warc.keyed(pages(spark, rows)), 3).orderBy("segment", "seq").collect()
    assert len(found) == len(rows) and [r["key"] for r in found] == sorted(r["key"] for r in found)
    at = {}
    for r in found:
        assert r["offset"] == at.get(r["segment"], 0) and r["key"].startswith(r["segment"]) and len(r["segment"]) == 1
        at[r["segment"]] = r["offset"] + r["length"]
    one = next(r for r in found if r["id"] == 7)
    body = "<p>body 7 é</p>" * 2
    text = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Target-URI: http://x/7\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n"
    assert one["digest"] == hashlib.sha256(text.encode()).hexdigest() and one["length"] == len(text.encode())


@pytest.mark.parametrize("n", [1, 16, 300])
def test_trees_equal_brute_force(spark, n):
    found = warc.keyed(pages(spark, made(n) + made(2)))
    depth = warc.digits(n)
    nodes = {(r["level"], r["node"]): r for r in warc.tree(warc.entries(found, depth), depth).collect()}
    below = {}
    for r in found.collect():
        below.setdefault(r["key"][:depth], []).append(r)
    level = {}
    for node, own in below.items():
        many = {r["key"]: sum(x["key"] == r["key"] for x in own) for r in own}
        lines = sorted({f"{r['key']} {r['digest']} {r['length']} {many[r['key']]}" for r in own})
        level[node] = hashlib.sha256("\n".join(lines).encode()).hexdigest(), sum(r["length"] for r in own)
    for at in range(depth, -1, -1):
        assert {k[1]: (v["hash"], v["bytes"]) for k, v in nodes.items() if k[0] == at} == level
        up = {}
        for node in sorted(level):
            up.setdefault(node[: at - 1], []).append(level[node])
        level = {k: (hashlib.sha256(" ".join([str(sum(b for _, b in v)), *(h for h, _ in v)]).encode()).hexdigest(), sum(b for _, b in v)) for k, v in up.items()}


def audited(spark, rows, others):
    ours, theirs = warc.keyed(pages(spark, rows)), warc.keyed(pages(spark, others))
    depth = warc.digits(len(rows))
    return sorted(((r["id"], r["state"]) for r in warc.audit(ours, theirs, depth).collect()), key=str), warc.suspects(*(warc.tree(warc.entries(x, depth), depth) for x in (ours, theirs)), depth).count()


def test_audits_find_exactly_the_damage(spark):
    rows = made(300)
    other = [(i, u, h + "longer" if i == 11 else (h or "x")[:-1] + "~" if i in (0, 150) else h, d) for i, u, h, d in rows if i != 42] + [(900, "u", "new", "")]
    found, leaves = audited(spark, rows, other)
    assert found == sorted([(0, "damaged"), (11, "damaged"), (150, "damaged"), (42, "missing"), (900, "added")], key=str)
    assert leaves <= 8  # one leaf for each lost and each new record
    assert audited(spark, rows, rows[::-1]) == ([], 0)


def test_repeated_null_and_empty(spark):
    rows = [(None, "u", "a", ""), (None, "u", "b", ""), (3, "u", "x", ""), (3, "u", "x", ""), (3, "u", "x", ""), (4, None, None, "")]
    assert audited(spark, rows, [(None, "u", "a", ""), (None, "u", "c", ""), (3, "u", "x", ""), (4, "", "", "")])[0] == [(3, "missing"), (None, "damaged")]
    assert audited(spark, rows, [])[0] == sorted([(3, "missing"), (4, "missing"), (None, "missing"), (None, "missing")], key=str)
    assert audited(spark, [], rows[:1]) == ([(None, "added")], 1) and audited(spark, [], []) == ([], 0)
    texts = spark.createDataFrame([(f"id{i}", "u", f"<p>{i}</p>") for i in range(40)], "page_id string, url string, html string")
    changed = texts.withColumn("html", F.when(F.col("page_id") == "id7", "other").otherwise(F.col("html")))
    assert [tuple(r)[:2] for r in warc.audit(warc.keyed(texts), warc.keyed(changed), 1).collect()] == [("id7", "damaged")]


def test_files_round_trip():
    stream = io.BytesIO()
    texts = [f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {len(b.encode())}\r\n\r\n{b}\r\n\r\n" for b in ("", "é body", "WARC/1.1\r\nx")]
    places = warc.write_warc(stream, iter(texts))
    data = stream.getvalue()
    assert [b.decode() for _, b in warc.read_warc(data)] == ["", "é body", "WARC/1.1\r\nx"]
    offset, length = places[1]
    assert next(warc.read_warc(data[offset : offset + length]))[1].decode() == "é body"


def test_pages_without_an_id_have_their_state(spark, tmp_path):
    from tessera.llm import queries

    rows = [(i, f"http://x/{i}", f"<p>body {i}</p>") for i in range(60)] + [(None, "http://x/none", "<p>no id</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: r["state"] for r in queries.op10_warc(spark, str(tmp_path)).collect()}
    assert len(found) == 62 and found[None] == "intact" and (found[7], found[27], found[17], found[-37]) == ("damaged", "damaged", "missing", "added")
