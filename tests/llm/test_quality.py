import collections
import re

from tessera.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, size=5):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    counts = collections.Counter(windows)
    covered = {k for i, w in enumerate(windows) if counts[w] > 1 for k in range(i, i + size)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_base_equals_brute_force(spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts += [None, "", " \n ", "a b c d e a b c d e", "x y\nx y\n\n \nx y", "é ü \u00a0 a\u2003b", "#* $ <a>|", "w " * 30000, "a b c d e f " * 3]
    for text in texts:
        assert quality.measure(text)[:6] == brute(text), (text or "")[:60]


def covered(words, size):
    """The share of the words' characters in windows that occur twice."""
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    counts = collections.Counter(windows)
    inside = {k for i, w in enumerate(windows) if counts[w] > 1 for k in range(i, i + size)}
    return sum(len(words[i]) for i in inside) / max(sum(map(len, words)), 1)


def brute_reason(text):
    text = text or ""
    words = WORD.findall(text)
    _, _, symbols, dup, _, failed = brute(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    if failed:
        return "base"
    if symbols > 0.1 * len(words):
        return "symbols"
    if dup > 0.5 * len(lines) or sum(map(len, again)) / len(text) > 0.3:
        return "lines"
    return next((f"coverage_{k}" for k, most in quality.MAX_COVERED.items() if covered(words, k) > most), None)


def test_kept_equals_brute_force(spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 6000").collect()]
    pair = " ".join(f"a b w{i}" for i in range(40)) + " " + "a b " * 0
    texts += ["x y " * 3 + " ".join(f"u{i}" for i in range(60)), pair, "\n".join(f"line {i} of words in a text" for i in range(9)), "\n".join(["the same long line of many words again"] * 2 + [f"other{i}" for i in range(200)]), "$ " * 3 + " ".join(f"v{i}" for i in range(12)), "long" * 50 + " b " + " ".join(f"q{i}" for i in range(20)) + " " + "long" * 50 + " b"]
    rows = spark.createDataFrame([(None if i % 3 == 0 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = [(r["doc_id"], r["reason"], r["kept"]) for r in quality.judge(rows).collect()]
    wanted = [(None if i % 3 == 0 else i, brute_reason(t), brute_reason(t) is None) for i, t in enumerate(texts)]
    assert sorted(found, key=repr) == sorted(wanted, key=repr) and len({r for _, r, _ in wanted}) > 3


def test_every_length_decides_documents_of_its_own():
    """A passage of ``size`` words found twice counts for all shorter lengths, too; each limit has a share that only it rejects."""
    limits = list(quality.MAX_COVERED.items())
    assert [m for _, m in limits] == sorted((m for _, m in limits), reverse=True)
    for at, (size, most) in enumerate(limits):
        above = limits[at - 1][1] if at else 0.19
        words = next(n for n in range(2 * size, 2000) if most < 2 * size / n <= above - 1e-9)
        passage = [f"P{chr(65 + i)}" for i in range(size)]
        rest = [chr(97 + i // 26 % 26) + chr(97 + i % 26) for i in range(words - 2 * size)]
        text = " ".join([*passage, *rest, *passage])
        shares = {k: covered(text.split(), k) for k in quality.MAX_COVERED}
        assert [k for k, share in shares.items() if share > quality.MAX_COVERED[k]] == [size] and quality.measure(text)[-1] == f"coverage_{size}", shares


def test_coverage_decides_documents_of_the_table(spark):
    sf = "/root/testdata/sf0.1"
    found = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("reason").count().collect()
    by = {r["reason"]: r["count"] for r in found}
    assert sum(n for reason, n in by.items() if reason and reason.startswith("coverage")) >= 30 and len([r for r in by if r and r.startswith("coverage")]) >= 4


def test_verdicts_follow_the_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id")
    good, bad = found.where("quality = 1 and not base_failed"), found.where("quality = 0")
    assert good.where("kept").count() >= 0.99 * good.count() > 100
    assert bad.where("not kept").count() >= 0.95 * bad.count() > 10


def test_cases(spark):
    rows = [(1, None, True), (2, "word " * 50000, True), (3, " ".join(f"w{i}" for i in range(40)), None), (3, " ".join(f"w{i}" for i in range(40)), False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    found = quality.judge(docs).collect()
    assert {(r["doc_id"], r["kept"]) for r in found} == {(1, False), (2, False), (3, True)} and len(found) == 4
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [3, 3]
    assert quality.judge(docs.limit(0)).collect() == []
