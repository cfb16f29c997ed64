import random
import re

from tessera.llm import urls


def brute(url, rules, default):
    at = url.find("://") if url is not None else -1
    if at < 0:
        host = path = ""
    else:
        rest = url[at + 3 :]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


RULES = urls.RULES + (("block", "a.net", "/es/x"), ("allow", "net", "/es/x/y/z"), ("block", "b.a.net", "/"), ("allow", "example.org", ""), ("block", "example.org", "/p\u00e9"), ("allow", "com", "/"), ("block", "com", "/"), ("block", "org", ""), ("allow", "x.org", "/p"))


def test_against_brute_force(spark):
    rnd = random.Random(1)
    hosts = ["com", "example.com", "WWW.Example.com", "a.net", "b.a.net", "xa.net", "net", "example.org", "q.example.org", "", "a..net", "deep.x.y.z.b.a.net", "ÉXAMPLE.com", "example.com:80", "notexample.com", "example.organic", "org.com", "a.community", "com.org"]
    paths = ["", "/", "/en/", "/en", "/es/x/y/z/1", "/es/x", "/fr/2", "/p\u00e9/1", "/P", "/en/?q=/es/", "/es/#x", "?x=/en/", "#/en/", "/en/\n/x", "/es/\U0010ffff", "/" + "x" * 5000]
    made = [rnd.choice(["http", "https", "x", ""]) + "://" + rnd.choice(hosts) + rnd.choice(paths) for _ in range(600)] + [None, "", "nothing", "a://b://c/es/", "://net/es/"]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(made)] + [(None, "http://net/es/1", "x", "y"), (0, made[0], "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, row string")
    for rules in (RULES, urls.RULES):
        found = urls.judge(pages, rules).collect()
        assert len(found) == len(rows)
        wanted = sorted(map(repr, ((i, *brute(u, rules, "allow")) for i, u, *_ in rows)))
        assert sorted(repr(tuple(r)) for r in found) == wanted


def test_rules_may_be_a_table_of_any_size(spark):
    many = [("block" if i % 2 else "allow", f"h{i % 997}.net", f"/{i // 997}") for i in range(12_000)] + [("block", None, "/"), ("block", "", "/"), ("block", "h1.net", None)]
    made = [(i, f"http://a.h{i % 1100}.net/{i % 15}/x") for i in range(400)]
    found = {r["page_id"]: tuple(r)[1:] for r in urls.judge(spark.createDataFrame(made, "page_id long, url string"), spark.createDataFrame(many, "action string, host string, path string")).collect()}
    assert found == {i: brute(u, [r for r in many if r[1] and r[2] is not None], "allow") for i, u in made}


def test_empty_tables_and_rules(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(pages).collect() == []
    one = spark.createDataFrame([(1, "http://net/es/")], "page_id long, url string")
    assert urls.judge(one, ()).first()["verdict"] == "allow"


def test_main_path_is_native(spark, small, capsys):
    urls.judge(spark.read.parquet(f"{small}/pages.parquet")).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
