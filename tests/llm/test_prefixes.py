import hashlib
import random
import zlib
from collections import defaultdict

from tessera.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, p string, path int, key double"


def brute(rows):
    """Nodes of the trie; rows of a conversation have different turns."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [v[2:] for v in sorted(rows)] for c, rows in own.items()}
    paths = {}
    for c, rows in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(turns.get(c - c % 5, [])[:h] + rows[h:])
    members, below, leaves, saved = defaultdict(list), defaultdict(set), {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    for node in members:
        if node:
            below[node[:-1]].add(node)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in below[node]) or 1
        saved[node] = sum(saved[x] for x in below[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(below[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    return sorted((tuple(r) for r in prefixes.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def more(rows):
    return [(*r, "clash", 1, 0.5) for r in rows]


def test_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(spark, more(rows)) == brute(rows)


def test_copies_and_shared_beginnings_over_many_partitions(spark):
    draw = random.Random(11)
    rows = []
    for c in range(1500):
        kind = c % 3
        length = 12 if kind == 0 else draw.randint(0, 14)
        # a third are copies of one conversation; others begin alike and part at some turn
        part = length if kind == 0 else draw.randint(0, length)
        for t in range(length):
            rows.append((c, t, "user" if t % 2 else "system", f"é{t}" if t < part else f"{t} {draw.randint(0, 3)}"))
    assert found(spark, more(rows)) == brute(rows)


def test_wide_and_deep(spark):
    rows = [(5 * c, 0, "user", f"first {c}") for c in range(9000)] + [(7, t, "user", f"turn {t}") for t in range(700)] + [(9, t, "user", f"turn {t}") for t in range(650)]
    assert found(spark, more(rows)) == brute(rows)


def test_cases(spark):
    """Null turns first, null roles and texts empty, rows without an id left out, absent group heads, turnless conversations."""
    rows = [(1, 3, "user", "b"), (1, None, None, None), (1, 0, "user", "a" * 50000), (2, 0, "user", ""), (-7, 0, "user", "x"), (None, 0, "user", "nobody's"), (10, 1, "", ""), (11, 1, None, None), (14, 0, "u", "v"), (10**15, 0, "u", "v")]
    rows += [(c, 0, "user", "alone") for c in range(21, 40) if c % 5]
    got = found(spark, more(rows))
    wanted = [r for r in rows if r[0] != -7]
    # the remainder of a negative id is SQL's, which Python's is not
    assert brute(wanted) == found(spark, more(wanted))
    assert got[0] is not None and sum(r[1] == 0 for r in got) == 1 and min(r[0] for r in got) == -7
    assert found(spark, []) == []


def test_ties_and_repeated_rows(spark):
    """Turns of equal number stand in one order everywhere, and a repeated row is a turn of its own."""
    rows = [(c, 0, "user", x) for c in (5, 10, 15) for x in ("b", "a")] + [(c, 1, "user", "same") for c in (5, 10, 15) for _ in range(2)]
    got = found(spark, more(rows))
    assert [(r[1], r[3]) for r in sorted(got, key=lambda r: r[1])] == [(d, 3) for d in range(5)]


def test_common_prefixes():
    a, b = b"".join(bytes([i]) * prefixes.WIDTH for i in range(40)), b"".join(bytes([i if i != 17 else 99]) * prefixes.WIDTH for i in range(60))
    assert [prefixes.common(a, b), prefixes.common(a, a), prefixes.common(a, a[: prefixes.WIDTH * 3]), prefixes.common(b"", a), prefixes.common(None, a)] == [17, 40, 3, 0, -1]
