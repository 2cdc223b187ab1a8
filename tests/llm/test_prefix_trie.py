import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, most=6):
    """The trie, node by node, from the definition."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        convs[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes[ts[:d]].append(c)
    out = []
    for node, members in nodes.items():
        kids = [n for n in nodes if len(n) == len(node) + 1 and n[:-1] == node]
        under = [n for n in nodes if n[:len(node)] == node]
        inner = {n[:-1] for n in nodes if n}
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(kids),
                    sum(n not in inner for n in under), sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in under if n),
                    hashlib.sha256(",".join(str(c) for c in sorted(members) if convs[c] == node).encode()).hexdigest()))
    return out


def check(spark, rows):
    got = prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got, want = [tuple(r) for r in got.collect()], plain(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_against_the_definition(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(prefix_trie, "HOT_PARENTS", 2)
    rows = []
    for c in [*range(250), *range(900, 950), *range(-120, -90)]:
        for t in range(rng.randint(0, 5)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "ccc", None, ""]) if t else "hello"))
    rng.shuffle(rows)
    check(spark, rows)


def test_nulls_ties_repeated_rows_and_turnless_conversations(spark):
    rows = [(None, 0, "u", "lost"), (1, None, "u", "first"), (1, 0, "u", "b"), (1, 0, "u", "a"), (1, 0, "u", "a"),
            (2, 5, None, None), (2, 5, "", ""), (3, 1, "u", "x" * 50_000), (300, 1, "u", "x" * 50_000)]
    rows += [(c, 0, "u", "only turn") for c in range(500, 540)]  # replaced by the absent head where h > 0: turnless
    got = check(spark, rows)
    assert any(r[1] == 0 and r[7] != prefix_trie.EMPTY for r in got)


def test_long_conversations_and_a_frequent_one(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    rows = [(c * 100, t, "u", f"turn {t}") for c in range(60) for t in range(4)]
    rows += [(7, t, "u", str(rng.randint(0, 1))) for t in range(60)] + [(8, t, "u", "same") for t in range(40)]
    check(spark, rows)


def test_nothing_but_turnless_and_empty(spark):
    assert check(spark, [])  == []
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 3)
    assert check(spark, [(c, 0, "u", "gone")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    extra = spark.createDataFrame([(100, 0, "u", "t")], SCHEMA).withColumns({n: F.lit(1) for n in ("digest", "chars", "base", "turns")})
    assert prefix_trie.trie(prefix_trie.rebuilt(extra)).count() == 2
