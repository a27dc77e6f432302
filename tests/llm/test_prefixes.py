import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.llm import prefixes
from evidentia.llm.queries import op11_heavy_path_trie
from evidentia.llm.scan import running


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    """The contract's rows from (conv_id, turn, role, text), by a dictionary of prefixes."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in children[node])
        leaves[node] = sum(leaves[c] for c in children[node]) if children[node] else 1
    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in held if len(whole[c]) == len(node)))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(spark, rows, tmp_path):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node long").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted(map(tuple, op11_heavy_path_trie(spark, str(tmp_path)).collect()), key=repr)


def families(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), 150):
        opening = rng.choice(["hello there", "how are you", "tell  me\tmore"])
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", opening if t == 0 else rng.choice(["yes", "no and no", "perhaps \x0b so", "a b c d"]), 1))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, tmp_path, seed):
    rows = families(seed)
    assert nodes(spark, rows, tmp_path) == brute([r[:4] for r in rows])


def test_odd_rows(spark, tmp_path):
    rows = [
        (20, 1, "user", "one", 1), (20, None, "user", "before one", 1), (20, 1, None, None, 1), (20, 1, "user", "one", 1), (21, 0, "user", "one", 1), (22, 5, None, "", 1),
        (45, 0, "a", "x", 1), (None, 0, "user", "lost", 1), (-3, 0, "user", "negative", 1), (-20, 0, "user", "first", 1), (60, 0, "user", "w " * 50_000, 1), (61, 0, "user", "w " * 50_000, 1), (1 << 40, 1, "b", "y", None),
    ]
    rows += [(c, t, "user", f"turn {t}", 1) for c in (83, 99, 98) for t in range(2)]
    assert nodes(spark, rows, tmp_path) == brute([r[:4] for r in rows])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert op11_heavy_path_trie(spark, str(tmp_path)).count() == 0


def test_one_long_conversation_and_many_copies(spark, tmp_path):
    """A conversation with a third of all turns, one that very many repeat, and caterpillars with deep light edges."""
    rows = [(0, t, "user", f"turn {t} of many", 1) for t in range(3000)]
    rows += [(20 * c, t, "user", f"common {t}", 1) for c in range(1, 400) for t in range(3)]
    rows += [(20 * c, t, "user", f"step {t}" if t < c - 500 else f"off {c} {t}", 1) for c in range(500, 540) for t in range(c - 500 + 2)]
    assert nodes(spark, rows, tmp_path) == brute([r[:4] for r in rows])


def test_light_edges_are_few(spark):
    rows = spark.createDataFrame([(20 * c, t, "u", f"{(c >> (7 - t))}" if t < 8 else "", 1) for c in range(256) for t in range(9)], "conv_id long, turn long, role string, text string, x int")
    turns = prefixes.rebuilt(prefixes.ranked(rows))
    named = prefixes.prefixes(turns).cache()
    tree = named.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"), F.count("*").alias("n"))
    heavy = tree.where("parent is not null").groupBy("parent").agg(F.max(F.struct("n", (-F.col("conv_id")).alias("c"), "node"))["node"].alias("node"))
    marked = tree.join(heavy.select("node", F.lit(False).alias("light")), "node", "left").fillna({"light": True})
    assert prefixes._paths(named, marked).agg(F.max("level")).first()[0] <= 9


def test_running_values_cross_partitions(spark):
    """A group over all partitions, groups of one row, and a fold whose order matters."""
    rng = random.Random(4)
    rows = [(g, i, rng.randrange(1000)) for g, n in ((1, 1), (2, 500), (3, 2), (5, 90), (9, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, x long").repartition(5)
    p = 1_000_003
    got = running(df, "g", ["i"], ["x"], zero=(0, 0), step=lambda v, r: (v[0] + 1, (v[1] * 31 + r[0]) % p), join=lambda a, b: (a[0] + b[0], (a[1] * pow(31, b[0], p) + b[1]) % p), emit=lambda a, b: (a[1], b[1]), out={"was": "long", "is": "long"})
    want, value, at = [], 0, None
    for g, i, x in sorted(rows):
        value = 0 if g != at else value
        want.append((g, i, x, value, (value * 31 + x) % p))
        value, at = want[-1][-1], g
    assert sorted(map(tuple, got.collect())) == want
