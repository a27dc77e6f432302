import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from evidentia.llm import sharding


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_are_even_and_keep_groups(docs, corpus, shards):
    rows = sharding.sharded(docs, shards=shards).collect()
    texts = dict(corpus)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes = Counter(r.shard for r in rows)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        data = (texts[r.doc_id] or "").encode()
        assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data) and r.law == "rows"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if shards == 7:
        where = defaultdict(set)
        for r in rows:
            where[texts[r.doc_id] or ""].add(r.shard)
        assert all(len(s) == 1 for s in where.values())


def test_linked_documents_meet(spark):
    """Documents that share long lines end in fewer shards than chance would give."""
    rows = [(i, f"a line of many words that is shared by family {i % 20} alone\nand another one of its own, number {i} here") for i in range(400)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    where = defaultdict(Counter)
    for r in got:
        where[r.doc_id % 20][r.shard] += 1
    assert sum(max(c.values()) for c in where.values()) / len(rows) > 0.5


def test_one_shared_line_among_many_links(spark):
    """Long documents that share a single line are linked by it, wherever its hash stands among their lines'."""
    rows = [(i, "\n".join([*(f"line {k} of document {i}, which no other document has" for k in range(30)), f"a line of many words that family {i % 20} shares"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {len(r.hubs) for r in sharding.linked(docs).collect()} == {31}
    where = defaultdict(Counter)
    for r in sharding.sharded(docs, shards=10).collect():
        where[r.doc_id % 20][r.shard] += 1
    assert sum(max(c.values()) for c in where.values()) / len(rows) > 0.5


def test_hot_group_fills_whole_shards(spark):
    rows = [(i, "one text" if i % 3 else f"text {i}") for i in range(300)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    assert set(Counter(r.shard for r in got).values()) == {30}
    assert len({r.shard for r in got if r.doc_id % 3}) <= 10


def test_odd_rows(odd, none):
    assert sharding.sharded(odd).count() == 5
    assert sharding.sharded(none).count() == 0


def spark_hash(*values):
    """Spark's xxhash64 of texts and ints."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(4, "little", signed=True), seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def plain_labels(nodes, shards, rounds, slack):
    """Label propagation with dictionaries, a vote at a time; nodes: {node: (rows, hubs)}."""
    held = defaultdict(set)
    for node, (_, hubs) in nodes.items():
        for hub in hubs:
            held[hub].add(node)
    held = {hub: own for hub, own in held.items() if len(own) > 1}
    linked = {node: [h for h in hubs if h in held] for node, (_, hubs) in nodes.items()}
    label = {node: spark_hash(str(min(hubs)) if hubs else node) % shards for node, hubs in linked.items()}
    total = sum(n for n, _ in nodes.values())
    for round_ in range(rounds):
        favourite = {}
        for hub, own in held.items():
            count = Counter()
            for node in own:
                count[label[node]] += nodes[node][0]
            favourite[hub] = max((n, to) for to, n in count.items())
        wish = {}
        for node, hubs in linked.items():
            votes, weight = Counter(), Counter()
            for hub in hubs:
                n, to = favourite[hub]
                votes[to] += 1
                weight[to] += n
            wish[node] = max((votes[to], weight[to], to) for to in votes)[2] if votes else label[node]
        load, demand = Counter(), Counter()
        for node, to in label.items():
            load[to] += nodes[node][0]
            demand[wish[node]] += nodes[node][0] * (wish[node] != to)
        demand = {to: n for to, n in demand.items() if n}
        if not demand:
            break
        share = {to: min(1.0, max(0.0, slack * total / shards - load[to]) / n) for to, n in demand.items()}
        label = {node: wish[node] if wish[node] != at and spark_hash(node, round_) % sharding._FINE / sharding._FINE < share[wish[node]] else at for node, at in label.items()}
    return label


@pytest.fixture(scope="module")
def families():
    rng = random.Random(12)
    lines = [f"a line of family {i % 30}, the {i // 30}th of those that it shares" for i in range(120)]
    rows = []
    for i in range(500):
        own = [rng.choice(lines[i % 30 :: 30]) for _ in range(rng.randrange(4))] + [f"a line that only document {i} has, as it should"]
        rows.append((i, "\n".join(rng.sample(own, len(own))) if i % 9 else "a text that every ninth document has, word for word"))
    return rows


@pytest.mark.parametrize(("shards", "rounds"), [(10, 4), (3, 1), (7, 6)])
def test_labels_equal_plain_propagation(spark, families, monkeypatch, shards, rounds):
    monkeypatch.setattr(sharding, "PART", 4)  # hubs are dealt into several parts here too
    rows = sharding.linked(spark.createDataFrame(families, "doc_id long, text string"))
    frame = rows.groupBy("node").agg(F.count("*").alias("rows"), F.any_value("hubs").alias("hubs"))
    nodes = {r.node: (r.rows, r.hubs) for r in frame.collect()}
    got = {r.node: r.label for r in sharding.propagate(frame, shards=shards, rounds=rounds, slack=1.1).collect()}
    assert got == plain_labels(nodes, shards, rounds, 1.1)


def test_more_links_are_kept_than_by_a_random_deal(spark, families):
    """Links of a document to the shard in which most of its line's documents are, here and where ids are dealt by hash."""
    got = {r.doc_id: r.shard for r in sharding.sharded(spark.createDataFrame(families, "doc_id long, text string"), shards=10).collect()}

    def kept(shard):
        where = defaultdict(Counter)
        for doc_id, text in families:
            for line in set(text.split("\n")):
                where[line][shard[doc_id]] += 1
        shared = [c for c in where.values() if sum(c.values()) > 1]
        return sum(max(c.values()) for c in shared) / sum(sum(c.values()) for c in shared)

    dealt = {doc_id: spark_hash(str(doc_id)) % 10 for doc_id, _ in families}
    assert kept(got) > 0.6 and kept(got) > 2 * kept(dealt)
