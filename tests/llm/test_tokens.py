import random
import zlib
from functools import cache
from itertools import product
from string import ascii_lowercase

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import packing, sst, tokens
from evidentia.llm.tokens import encoded, ids_dtype

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@cache
def loaded(name):
    """The tokenizer as the files' description loads it, not the module's own."""
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.encode_special_tokens = True
    return found


def ids_of(text, name):
    return loaded(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_ids_are_the_tokenizers_own(name, corpus):
    rng = random.Random(5)
    letters = "ab'sdtl 1 \n\t.,!éÉßÄ½²ªŉ<|endoftext|>Ωσ  漢\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + [t or "" for _, t in corpus] + ["<|endoftext|>x<|startoftext|>"]
    for text, got in zip(texts, encoded(texts, name), strict=True):
        assert np.frombuffer(got, ids_dtype(name)).tolist() == ids_of(text, name), text


def test_words_of_a_large_vocabulary_are_encoded_once(monkeypatch):
    merged, begin = [], tokens._Words.__init__

    def counting(self, name, older):
        begin(self, name, older)
        merge = self.merge
        self.merge = lambda word: merged.append(1) or merge(word)

    monkeypatch.setattr(tokens, "_known", {})
    monkeypatch.setattr(tokens._Words, "__init__", counting)
    texts = [" " + " ".join(map("".join, product([a], [b], ascii_lowercase, ascii_lowercase))) for a, b in product(ascii_lowercase[:17], ascii_lowercase)]
    once = list(encoded(texts, FILES[0]))
    assert list(encoded(texts, FILES[0])) == once
    assert len(merged) == 17 * 26**3


def test_first_fit_decreasing_equals_plain_search():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(0, 60))]
        bins, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((b for b, used in enumerate(bins) if used + sizes[i] <= 50), len(bins))
            if b == len(bins):
                bins.append(0)
            want[i] = (b, bins[b])
            bins[b] += sizes[i]
        got = packing.first_fit_decreasing(sizes, 50)
        assert [want[i] for i in range(len(sizes))] == list(zip(*got, strict=True))


def check_pieces(rows, texts, length=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, pieces in by_doc.items():
        whole = [*ids_of(texts[doc], "byte_bpe_50k.json"), 0]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            own = np.frombuffer(p.ids, "<u2")
            assert p.start == at and p.length == len(own) and p.doc_tokens == len(whole)
            assert own.tolist() == whole[at : at + p.length]
            at += p.length
        assert at == len(whole)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length


def test_packing_covers_every_id_once(docs, corpus):
    packed = packing.pack(docs, group_documents=20)
    rows = packed.collect()
    check_pieces(rows, dict(corpus))
    assert {r.doc_id for r in rows} == {i for i, _ in corpus}
    one = packing.digest(packed).where("doc_id = 3").orderBy("start").first()
    whole = [*ids_of(dict(corpus)[3], "byte_bpe_50k.json"), 0][: one.length]
    assert one.ids_crc32 == zlib.crc32(np.array(whole, "<u4").tobytes())


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack(odd).collect()
    assert len(rows) == 5 and sum(r.doc_id is None for r in rows) == 2
    assert packing.pack(none).count() == 0


def test_equal_rows_are_spread_over_groups(spark):
    """100,000 rows of one id and text make many groups of about the wanted size, and one of large texts more of them."""
    docs = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same few words").alias("text"))
    groups = packing.pack(docs).groupBy(F.shiftright("sequence_id", 40).alias("g")).count().collect()
    assert sum(r["count"] for r in groups) == 100_000 and max(r["count"] for r in groups) < 8192
    long = spark.range(40).select("id", F.repeat(F.lit("word "), 2000).alias("text")).withColumnRenamed("id", "doc_id")
    assert packing.pack(long, group_bytes=50_000).select(F.shiftright("sequence_id", 40)).distinct().count() > 4


def test_an_id_that_repeats_fills_several_shards(spark, tmp_path):
    rows = [(7, f"text number {i}") for i in range(300)] + [(3, "low"), (9, "high")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shards = sst.write_shards(docs, f"file://{tmp_path}/s", shards=4)
    assert max(s[1] for s in shards) < 150
    got = sst.read_shards(spark, shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == [3] + [7] * 300 + [9]
    assert sum(len(sst.look_up(s[0], 7)) for s in shards) == 300


def test_shards_round_trip(docs, corpus):
    rows = sst.round_trip(docs).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(i for i, _ in corpus)
    at = 0
    for r in rows:
        want = [*ids_of(dict(corpus)[r.doc_id], "word_bpe_49k.json"), 1]
        assert r.start == at and r.n_tokens == len(want)
        assert np.frombuffer(r.ids, "<u2").tolist() == want
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += r.n_tokens


def test_shard_look_up_and_damage(spark, docs, corpus, tmp_path):
    shards = sst.write_shards(docs.unionByName(docs.where("doc_id = 5")), f"file://{tmp_path}/s", shards=3)
    assert sum(s[1] for s in shards) == len(corpus) + 1 and not list(tmp_path.glob("s/*.part"))
    for doc, text in corpus[:20]:
        found = [x for s in shards for x in sst.look_up(s[0], doc)]
        assert len(found) == 1 + (doc == 5)
        assert found[0].tolist() == [*ids_of(text, "word_bpe_49k.json"), 1]
    assert [x for s in shards for x in sst.look_up(s[0], 987654)] == []
    path = shards[0][0].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[-60] ^= 255
    with pytest.raises((ValueError, Exception)):
        open(path, "wb").write(data)
        sst.look_up(shards[0][0], 1)


def test_shards_of_odd_rows(odd, none):
    rows = sst.round_trip(odd).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 1, 1]
    assert sst.round_trip(none).count() == 0


def test_keys_sort_as_ids():
    ids = [None, -(1 << 63), -5, 0, 7, (1 << 63) - 1]
    keys = [sst.key_bytes(i) for i in ids]
    assert keys == sorted(keys) and [sst.key_id(k) for k in keys] == ids
