import hashlib
import random
from itertools import groupby, pairwise

import numpy as np

from evidentia.llm import fingerprint as fp

from .conftest import prose


def test_edited_texts_and_neighbours(docs, corpus):
    got = {r.doc_id: r for r in fp.fingerprinted(docs).collect()}
    rows = sorted((i, t or "") for i, t in corpus)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == tuple(fp.fingerprints([text])[0:1] + fp.fingerprints([changed]))
        assert r.near_edited == fp.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fp.likeness(r.fingerprint, fp.fingerprints([after])[0])


def plain_level(names, lengths_power=0x9E3779B97F4A7C15):
    """One level of parsing, symbol by symbol, of a row of 64-bit names."""
    mask, mixed = (1 << 64) - 1, lambda x: int(fp.mix(np.array([x & ((1 << 64) - 1)], np.uint64))[0])
    runs = [(s, len(list(g))) for s, g in groupby(names)]
    symbols = [s if n == 1 else mixed(s + n * lengths_power) for s, n in runs]
    labels = symbols
    for _ in range(4):
        tossed = [labels[0] & 1]
        for left, own in pairwise(labels):
            place = ((left ^ own) & -(left ^ own)).bit_length() - 1
            tossed.append(2 * place + (own >> place & 1))
        labels = tossed
    phrases = [[symbols[0]]]
    for i in range(1, len(symbols)):
        peak = labels[i] > labels[i - 1] and labels[i] >= (labels[i + 1] if i + 1 < len(labels) else 0)
        if peak and i > 1:
            phrases.append([])
        phrases[-1].append(symbols[i])
    base = lengths_power | 1
    return [mixed(sum(mixed(s) * pow(base, k, 1 << 64) for k, s in enumerate(p)) % (mask + 1) + len(p)) for p in phrases]


def plain_fingerprint(text):
    if not text:
        return ""
    step, parts = 0x9E3779B97F4A7C15, []
    names = [int(fp.mix(np.array([(ord(c) + 1) * step & ((1 << 64) - 1)], np.uint64))[0]) for c in text]
    for _ in range(4):
        names = plain_level(names)
        parts.append("".join(f"{n:08x}" for n in sorted({n >> 32 for n in names})[:24]))
    return ".".join(parts)


def test_fingerprints_equal_the_parsing_symbol_by_symbol():
    rng = random.Random(9)
    for text in ["", "a", "ab", "aaaa", "abababab", "é漢\U0001f600 x", *(prose(rng, rng.randint(1, 80)) for _ in range(25))]:
        assert fp.fingerprints([text]) == [plain_fingerprint(text)], text


def test_whole_query_equals_brute_force(docs, corpus):
    got = {r.doc_id: r for r in fp.fingerprinted(docs).collect()}
    rows = [(i, t or "") for i, t in sorted(corpus) if len(t or "") < 3000]
    texts = dict(sorted((i, t or "") for i, t in corpus))
    order = list(texts)
    for i, text in rows:
        after = texts[order[(order.index(i) + 1) % len(order)]]
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (plain_fingerprint(text), plain_fingerprint(changed))


def test_fingerprints_do_not_depend_on_the_batch():
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 200)) for _ in range(50)] + ["", "a", "aa", "ababab", "a" * 1000, "é漢\U0001f600"]
    assert fp.fingerprints(texts) == [fp.fingerprints([t])[0] for t in texts]


def test_equal_substrings_share_interior_names():
    rng = random.Random(2)
    core = prose(rng, 300)
    a, b = fp.phrase_levels([prose(rng, 20) + core, prose(rng, 33) + "x" + core], 3)[2]
    inside = set(a.tolist()) & set(b.tolist())
    assert len(inside) > 0.8 * len(fp.phrase_levels([core], 3)[2][0])


def test_parse_levels_shrink():
    rng = random.Random(3)
    text = prose(rng, 500)
    sizes = [len(level[0]) for level in fp.phrase_levels([text], 4)]
    assert all(2 <= a / b <= 6 for a, b in zip([len(text), *sizes], sizes, strict=False))
    assert [len(level[0]) for level in fp.phrase_levels(["aaaaaaaa"], 3)] == [1, 1, 1]


def test_likeness_follows_what_texts_share():
    rng = random.Random(4)
    for _ in range(5):
        a, b = prose(rng, 400), prose(rng, 400)
        near, same = fp.likeness(*fp.fingerprints([a, fp.edited(a, b)])), fp.likeness(*fp.fingerprints([a, a]))
        far = fp.likeness(*fp.fingerprints([a, b]))
        assert same == 1 and far < 0.15 < near < 0.6
    assert fp.likeness("", "") == 1 and fp.likeness("", fp.fingerprints(["abc"])[0]) == 0


def test_odd_rows(spark, odd, none):
    assert fp.fingerprinted(odd).count() == 5
    assert fp.fingerprinted(none).count() == 0
    one = fp.fingerprinted(spark.createDataFrame([(7, "a single text stands before itself")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_blocks_follow_the_bytes(spark, monkeypatch):
    """Where few keys are drawn and bytes ask for more blocks, more keys are drawn; neighbours stay the same."""
    from collections import Counter

    import pandas as pd
    from pyspark.sql import functions as F

    from evidentia.llm import common

    rows = [(i * 7 % 1000, "x" * 50) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, t string")

    def pairs(frames):
        block, before, out = None, None, []
        for frame in frames:
            for k, b, role in zip(frame["k"], frame["__ev_block"], frame["__ev_role"], strict=True):
                if b != block:
                    block, before = b, None
                if before is not None:
                    out.append((before, k, b))
                before = k if role <= 0 else None
        yield pd.DataFrame(out, columns=["a", "b", "block"])

    def found(**patched):
        for name, value in patched.items():
            monkeypatch.setattr(common, name, value)
        got = common.with_neighbours(df, "k", F.length("t"), pairs, "a long, b long, block int", before=False, block_bytes=500).collect()
        assert sorted((r.a, r.b) for r in got) == [(i, i + 1) for i in range(999)]
        return Counter(r.block for r in got)

    few, many = found(DRAWN_KEYS=16, MOST_KEYS=16), found(DRAWN_KEYS=16, MOST_KEYS=1 << 18)
    assert len(few) <= 5 and len(many) > 60 and max(many.values()) < 60
