"""Suffix-array dedup against a set of all windows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wayfold.llm import exchange, repeats

SF = "/root/testdata/sf0.001"


def brute(rows, length):
    """rows: (doc_id, text) in reading order -> (n_bytes, n_removed, n_spans, kept_sha256) of each."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if (w := data[i : i + length]) in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        out.append((len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


def check(spark, frame, length):
    rows = sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = repeats.dedup(frame, length, digest=("b", "r", "s", "h")).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    want = brute(rows, length)
    assert [(r.b, r.r, r.s, r.h) for r in got] == want
    return got, want


def test_fixture_tables(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    got, want = check(spark, frame, 100)
    assert sum(w[1] for w in want) > 1000
    assert [c for c in got[0].asDict()][:5] == frame.columns


@pytest.mark.parametrize("seed", range(4))
def test_periodic_and_nested(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE_BYTES", 900)
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 300))) for _ in range(6)]
    texts = [None, "", "a" * 700, "ab" * 400, "abc" * 99 + "x" + "abc" * 99, "é" * 260]
    for _ in range(40):
        a, b = rng.choice(base), rng.choice(base)
        i = rng.randint(0, len(a))
        texts.append(a[:i] + b + a[i:] + rng.choice(["", "z", a]))
    rng.shuffle(texts)
    frame = spark.createDataFrame([(i if i != 3 else None, t, "k", i) for i, t in enumerate(texts)], "doc_id long, text string, g string, chunk long").repartition(3)
    check(spark, frame, 100)


def test_small_chunks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", 4000)
    monkeypatch.setattr(exchange.chunk_table, "__defaults__", (3000,))
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    texts = [t + passage[: rng.randint(0, 300)] + t[:150] if i % 2 else t for i, t in enumerate(texts)] + texts[:7] + [passage * 30]
    check(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), 100)


def test_repeated_rows_and_empty_table(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(400)) + "".join(chr(97 + (i * 7) % 25) for i in range(100))
    frame = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = repeats.dedup(frame, digest=("b", "r", "s", "h")).collect()
    assert sorted(r.r for r in got)[1:] == [500, 500] and min(r.r for r in got) < 500
    assert repeats.dedup(frame.limit(0)).count() == 0


def test_texts_that_cheat_a_power_of_two(spark):
    """The Thue-Morse pattern and its complement have one polynomial hash modulo 2^64, but are different bytes."""
    thue = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    other = thue.translate(str.maketrans("ab", "ba"))
    frame = spark.createDataFrame([(1, thue), (2, other), (3, "é" * 70 + thue[:2048]), (4, "é" * 70 + other[:2048]), (5, other)], "doc_id long, text string")
    check(spark, frame, 100)


def test_hash_collisions_are_harmless(spark, monkeypatch):
    """In the suffix array all strings meet under one hash."""
    import numpy as np

    monkeypatch.setattr(repeats, "mix", lambda h: h * np.uint64(0))
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(600)), np.uint8)
    for depth in (5, 8, 9, 16, 19):
        k, rank = repeats.suffix_ranks(data, np.arange(len(data) - depth + 1), depth)
        own = [data[i : i + depth].tobytes() for i in k.tolist()]
        every = [data[i : i + depth].tobytes() for i in range(len(data) - depth + 1)]
        assert sorted(k.tolist()) == [i for i, w in enumerate(every) if every.count(w) > 1]
        assert own == sorted(own) and all((a == b) == (x == y) for a, b, x, y in zip(own, own[1:], rank.tolist(), rank.tolist()[1:]))


def test_long_text(spark):
    """Beyond a stretch of the hash and a chunk, with repeats across stretches and characters of several bytes."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdéß的") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    passage = " ".join(rng.choice(words) for _ in range(200))
    long = " ".join(rng.choice(words) for _ in range(160_000))
    frame = spark.createDataFrame([(1, passage), (2, long + passage + long[:5000] + passage), (3, None), (4, long[-40_000:])], "doc_id long, text string")
    check(spark, frame, 100)


def test_maximal_repeats():
    found = {w: at for w, at in repeats.maximal_repeats([b"xabcdefgyabcdefz", b"qabcdefg", b"cdeq"], 4)}
    assert found == {b"abcdefg": [(0, 1), (1, 1)], b"abcdef": [(0, 1), (0, 9), (1, 1)]}
    assert repeats.maximal_repeats([], 4) == [] and repeats.maximal_repeats([b"aaaa"], 9) == []
    # every repeat, by brute force
    rng = random.Random(4)
    for _ in range(30):
        corpus = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(4)]
        where: dict[bytes, list] = {}
        for t, text in enumerate(corpus):
            for i in range(len(text)):
                for j in range(i + 5, len(text) + 1):
                    where.setdefault(text[i:j], []).append((t, i))
        want = {}
        for w, at in where.items():
            left = {corpus[t][i - 1] if i else (t, i) for t, i in at}
            right = {corpus[t][i + len(w)] if i + len(w) < len(corpus[t]) else (t, i) for t, i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want[w] = at
        assert {w: at for w, at in repeats.maximal_repeats(corpus, 5)} == want
