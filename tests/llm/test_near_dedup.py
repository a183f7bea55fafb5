"""Near-dedup against all pairs."""

import random
import re

from pyspark.sql import functions as F

from wayfold.llm import components, near_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=4):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least[root(i)] if d is not None else None, d is None or d == least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def check(frame):
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(frame).collect()), key=str)
    want = brute(rows)
    assert got == want
    return want


def test_fixture_tables(spark):
    want = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5))
    assert sum(not w[3] for w in want) > 50


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_odd_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "ONE", "one two three", "One  two\tthree", "a b c d", "a b c d e", "b c d e"] + family(rng, 30, 120, 4) + ["y " * 5000, "Y " * 6000]
    rows = [(i, t, 1.5) for i, t in enumerate(texts)] + [(None, texts[12], 0.0), (None, None, 0.0), (12, texts[12], 0.0), (3, texts[20], 0.0), (3, "quite another text of its own", 0.0)]
    check(spark.createDataFrame(rows, "doc_id long, text string, component_id double"))


def test_large_families(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 6)
    monkeypatch.setattr(near_dedup, "BLOCK", 12)
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = family(rng, 120, 150, 5) + family(rng, 60, 90, 2) + [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(30)) for _ in range(50)] + family(rng, 40, 30, 1) * 2
    rng.shuffle(texts)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))


def test_dedup_keeps_columns(spark):
    frame = spark.createDataFrame([(4, "a b c d e", "x"), (2, "A b c d e", "y"), (9, "other text of words", "z"), (None, "a b c d e", "n")], "doc_id long, text string, lost_id string")
    kept = near_dedup.dedup(frame)
    assert kept.columns == frame.columns and sorted(kept.collect(), key=str) == sorted([(2, "A b c d e", "y"), (9, "other text of words", "z"), (None, "a b c d e", "n")], key=str)
    assert near_dedup.dedup(frame.limit(0)).count() == 0


def test_dedup_is_by_row(spark):
    v, t, u, w = "a b c d e f g h", "one two three four five six", "quite another text of its own", "the last text that is left here"
    rows = [(1, t, "a"), (3, t, "b"), (3, u, "c"), (5, v, "d"), (5, v, "e"), (6, v, "f"), (7, "", "g"), (7, None, "h"), (7, "  ", "i"), (8, w, "j"), (8, w.upper(), "k"), (None, v, "l"), (None, v, "m")]
    for parts in (1, 5):
        kept = near_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(parts)).collect()
        assert sorted((r.doc_id, r.text) for r in kept if r.doc_id and r.doc_id < 7) == [(1, t), (3, u), (5, v)]
        assert sorted((r.text or "") for r in kept if r.doc_id == 7) == ["", "  "] and len([r for r in kept if r.doc_id == 8]) == 1
        assert sorted(r.digest for r in kept if r.doc_id is None) == ["l", "m"]


def test_words_that_cheat_a_power_of_two(spark):
    thue = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = thue.translate(str.maketrans("ab", "ba"))
    assert len(near_dedup.shingle_sets(__import__("numpy").frombuffer(thue.encode(), "uint8"), __import__("numpy").array([0, 2048]), 4)) == 1
    check(spark.createDataFrame([(1, thue), (2, other), (3, f"x {thue}"), (4, f"x {other}")], "doc_id long, text string"))


def test_recall_at_the_threshold(spark):
    """Pairs just over 0.8 are all found, among many families."""
    rng = random.Random(11)
    rows = []
    for k in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(203)]
        copy = list(base)
        for i in rng.sample(range(10, 200, 10), 5):  # 200 shingles, 20 differ: 180 / 220
            copy[i] = f"x{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[2 * k + 1] == 2 * k for k in range(300))
    print(f"links found at a similarity of 0.818: {found} of 300")
    assert found >= 299


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 164)] + [(7, 3), (3, 3), (9, 7), (9, 7)] + [(500, 600 + i) for i in range(200)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components.connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {i for i in parent if all(i not in e or e[0] == e[1] for e in edges)}
    assert got == {i: root(i) for i in parent if i not in alone}
    assert components.connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
