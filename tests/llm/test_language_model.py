"""The Pitman-Yor model: exact parts by brute force, probabilities that add up, held-out gain over the base."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.llm import language_model as lm
from wayfold.llm import pitman_yor

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """(doc_id, text) -> {doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}"""
    toks = [(d, d is not None and zlib.crc32(str(d).encode()) % 5 == 1, [*WORD.findall((t or "").translate(LOWER)), None]) for d, t in rows]
    count = Counter(w for _, held, ws in toks if not held for w in ws)
    n, v = sum(count.values()), len(count)
    return sorted(((d, held, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for d, held, ws in toks), key=str)


def check(spark, tmp_path, frame):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = lm.op2_lm_score(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute([(r.doc_id, r.text) for r in frame.collect()])
    assert all(math.isfinite(r.score) and r.score < 0 or r.train_tokens == 0 for r in got)
    return got


def test_fixture_tables(spark, tmp_path):
    got = check(spark, tmp_path, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.02 * sum(r.n_tokens for r in held)


def test_finite_on_a_larger_table(spark):
    got = lm.op2_lm_score(spark, "/root/testdata/sf0.1").collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    print(f"held-out gain over the base: {gain:.4f} decimal digits a token")
    assert gain > 0.02


def test_no_more_tables_than_customers():
    rng = np.random.default_rng(2)
    c = rng.integers(0, 6, 5000)
    t = rng.integers(0, 9, 5000)
    got = pitman_yor.draw_tables(rng, pitman_yor.log_stirling(0.5), 0.5, 1.0, c, t, np.full(5000, 3), np.full(5000, 0.1))
    assert ((got >= (c > 0)) & (got <= c)).all()


def test_odd_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TEXT", 500)
    monkeypatch.setattr(lm, "GROUP_TEXT", 700)
    rng = random.Random(1)
    texts = [None, "", "  \n", "The the THE", "é ß 的 " * 40, "x" * 4000, "hot " * 3000] + [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, "null id", "z"), (5, "x x", "z")]
    check(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string, held string").repartition(4))


@pytest.mark.parametrize("rows", [[], [(1, "a b"), (2, None)]])
def test_nothing_to_learn(spark, tmp_path, rows):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = check(spark, tmp_path, spark.createDataFrame([(ids[k], t) for k, (_, t) in enumerate(rows)], "doc_id long, text string"))
    assert len(got) == len(rows)


def one_group(spark, texts):
    """The sampler's steps on one group, in this process: its states after each sweep and the totals after each."""
    frame = spark.createDataFrame([(i, t, held) for i, (t, held) in enumerate(texts)], "doc_id long, text string, held boolean").coalesce(1)
    row = lm.chunk_words(frame).collect()
    assert len(row) == 1
    tops = sorted(((c, h) for c, h in zip(row[0].counts, row[0].words) if c and h != int(lm.END.astype(np.int64))), reverse=True)[: lm.CONTEXTS]
    frequent = np.sort(np.append(np.array([h for _, h in tops], np.int64).view(np.uint64), lm.END))
    p = lm.Pairs(row[0].payload, np.array(row[0].words), frequent, 1)
    w, wi = np.unique(p.known[p.word], return_inverse=True)
    merged = lm.merge(pa.table({"g": [0], "chunk": [row[0].chunk], "blob": [lm.pack(w=w, wi=wi, u=p.context, c=p.count)]}), frequent)
    first = lm.unpack(merged.column("sums")[0].as_py())
    d, d0 = 0.6, 0.5
    group = lm.Group(0, merged.column("state")[0].as_py(), lm._totals(first, first, d0, pitman_yor.log_stirling(d0), 0), d, d0)
    totals = [lm._totals(first, first, d0, pitman_yor.log_stirling(d0), 0)]
    for number in range(3):
        group.sweep(number, totals[-1], pitman_yor.log_stirling(d), pitman_yor.log_stirling(d0))
        sums = {k: np.zeros(n, np.int64) for k, n in lm._EMPTY.items()} | group.sums()
        totals.append(lm._totals(first, sums | {"root_of_listed": totals[-1]["root_of_listed"]}, d0, pitman_yor.log_stirling(d0), number + 1))
    return group, totals[-1]


def test_probabilities_add_up(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    train = [" ".join(rng.choices(vocabulary, weights=range(1, 41), k=rng.randint(5, 60))) for _ in range(30)]
    probes = [f"w7 {x}" for x in [*sorted({w for t in train for w in t.split()}), "never-seen"]] + ["w7"]
    group, totals = one_group(spark, [(t, False) for t in train] + [(t, True) for t in probes])
    by_context = Counter(group.u.tolist())
    u = max(by_context, key=by_context.get)
    assert by_context[u] == totals["vocabulary"] + 1  # w7: every known word, the end and one unknown
    assert abs(group.predictive(totals)[group.u == u].sum() - 1) < 1e-9
    assert ((group.t >= 1) == (group.c >= 1)).all() and (group.t <= group.c).all()


def test_stirling_numbers():
    d, table = 0.4, pitman_yor.log_stirling(0.4, 60)
    # S_d(c, t) by partitions: S(3, 2) = 3 (1 - d), S(3, 1) = (1 - d)(2 - d)
    assert abs(math.exp(table[3, 2]) - 3 * (1 - d)) < 1e-12 and abs(math.exp(table[3, 1]) - (1 - d) * (2 - d)) < 1e-12
    big = pitman_yor.log_stirling(0.7, 256)
    t = np.arange(5, 200, 5)
    exact = big[256, t]
    close = pitman_yor.saddle_log_stirling(0.7, np.full(len(t), 256), t)
    assert np.abs(np.diff(exact - close)).max() / 5 < 0.1  # a few per cent a table where tables are few


def test_gibbs_draws_follow_the_conditional():
    rng = np.random.default_rng(1)
    d, theta, c, others, base = 0.5, 1.0, 6, 4, 0.03
    table = pitman_yor.log_stirling(d)
    weight = np.array([math.exp(table[c, t]) * base**t * math.prod(theta + d * (others + i) for i in range(t)) for t in range(1, c + 1)])
    n = 40_000
    draws = pitman_yor.draw_tables(rng, table, d, theta, np.full(n, c), np.ones(n, int), np.full(n, others), np.full(n, base))
    assert np.abs(np.bincount(draws, minlength=c + 1)[1:] / n - weight / weight.sum()).max() < 0.01
    # beyond the exact range: the Metropolis chain settles where the exact conditional has its mass
    big = pitman_yor.log_stirling(d, 400)
    t = np.arange(1, 401)
    logs = big[400, 1:] + t * math.log(base) + np.cumsum(np.log(theta + d * (others + np.arange(400))))
    p = np.exp(logs - logs.max())
    mean = (t * p).sum() / p.sum()
    now = np.full(3000, 5)
    for _ in range(30):
        now = pitman_yor.draw_tables(rng, table, d, theta, np.full(3000, 400), now, np.full(3000, others), np.full(3000, base))
    assert abs(now.mean() - mean) < 0.1 * mean


def test_rarer_contexts_have_restaurants_of_their_own(spark):
    """Three groups by hand, five listed words: each rarer context has probabilities of its own, which add up."""
    rng, n, d, d0 = random.Random(4), 3, 0.6, 0.5
    vocabulary = [f"w{i}" for i in range(40)]
    train = [" ".join(rng.choices(vocabulary, weights=range(41, 1, -1), k=rng.randint(5, 60))) for _ in range(30)] + ["w30 w31 w30 w31 w30 w31", "w33 w34 w33 w34"]
    known = sorted({w for t in train for w in t.split()})
    probes = [f"{c} {x}" for c in ("w30", "w33") for x in [*known, "never-seen"]] + ["w30", "w33"]
    chunk = lambda rows: lm.chunk_words(spark.createDataFrame([(i, t, held) for i, (t, held) in enumerate(rows)], "doc_id long, text string, held boolean").coalesce(1)).first()
    code = {w: next(np.int64(h).astype(np.uint64) for h in chunk([(w, False)]).words if h != int(lm.END.astype(np.int64))) for w in ("w30", "w31", "w33")}
    row = chunk([(t, False) for t in train] + [(t, True) for t in probes])
    tops = sorted(((c, h) for c, h in zip(row.counts, row.words) if c and h != int(lm.END.astype(np.int64))), reverse=True)[:5]
    frequent = np.sort(np.append(np.array([h for _, h in tops], np.int64).view(np.uint64), lm.END))
    p = lm.Pairs(row.payload, np.array(row.words), frequent, n)
    merged = {g: lm.merge(pa.table({"g": [g], "chunk": [row.chunk], "blob": [lm.message(p.known[p.word[part]], p.context[part], p.known, p.count[part])]}), frequent, n) for g, part in lm.cut_by(p.group, n)}

    def told(links):
        sent = [(x["to"], g, x["blob"]) for g, own in links.items() for x in own[0].as_py()]
        back = [r for to in range(n) if any(x[0] == to for x in sent) for r in lm.settle(pa.table(dict(zip(("to", "g", "blob"), zip(*[x for x in sent if x[0] == to]))))).to_pylist()]
        return {g: [r["blob"] for r in back if r["g"] == g] for g in links}

    def added(sums):
        return {k: sum((s[k] for s in sums if k in s), np.zeros(size, np.int64)) for k, size in lm._EMPTY.items()}

    first = added([lm.unpack(m.column("sums")[0].as_py()) for m in merged.values()])
    totals, inbox = lm._totals(first, first, d0, pitman_yor.log_stirling(d0), 0), told({g: m.column("links") for g, m in merged.items()})
    groups = {g: lm.Group(g, m.column("state")[0].as_py(), totals, d, d0, n).told(inbox[g]) for g, m in merged.items()}
    assert len(groups) == n
    for number in range(3):
        for x in groups.values():
            x.sweep(number, totals, pitman_yor.log_stirling(d), pitman_yor.log_stirling(d0))
        totals = lm._totals(first, added([x.sums() for x in groups.values()]) | {"root_of_listed": totals["root_of_listed"]}, d0, pitman_yor.log_stirling(d0), number + 1)
        for g, replies in told({g: x.links() for g, x in groups.items()}).items():
            groups[g].told(replies)
    after = {}
    for c in ("w30", "w33"):
        own = [(x, x.predictive(totals)[at], at) for x in groups.values() if code[c] in x.rare for at in [x.u == lm._CONTEXTS + np.searchsorted(x.rare, code[c])]]
        assert sum(at.sum() for _, _, at in own) == totals["vocabulary"] + 1  # every known word, the end and one unknown
        assert abs(sum(q.sum() for _, q, _ in own) - 1) < 1e-9
        after[c] = sorted(v for _, q, _ in own for v in q)
    assert after["w30"] != pytest.approx(after["w33"])
