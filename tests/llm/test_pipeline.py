"""The pipeline's stages, each against brute force on its own input."""

import hashlib

import pytest

import corpus_pipeline
from wayfold.llm import quality, repeats

from .test_near_dedup import brute as brute_groups
from .test_repeats import brute as brute_repeats
from .test_row_operators import brute_contamination, brute_rules, tiktoken_encoding

SF = "/root/testdata/sf0.001"


def odd_frame(spark):
    """Nulls in every column, blank, long and repeated texts, repeated ids, and columns named like working columns."""
    words = [f"w{i}" for i in range(400)]
    good = " ".join(words[:300])
    texts = [None, "", " \n", good, good, good + " tail", "é" * 70_000, " ".join(words[100:380]) + " " + good, "x " * 3000]
    rows = [(i if i != 3 else 4, t, None if i % 2 else "en", None, None if i % 3 else len(t or ""), f"k{i}", i, "c", i % 2 == 0) for i, t in enumerate(texts)]
    rows += [(None, good, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_key string, chunk long, kept string, lost_id boolean")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, name, stage):
    frame = odd_frame(spark)
    for docs in (frame, frame.repartition(3), frame.limit(0)):
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert len(rows) <= docs.count()
        if name == "tokens":
            assert len(rows) == docs.count() and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} <= set(out.columns)
        else:
            assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
        if docs.count() and name == "near_duplicates":
            assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 4 for r in rows) == 1
        if docs.count() and name in ("repeated_passages", "benchmark_passages"):
            assert len(rows) == docs.count()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == docs.columns
        after = {r.doc_id: r for r in out.collect()}
        if name == "quality_rules":
            verdict = {r.doc_id: r.kept for r in quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert set(after) == {i for i, kept in verdict.items() if kept}
            for i, r in before.items():
                n, _, _, _, rep = brute_rules(r.text)
                assert not (i in after and (n < 50 or 100 * rep > 50 * n))
        elif name == "near_duplicates":
            assert set(after) == {d for d, _, _, kept in brute_groups([(r.doc_id, r.text) for r in before.values()]) if kept}
        elif name == "repeated_passages":
            rows = sorted((i, r.text) for i, r in before.items())
            for (i, _), (_, _, _, sha) in zip(rows, brute_repeats(rows, 100)):
                if not after[i].text.isascii() or not before[i].text.isascii():
                    continue
                assert hashlib.sha256(after[i].text.encode()).hexdigest() == sha and after[i].n_chars == len(after[i].text)
            assert len(after) == len(before)
        elif name == "benchmark_passages":
            assert set(after) == {i for i, r in before.items() if not brute_contamination(r.text, bench)[4]}
        else:
            enc = tiktoken_encoding()[2]
            assert {i: r.ids for i, r in after.items()} == {i: enc.encode_ordinary(r.text) for i, r in before.items()}
            break
        docs, before = spark.createDataFrame(list(after.values()), docs.schema), after
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(after)
