"""Helpers of the operators against plain versions: shared starts of paths, heavy keys."""

from __future__ import annotations

import os

import numpy as np

from siftstone.llm import html_text, suffix_dedup


def test_shared_start_of_paths(spark):
    rng = np.random.default_rng(3)
    rows = [("", ""), ("a", ""), (None, "a"), ("a", None), ("é😀x", "é😀y"), ("x" * 3000 + "a", "x" * 3000 + "b"), ("same", "same")]
    rows += [tuple("".join(rng.choice(list("ab"), rng.integers(0, 20))) for _ in range(2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", html_text._shared_prefix("a", "b").alias("n"))
    for a, b, n in df.collect():
        assert n == (0 if a is None or b is None else len(os.path.commonprefix([a, b])))


def test_heavy_keys_are_bounded(spark, monkeypatch):
    text = " ".join(f"word{k % 50} and {k * k}" for k in range(4000))
    docs = spark.createDataFrame([(k, text[k * 10 :]) for k in range(20)], "doc_id long, text string")
    total = docs.selectExpr("sum(octet_length(text)) AS n").first()["n"]
    monkeypatch.setattr(suffix_dedup, "HEAVY_BYTES", 1000)
    found = suffix_dedup.heavy_keys(docs.select(docs.text.cast("binary")), total)
    monkeypatch.setattr(suffix_dedup, "HEAVY_KEYS", 10)
    fewer = suffix_dedup.heavy_keys(docs.select(docs.text.cast("binary")), total)
    assert 20 >= len(fewer[0]) < len(found[0]) and len(fewer[1]) <= 20
    assert set(fewer[0]) <= set(found[0])
    spans = [sorted((r.doc, tuple(r.spans)) for r in suffix_dedup.repeated_spans(docs)[0].collect())]
    monkeypatch.undo()
    spans.append(sorted((r.doc, tuple(r.spans)) for r in suffix_dedup.repeated_spans(docs)[0].collect()))
    assert spans[0] == spans[1] != []


def test_ids_have_to_be_whole_numbers(spark):
    import pytest

    with pytest.raises(ValueError, match="whole"):
        suffix_dedup.repeated_spans(spark.createDataFrame([("a", "text")], "doc_id string, text string"))
