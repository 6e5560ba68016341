"""The pipeline stage by stage against brute force."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import common

from .test_nearcopies import brute_roots
from .test_operators import order, rule, some_docs

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


ODD = ("size", "fp", "ids", "u", "key", "place", "copies", "_range", "score", "lang_pred", "bits_per_byte", "row", "node", "_node", "_size", "n", "root", "bytes")


def test_stages(spark):
    """Nulls in every column, repeated ids, long texts, and names that the stages use themselves."""
    rows = [*some_docs(7, 80), (5000, "write to some.one@example.org or not", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ODD})
    state = {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.cut(stage(spark, docs, "unused"), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == [*COLUMNS, *ODD]
        state[name], docs = out.collect(), out
    kept = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    assert sorted((r.doc_id for r in state["language_id"]), key=order) == sorted((r[0] for r in kept), key=order)
    first = {}
    for r, g in zip(kept, brute_roots([r[1] for r in kept]), strict=True):
        first[g] = min(first.get(g, r[0]), r[0], key=lambda x: (x is None, x or 0))
    assert sorted((r.doc_id for r in state["simhash_near_dedup"]), key=order) == sorted(first.values(), key=order)
    assert len(state["pii"]) == len(state["simhash_near_dedup"])
    masked = {r.doc_id: r for r in state["pii"]}
    assert masked[5000].text == "write to <EMAIL> or not"
    assert all(r.n_chars == len(r.text) for r in state["pii"])
    mixed = [r.doc_id for r in state["mixing"]]
    assert set(mixed) <= set(masked)
    assert max(mixed.count(i) for i in mixed) <= 2
    words = {}
    for r in state["pii"]:
        words[r.source] = words.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    exact = rule()
    assert sorted((r.doc_id for r in state["byte_bpe"]), key=order) == sorted(mixed, key=order)
    for r in state["byte_bpe"]:
        assert r.text == masked[r.doc_id].text
        assert list(r.ids) == exact.encode_ordinary(r.text)
        assert r.n_tokens == len(r.ids)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
    assert docs.count() == 0
