"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline
from gridloom.llm import common, nearcopies

from .test_operators import DOCS, WORD, some_docs


def brute_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_roots(texts):
    """For each text the first of its component."""
    sets, root = [brute_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def near_rows(seed=3):
    """Texts with a few words changed (similarities around 0.8), chains of changes, one common passage, copies, short ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = ["one", "One", "two words", "", " ", "1 2 3 4 5 6"]
    for _ in range(25):
        w = [word() for _ in range(r.choice([30, 150, 400]))] + passage * r.randrange(2)
        texts.append(" ".join(w))
        for _ in range(r.randrange(6)):
            if r.random() < 0.5:
                w = list(w)
            for _ in range(r.choice([1, 2, len(w) // 60 + 1, len(w) // 45 + 1])):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    r.shuffle(texts)
    return [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]


def test_stage_links_similar_texts(spark):
    rows = near_rows()
    roots = brute_roots([t for _, t, *_ in rows])
    assert len(set(roots)) < len(rows) - 20
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "unused")
    assert got.columns == docs.columns
    assert sorted(x.doc_id for x in got.collect()) == sorted(set(roots))


def test_pairs_of_open_buckets_are_checked(spark):
    """Without the second round, nodes of a bucket that aren't near its middle one would stay apart."""
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(12):  # each has changes of its own: neighbours in the chain are similar, its ends aren't
        text = list(base)
        for j in range(k * 3, k * 3 + 10):
            text[j * 6] = f"x{j}"
        rows.append((k, " ".join(text), "en", "a", 0))
    docs = common.cut(nearcopies.with_prints(spark.createDataFrame(rows, DOCS)), "test")
    found = {x.node: x.root for x in nearcopies.linked(docs).collect()}
    nodes = {x.doc_id: found.get(x.node, x.node) for x in docs.select("row.doc_id", "node").collect()}
    roots = brute_roots([t for _, t, *_ in rows])
    for i in nodes:
        for j in nodes:
            assert (nodes[i] == nodes[j]) == (roots[i] == roots[j])


def test_stage_on_the_documents_of_the_pipeline_test(spark):
    """The same rows as test_pipeline.test_stages, whose groups are those of op5 (three words, three bits)."""
    rows = [r for r in some_docs(7, 80) if r[0] is not None and r[1] and any(map(str.isalpha, r[1]))]
    roots = brute_roots([t for _, t, *_ in rows])
    first = {}
    for (i, *_), g in zip(rows, roots, strict=True):
        first[g] = min(first.get(g, i), i)
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "unused")
    assert sorted(x.doc_id for x in got.collect()) == sorted(first.values())


def test_stage_keeps_one_row_of_each_group(spark):
    """Rows that share a doc_id, or have none, are told apart by their texts."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [
        (7, "A", "en", "s", 1), (7, "B", "en", "s", 1),  # unrelated: both stay
        (3, a, "en", "s", 1), (7, a + " copy", "en", "s", 1), (7, b, "en", "s", 1),  # 3 for its copy; b stays
        (None, c, "en", "s", 1), (None, c, "en", "s", 1), (None, c + " end", "en", "s", 1),  # one of the three
        (9, d, None, "s", 1), (9, d, "fr", "z", None), (9, d, "fr", "s", 2), (None, d, "aa", "a", 0),  # nulls last
    ] + [(11, f"text {i} of its own", "en", "s", i) for i in range(30)]
    want = [rows[0], rows[1], rows[2], rows[4], rows[5], rows[10], *rows[12:]]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS).repartition(3), "unused")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
