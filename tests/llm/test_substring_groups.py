"""Groups of op7's second phase stay bounded under a hot passage, and the result stays whole."""

import random

import numpy as np
import pyarrow as pa
import pytest

from docaudit.llm import substring

WINDOW, GRAM = 6, 3


def hot_docs():
    """One passage of GRAM words with ever new words before and after it; some whole texts come again."""
    r = random.Random(4)
    docs = [f"{r.randrange(10**6)} a{r.randrange(50)} p q r b{r.randrange(50)} {r.randrange(10**6)} c d e" for _ in range(400)]
    return list(enumerate(docs + docs[:30]))


@pytest.mark.parametrize("bound", [3, 10**6])
def test_hot_passage_brute_force(spark, bound):
    docs = hot_docs()
    seen, want = set(), {}
    for i, text in docs:
        words, gone = text.split(), set()
        for s in range(len(words) - WINDOW + 1):
            w = tuple(words[s : s + WINDOW])
            if w in seen:
                gone.update(range(s, s + WINDOW))
            seen.add(w)
        want[i] = [w for p, w in enumerate(words) if p not in gone]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    got = {r["doc_id"]: r["kept_text"].split() for r in substring.remove_repeats(df, window=WINDOW, gram=GRAM, bound=bound).collect()}
    assert got == want


def test_counted_anchors_split_by_label():
    docs = hot_docs()
    column = pa.array([t for _, t in docs])
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([0] * len(docs)), column], names=["d", "t", "text"])
    rows = pa.Table.from_batches(list(substring._anchor_rows(WINDOW, GRAM)(iter([batch]))))
    rows = rows.sort_by("route").combine_chunks()
    again = pa.Table.from_batches(list(substring._repeated_anchors(10)(iter(rows.to_batches()))))
    hot = np.sort(np.array(again.column("hot").drop_null().to_pylist(), np.int64).view(np.uint64))
    assert len(hot)
    places = pa.array([list(range(len(t.split()))) for _, t in docs], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([*batch.columns, places], names=["d", "t", "text", "places"])
    largest = []
    for split in (hot[:0], hot):
        out = pa.Table.from_batches(list(substring._label_rows(WINDOW, GRAM, split)(iter([batch]))))
        sizes = {}
        for route, n, labels in zip(*(out.column(c).to_pylist() for c in ("route", "n", "labels")), strict=True):
            if labels is not None:
                sizes[route] = sizes.get(route, 0) + n
        largest.append(max(sizes.values()))
    assert largest[0] > 100 and largest[1] <= 10 * (WINDOW - GRAM + 1)


def test_texts_of_null_and_repeated_ids_stay_apart(spark):
    """6000 texts without a repeat and without ids: none loses a word."""
    texts = [" ".join(f"{i}w{k}" for k in range(25)) for i in range(6000)]
    df = spark.createDataFrame([(None if i % 2 else 5, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert substring.remove_repeats(df).where("n_removed > 0").count() == 0


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    same = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, same), (2, "x " + same)], "doc_id bigint, text string").withColumns({c: F.lit(c) for c in ("t", "d", "c0", "c1", "place", "__d", "__t", "__spans", "l_d", "n_chars", "a.b")})
    for got in (substring.remove_repeats(df), substring.cut_repeats(df)):
        rows = {r["doc_id"]: r for r in got.collect()}
        assert all(rows[2][c] == c for c in ("t", "d", "c0", "c1", "place", "__d", "__t", "__spans", "l_d", "a.b"))
    assert rows[2]["text"] == "x" and substring.cut_repeats(df).columns == df.columns
