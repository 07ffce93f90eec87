"""The pipeline's near-copy stage against brute-force Jaccard similarity."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docaudit.llm import simhash, similar

SF = "/root/testdata/sf0.001"


def brute_groups(docs):
    """doc_id -> least doc_id of its group."""
    sets = {}
    for i, text in docs:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = find(i), find(j)
                least[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def made(seed):
    """Chains and groups of edited copies, around the bound, beside short, empty and equal texts."""
    r = random.Random(seed)
    texts = ["", None, "one two", "One Two", "a b c d e"]
    for _ in range(12):
        words = [r.choice("abcdefghijkl") * r.randrange(1, 9) for _ in range(r.randrange(5, 120))]
        for _ in range(r.randrange(1, 12)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(r.randrange(0, 1 + len(words) // 30)):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_brute_force(spark, seed):
    docs = made(seed)
    want = brute_groups(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert {r["doc_id"] for r in simhash.keep_one(df, by_similarity=True).collect()} == set(want.values())
    groups = {}
    for r in similar.near_copies(df).collect():
        groups.setdefault(r["group"], set()).add(r["doc_id"])
    assert {i: min(g) for g in groups.values() for i in g} == want


@pytest.mark.parametrize("options", [{"bound": 0}, {"per_set": 0}, {"bound": 0, "per_set": 0, "few": -1.0}])
def test_hot_shingles_brute_force(spark, options):
    """Every frequent shingle hot, every group crowded, and all hub rounds: the same groups."""
    docs = made(3) + [(1000 + i, f"p{i} " + " ".join(f"w{k}" for k in range(60)) + (f" q{i}" if i % 3 else "")) for i in range(40)]
    want = brute_groups(docs)
    groups = {}
    for r in similar.near_copies(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), **options).collect():
        groups.setdefault(r["group"], set()).add(r["doc_id"])
    assert {i: min(g) for g in groups.values() for i in g} == want


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "a b", 3), (None, "a b", 3), (3, "A  B", 4), (4, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __id bigint").withColumns({c: F.lit("clash") for c in ("key", "n", "__key", "root")})
    kept = simhash.keep_one(df, by_similarity=True)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    assert simhash.keep_one(df.limit(0), by_similarity=True).count() == 0


def test_stage_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    rows = corpus_pipeline.STAGES[1][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    assert {r["doc_id"] for r in rows} == set(brute_groups(docs).values())


def test_sketches_bound_the_overlap():
    """Cells' least counts never fall below the common shingles; unlike sets of one size are told apart."""
    r = random.Random(5)
    texts = ["", "one two"]
    for n in (5, 40, 300, 5000):
        words = [f"w{r.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(words), " ".join(words[: n * 9 // 10] + [f"x{k}" for k in range(n // 10)]), " ".join(f"y{k}" for k in range(n))]
    text, shingle, _, n = similar.shingle_sets(pa.array(texts), 5)
    found = [np.frombuffer(x.as_buffer(), np.uint8) for x in similar.sketches(text, shingle, n)]
    assert [int(x.sum()) for x in found] == n.tolist()
    sets = [set(shingle[text == i].tolist()) for i in range(len(texts))]
    for i, a in enumerate(found):
        for j, b in enumerate(found):
            cells = min(len(a), len(b))
            least = int(np.minimum(similar._folded(a, cells), similar._folded(b, cells)).sum())
            assert least >= len(sets[i] & sets[j])
            if i != j and n[i] == n[j] > 200 and not sets[i] & sets[j]:
                assert 9 * least < 4 * (n[i] + n[j])


def test_full_cell_gives_no_sketch():
    same = np.zeros(300, np.uint64)  # one hash three hundred times
    assert similar.sketches(np.zeros(300, np.int64), same, np.array([300])).to_pylist() == [None]
    assert similar.sketches(np.zeros(0, np.int64), same[:0], np.zeros(0, np.int64)).to_pylist() == []
    rows = pa.RecordBatch.from_arrays([pa.array([1, 3]), pa.array([2, 4]), pa.array([None, b"\1"]), pa.array([b"\1", b"\7"])], names=["a", "b", "x", "y"])
    assert [x.to_pydict() for x in similar._possible(iter([rows]))] == [{"a": [1], "b": [2]}]


def test_hot_groups_make_rows_in_proportion(spark, monkeypatch):
    """Copies of one text, some linked only to it, some to nothing, all in hot shingles: pairs and links stay few."""
    r, base = random.Random(7), [f"w{k}" for k in range(100)]
    docs = [(0, " ".join(base))]
    for i in range(1, 150):
        words = list(base)
        for k in r.sample(range(100), 2 if i % 3 else 7):
            words[k] = f"x{i}_{k}"
        docs.append((i, " ".join(words)))
    want, made, write = brute_groups(docs), [], similar.materialise

    def counted(df, name):
        out = write(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(similar, "materialise", counted)
    groups = {}
    for x in similar.near_copies(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), bound=0, per_set=0).collect():
        groups.setdefault(x["group"], set()).add(x["doc_id"])
    assert {i: min(g) for g in groups.values() for i in g} == want
    assert max(n for name, n in made if name in ("pairs", "possible-pairs", "links")) <= 10 * len(docs)


def test_class_in_blocks(spark):
    """A class dealt in pairs of blocks: the same groups."""
    docs = made(4) + [(1000 + i, " ".join(f"w{k}" if (k * 7 + i) % 40 else f"p{i}" for k in range(80))) for i in range(40)]
    groups = {}
    for r in similar.near_copies(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), bound=0, per_set=0, block=6).collect():
        groups.setdefault(r["group"], set()).add(r["doc_id"])
    assert {i: min(g) for g in groups.values() for i in g} == brute_groups(docs)


@pytest.mark.parametrize("cells", [1 << 22, 50])
def test_spanning_brute_force(monkeypatch, cells):
    """Stars join what links between sets join, at the bound too, in one piece or in many."""
    monkeypatch.setattr(similar, "_CELLS", cells)
    r = random.Random(cells)
    for _ in range(30):
        base, sets = r.sample(range(60), r.randrange(8, 30)), []
        for _ in range(r.randrange(2, 40)):
            own = set(base)
            for _ in range(r.randrange(0, 5)):
                own.discard(r.choice(base))
                own.add(r.randrange(60))
            sets.append(own)
        sets.sort(key=len)
        root = np.array([r.randrange(100, 100 + len(sets)) for _ in sets])
        first = np.cumsum([0] + [len(x) for x in sets])
        a, b = similar._spanning(root, first, np.concatenate([sorted(x) for x in sets]))
        least = {x: x for x in root.tolist()}

        def find(x, least=least):
            while least[x] != x:
                x = least[x]
            return x

        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if 9 * len(x & y) >= 4 * (len(x) + len(y)):
                    p, q = find(int(root[i])), find(int(root[j]))
                    least[max(p, q)] = min(p, q)
        want = len({find(int(x)) for x in root})
        assert all(find(int(root[i])) == find(int(root[j])) for i, j in zip(a, b, strict=True))
        assert len(set(root.tolist())) - len(a) == want
