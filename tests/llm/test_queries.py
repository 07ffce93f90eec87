"""The registered queries against SQL, brute force, the tokenizers library or held-out labels."""

import html as stdlib_html
import os
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from docaudit.llm import bpe, graph, html, page_samples, quality, queries, rules, simhash, substring, toxicity
from docaudit.llm.labelled import held_out
from test_similar import brute_groups

SF = "/root/testdata/sf0.001"
BIGGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(repr, (r[c] for c in columns))) for r in df.collect()) == sorted(tuple(repr(r[i]) for i in at) for r in want.fetchall())


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def brute_components(prints, radius=4):
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_brute_force(spark):
    prints = {i: brute_fingerprint(t) for i, t in documents()}
    want = brute_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op3_simhash(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize(("n", "near"), [(30, 10), (400, 150), (2500, 1500)])
def test_gray_index_brute_force(n, near):
    r = random.Random(n)
    fps = [r.getrandbits(64) for _ in range(n)]
    for i in range(1, near):
        fps[i] = fps[r.randrange(i)]
        for b in r.sample(range(64), r.randrange(1, 6)):
            fps[i] ^= 1 << b
    distinct = np.unique(np.array(fps, np.uint64))
    a, b = simhash.link_stars(distinct)
    label = {int(x): int(x) for x in distinct} | dict(zip(map(int, a), map(int, b), strict=True))
    groups = {}
    for x, root in label.items():
        groups.setdefault(root, set()).add(x)
    want = {}
    for x, root in brute_components({int(x): int(x) for x in distinct}).items():
        want.setdefault(root, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_band_keys_lose_no_pair(spark):
    r = random.Random(5)
    pairs = []
    for _ in range(300):
        a, b = (x := r.getrandbits(63)), x
        for bit in r.sample(range(63), r.randrange(0, 5)):
            b ^= 1 << bit
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for n in (10, 10**6, 10**8):
        bands, choices = simhash.band_plan(n)
        assert df.where(~F.arrays_overlap(simhash.bucket_keys(F.col("a"), bands, choices), simhash.bucket_keys(F.col("b"), bands, choices))).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["root"] for r in graph.stars(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 140)}, 201: 200}


def test_bpe_equals_library():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    mine, theirs = bpe.Bpe(open(path, "rb").read()), Tokenizer.from_file(path)
    r = random.Random(3)
    texts = [t for _, t in documents()[:60]] + ["", "a" * 3000, "<|endoftext|>x<|endoftext|>", " \x1c\x85 q", "it's 'S ½ Ⅷ 🙂"]
    texts += ["".join(r.choice("ab \n\tAé漢🙂's<|>1\x0b　") for _ in range(150)) for _ in range(200)]
    for text, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.encode(text) == e.ids and mine.decode(e.ids) == theirs.decode(e.ids, skip_special_tokens=False)


def test_substring_small_windows_brute_force(spark):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(0, 40)))) for i in range(40)]
    seen, gone = set(), {}
    for i, text in docs:
        words = text.split()
        gone[i] = set()
        for s in range(len(words) - 5):
            w = tuple(words[s : s + 6])
            if w in seen:
                gone[i].update(range(s, s + 6))
            seen.add(w)
    got = substring.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7), window=6, gram=3)
    for row in got.collect():
        words = dict(docs)[row["doc_id"]].split()
        assert (row["n_words"], row["n_removed"]) == (len(words), len(gone[row["doc_id"]]))
        assert row["kept_text"].split() == [w for p, w in enumerate(words) if p not in gone[row["doc_id"]]]


def test_html_pages():
    pages = duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()
    field = html.default_field()
    for (page,) in pages:
        body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
        parts = [" ".join(stdlib_html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert field.text(page) == "\n".join(p for p in parts if p)


def test_html_held_out_layouts():
    field = html.default_field()
    right = total = 0
    for seed in range(50_000, 50_150):
        page, labels = page_samples.labelled_page(seed)
        found = html.blocks(page)
        if len(found) == len(labels):
            right += sum(a == b for a, b in zip(field.decode(found), labels, strict=True))
            total += len(labels)
    assert total > 2000 and right / total > 0.98


def test_binomial_tail(spark):
    from math import comb

    cases = [(k, n) for n in (10, 200, 1500) for k in range(0, max(1, n // 100 + 1))]
    df = spark.createDataFrame(cases, "k bigint, n bigint").select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(sum(comb(r["n"], i) * 0.02**i * 0.98 ** (r["n"] - i) for i in range(r["k"] + 1)), rel=1e-9)


def test_rules_reject_with_enough_labels(spark):
    clean = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(" ".join(f"w{i}###" for i in range(60)))).otherwise(F.lit(clean)).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    kept = {r["doc_id"] for r in rules.quality_rules(docs, labels).where("kept").collect()}
    assert kept == {i for i in range(3000) if i % 3}


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality_classifier", "quality", 0.98), ("op9_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.queries()[name](spark, BIGGER)
    labels = spark.read.parquet(f"{BIGGER}/labels.parquet").select("doc_id", label)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r[label] for r in rows) / len(rows) >= least


def test_held_out_fold(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in range(-5, 200)], "d bigint").select("d", held_out(F.col("d")).alias("h"))
    assert all(r["h"] == (zlib.crc32(str(r["d"]).encode()) % 5 == 0) for r in df.collect())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    columns = docs.columns
    texts = dict(documents())
    good = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert good.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert all(i in kept for i, q in labels.items() if q == 1)
    one = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    want = set(brute_groups(documents()).values())  # five-word shingles, similarity 0.8
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == columns
    cut = corpus_pipeline.STAGES[2][1](spark, docs, SF)
    rows = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == columns and set(rows) == set(texts) and all(r["n_chars"] == len(r["text"]) for r in rows.values())
    clean = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    hit = {r["doc_id"] for r in queries.queries()["op8_decontamination"](spark, SF).where("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == set(texts) - hit and clean.columns == columns
    encoded = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    library = bpe.Bpe(open(bpe.vocabulary_path(), "rb").read())
    assert all(library.decode(r["ids"]) == texts[r["doc_id"]] for r in encoded)
    assert corpus_pipeline.run(spark, SF).count() <= len(want)


def test_pipeline_edges(spark):
    """Null and empty texts, null ids, repeated rows, clashing names and an empty table through every stage."""
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (None, "", "en", "a", 0), (3, "one two three", "en", "a", 13), (3, "one two three", "en", "a", 13), (None, "x y " * 30, "de", "b", 120)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    ).withColumns({c: F.lit("clash") for c in ("__score", "__id", "__key", "__d", "t", "d", "key", "group", "ids")})
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            rows = out.collect()
            assert len(rows) <= table.count()
            if name != "bpe_encoding":
                assert out.columns == docs.columns and all(r["ids"] == "clash" for r in rows)


def test_pair_loss_by_hand():
    """The ranker's weights are where the pairwise logistic loss has its minimum."""
    r = np.random.default_rng(3)
    x = np.vstack([r.normal(1, 1, (30, 3)), r.normal(0, 1, (30, 3))])
    y = np.repeat([1, 0], 30)
    found = quality.fit(x, y, pairs=4000)
    g = np.random.default_rng(0)
    better, worse = g.choice(np.flatnonzero(y == 1), 4000), g.choice(np.flatnonzero(y == 0), 4000)
    ridge = 1e-3 * 10

    def loss(w):
        return sum(np.log1p(np.exp(-(x[a] - x[b]) @ w)) for a, b in zip(better, worse, strict=True)) + 0.5 * ridge * w @ w

    least = loss(found.weights)
    for k in range(3):
        for step in (-0.01, 0.01):
            assert loss(found.weights + step * np.eye(3)[k]) > least
    scores = found.scores(x)
    assert abs((scores < found.threshold).mean() - 0.5) < 0.02  # as large a share as the labels call bad


def test_quantile_by_hand():
    s = np.array([0.9, 0.1, 0.5, 0.7])
    assert quality.quantile(s, np.ones(4), 0.5) == pytest.approx(0.6) and quality.quantile(s, np.ones(4), 0.0) == 0.0


def test_field_by_enumeration():
    """Viterbi and the training's likelihood against all label sequences of short pages."""
    from itertools import product

    page = html.blocks("<nav><p>a b</p></nav><article><h1>T</h1><p>One two three.</p><p>x</p></article><footer>f</footer>")
    r = random.Random(1)
    for _ in range(20):
        known = sorted({f for fs in html.features(page) for f in fs})
        field = html.Field({f: r.gauss(0, 1) for f in known}, ((r.gauss(0, 1), r.gauss(0, 1)), (r.gauss(0, 1), r.gauss(0, 1))), r.gauss(0, 1))

        def value(labels, field=field):
            s = sum(field.weights[f] for fs, y in zip(html.features(page), labels, strict=True) if y for f in fs)
            return s + (field.start if labels[0] else 0.0) + sum(field.moves[a][b] for a, b in zip(labels, labels[1:], strict=False))

        assert field.decode(page) == list(max(product((0, 1), repeat=len(page)), key=value))


def test_training_gradient_by_enumeration():
    """One long training run ends where the regularised likelihood, by enumeration, has a zero gradient."""
    from itertools import product

    pages = [(html.blocks(p), y) for p, y in (("<p>a b.</p><div>c</div>", [1, 0]), ("<div>c d</div><p>e.</p><p>f</p>", [0, 1, 1]))]
    field = html.train(pages, steps=3000, rate=0.02, ridge=0.5)

    def loss(weights, moves, start):
        total = 0.0
        for found, gold in pages:
            feats = html.features(found)

            def value(labels, feats=feats):
                s = sum(weights[f] for fs, y in zip(feats, labels, strict=True) if y for f in fs) + (start if labels[0] else 0.0)
                return s + sum(moves[a][b] for a, b in zip(labels, labels[1:], strict=False))

            total += np.logaddexp.reduce([value(x) for x in product((0, 1), repeat=len(found))]) - value(gold)
        square = sum(w * w for w in weights.values()) + sum(m * m for row in moves for m in row) + start * start
        return total + 0.5 * 0.5 * len(pages) / 10 * square

    least = loss(field.weights, field.moves, field.start)
    for f in field.weights:
        for step in (-0.05, 0.05):
            assert loss({**field.weights, f: field.weights[f] + step}, field.moves, field.start) > least - 1e-6
    for step in (-0.05, 0.05):
        assert loss(field.weights, field.moves, field.start + step) > least - 1e-6


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<!x", "<a '\"", "<ul><li>", "</x>"])
def test_broken_markup_takes_linear_time(unit):
    import time

    began = time.perf_counter()
    html.blocks(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 20


def test_kneser_ney_by_hand(spark):
    """Log ratios of a tiny corpus against the formula written out over dictionaries."""
    from collections import Counter
    from math import log

    order, texts = 3, {1: "ab abc", 2: "abd", 3: "bcd ab", 4: "cab xx", 5: "dd"}
    label = {1: 1, 2: 1, 3: 0, 4: 0}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").select("doc_id", "text")
    sample = spark.createDataFrame(list(label.items()), "l_id bigint, label int")
    got = toxicity.ratios(toxicity.gram_counts(docs, sample, order), order).collect()

    def spelled(word):
        return ["^^" + word + " "][0]

    def word_grams(word):
        s = spelled(word)
        return [s[i : i + order] for i in range(len(s) - order + 1)]

    corpus = {g for t in texts.values() for w in t.split() for g in word_grams(w)}
    below, d = {}, toxicity.DISCOUNT
    for k in (1, 2):
        seen = Counter(x[1:] for x in {g[-k - 1 :] for g in corpus})
        for g, n in seen.items():
            same = [c for x, c in seen.items() if x[:-1] == g[:-1]]
            if k == 1:
                below[g] = max(n - d, 0) / sum(same) + d * len(same) / sum(same) / (len(same) + 1)
            else:
                below[g] = (n - d) / sum(same) + d * len(same) / sum(same) * below[g[1:]]
    own = {c: Counter(g for i, t in texts.items() if label.get(i) == c for w in set(t.split()) for g in word_grams(w)) for c in (0, 1)}

    def chance(c, g):
        total = sum(n for x, n in own[c].items() if x[:-1] == g[:-1])
        kinds = sum(1 for x in own[c] if x[:-1] == g[:-1])
        return (max(own[c][g] - 1, 0) / total + kinds / total * below[g[1:]]) if total else below[g[1:]]

    code = lambda c: 0 if c == " " else toxicity.START if c == "^" else int(toxicity.letter_codes()[ord(c)])
    pack = lambda g: sum(code(c) << 10 * (len(g) - 1 - i) for i, c in enumerate(g))
    want = {pack(g): log(chance(1, g) / chance(0, g)) for g in {*own[0], *own[1]}}
    found = {r["gram"]: r["llr"] for r in got if r["kind"] == 0}
    assert found.keys() == want.keys() and all(found[g] == pytest.approx(want[g]) for g in want)


def test_cutoffs_exist_and_equal_sql(spark):
    """At sf0.01 the labels certify a cutoff, so the method's verdict decides; the SQL gives the same rows."""
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{BIGGER}/{t}.parquet'")
    got = sorted(map(tuple, rules.op5_quality_rules(spark, BIGGER).collect()))
    assert got == sorted(c.sql(rules.SQL).fetchall())
    assert any(not r[-1] and not r[-2] for r in got)


def test_hot_buckets_are_filed_again(spark):
    r = random.Random(9)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 300:
        x = r.choice(sorted(fps))
        for b in r.sample(range(64), r.randrange(1, 7)):
            x ^= 1 << b
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), len(signed), hot=20)
    root = {r["node"]: r["root"] for r in graph.stars(edges).collect()}
    groups = {}
    for x in signed:
        groups.setdefault(root.get(x, x), set()).add(x % (1 << 64))
    want = {}
    for x, y in brute_components({x: x for x in fps}).items():
        want.setdefault(y, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
