"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docaudit.llm import bpe, chat, decontam, html, quality, rules, simhash, substring, toxicity, urls

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i}" for i in range(30_000))
SHARED = " ".join(f"s{i}" for i in range(25))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 5), (4, "One two.", None, "a", 8), (5, LONG, "en", None, len(LONG)), (6, SHARED, "en", "a", 1),
        (7, "x " + SHARED + " y", "de", "b", 1), (7, "x " + SHARED + " y", "de", "b", 1), (8, SHARED.replace(" ", "\n"), "de", "b", 1), (None, SHARED, "de", "b", 1), (9, "#$% " * 60, "en", "c", 240),
        (10, "idiot scum " * 5, "en", "c", 55), (11, "héllo Ünï 漢字 🙂 <|endoftext|>", "fr", "c", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 12)] + [(None, 1, 1), (3, None, None), (4, 0, 1), (99, 1, 0)], "doc_id bigint, quality int, toxic int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_quality(spark, docs, empty, labels):
    ranker = quality.train(docs.select("doc_id", "text"), labels)
    got = quality.score(docs.withColumn("score", F.lit("old")), ranker).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["text"] is None or r["text"] == ""}) == 1
    assert quality.score(empty, ranker).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
    none = quality.train(empty, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


def test_toxicity(spark, docs, empty, labels):
    scorer = toxicity.train(docs.select("doc_id", "text"), labels)
    got = toxicity.score(docs, scorer, ["doc_id"]).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, scorer, ["doc_id"]).count() == 0
    none = toxicity.train(empty, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {0.0}


def test_html(spark):
    field = html.default_field()
    assert field.text(None) == field.text("") == ""
    page = "<nav><ul><li><a href=/a>Menu</a></li></ul></nav><article><h1>Ti&amp;tle</h1><p>One  two\nthree &eacute;.<p>Four five <b>six</b> seven.<script>x='</p>'</script></article><footer>&copy; Me</footer>"
    assert field.text(page) == "Ti&tle\nOne two three é.\nFour five six seven."
    assert field.text("a < b and <unclosed") is not None
    assert isinstance(field.text("<p>" * 3000 + LONG), str)
    pages = spark.createDataFrame([(1, None, None, "keep"), (None, "u", page, "keep"), (None, "u", page, "keep")], "page_id bigint, url string, html string, text string")
    got = html.extract(pages, field).collect()
    assert [r["n_chars"] for r in got] == [0, 44, 44] and len(got[1]["text"]) == 44
    assert html.extract(pages.limit(0), field).count() == 0


def test_simhash(spark, docs, empty):
    got = {(r["doc_id"], r["text_key"]): r for r in simhash.near_duplicates(docs).collect()}
    by = {}
    for r in got.values():
        by.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert by[1] == {1, 2, 3} and {6, 8, None} <= by[6]
    assert simhash.near_duplicates(docs).count() == 13
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == sorted({1, 6, 4, 5, 9, 10, 11} | ({7} if by.get(7) else set()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_bpe(spark, docs, empty):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    t = Tokenizer.from_file(path)
    got = bpe.encode_decode(docs.withColumn("ids", F.lit("old")), path).collect()
    assert len(got) == 13
    for r in got:
        assert r["ids"] == t.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == t.decode(r["ids"], skip_special_tokens=False)
    assert bpe.encode_decode(empty, path).count() == 0


def test_rules(spark, docs, empty, labels):
    got = {r["doc_id"]: r for r in rules.quality_rules(docs, labels).collect()}
    assert rules.quality_rules(docs, labels).count() == 13
    assert (got[1]["n_words"], got[1]["base_failed"], got[1]["kept"]) == (0, True, False)
    assert got[5]["n_words"] == 30_000 and got[5]["n_repeat_words"] == 0 and got[5]["kept"]
    assert (got[9]["n_symbols"], got[9]["n_repeat_words"]) == (180, 60)
    assert rules.quality_rules(empty, labels).count() == 0
    assert rules.quality_rules(docs, labels.limit(0)).where("kept").count() == 1


def test_chat(spark):
    path = bpe.vocabulary_path()
    data = [(1, 0, "user", None), (1, 1, "assistant", "a <|im_end|> <\\|x <| b"), (1, 1, "assistant", "a"), (2, None, None, ""), (None, 0, "user", "q"), (None, 0, "user", "q"), (3, 5, "we\nird\\n", LONG), (4, 0, "user", None)]
    df = spark.createDataFrame([(*r, "extra") for r in data], "conv_id bigint, turn bigint, role string, text string, ids string")
    packs = chat.format_packs(df, path)
    got = {r["conv_id"]: r for r in chat.read_back(packs, path).collect()}
    want = {}
    for c in {r[0] for r in data}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for cc, t, r, x in data if cc == c), key=lambda z: z)
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(), sum(len(x) for *_, r, x in turns if r == "assistant"))
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"]) for c, r in got.items()} == want
    assert chat.format_packs(df.limit(0), path).count() == 0
    small = chat.format_packs(df, path, pack_tokens=8, pack_conversations=1)
    assert rows(chat.read_back(small, path)) == rows(chat.read_back(packs, path))


def test_chat_shares_prefixes(spark):
    path = bpe.vocabulary_path()
    df = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", "same" if t < 2 else f"own {c}") for c in range(5) for t in range(4)], "conv_id bigint, turn bigint, role string, text string")
    nodes = sorted(chat.format_packs(df.coalesce(1), path).collect(), key=lambda r: (r["pack"], r["node"]))
    assert all(r["position"] == sum(e - s for s, e in map(tuple, r["attends"])) for r in nodes)
    packs = {r["pack"] for r in nodes}
    assert sum(r["parent"] == -1 for r in nodes) == len(packs) and len(nodes) == 10 + 2 * len(packs)


def test_escape_round_trip():
    for s in ("", "<|", "<\\|", "<\\\\|<|", "|<", "<<|im_start|>", "a\\n\n\\"):
        assert "<|" not in chat.escape(s) and chat.unescape(chat.escape(s)) == s
        assert "\n" not in chat.escape_role(s) and chat.unescape_role(chat.escape_role(s)) == s


def test_substring(spark, docs, empty):
    clash = docs.withColumn("kept_text", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = {}
    for r in substring.remove_repeats(clash).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [r["n_removed"] for r in got[7]] == [25, 25] and got[7][0]["kept_text"] == "x\ny"
    assert [(got[i][0]["n_words"], got[i][0]["n_removed"]) for i in (1, 2, 3, 5, 6, 8, None)] == [(0, 0), (0, 0), (0, 0), (30_000, 0), (25, 0), (25, 25), (25, 25)]
    assert substring.remove_repeats(empty).count() == 0
    cut = substring.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == 13


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, "S3 s4 S5 s6 s7 s8 s9 s10 s11 s12 s13"), (1, "S3 s4 S5 s6 s7 s8 s9 s10 s11 s12 s13"), (2, "One Two"), (3, None), (4, "!!"), (None, "w1 w2"), (5, "never seen here")], "item_id bigint, text string")
    got = {}
    for r in decontam.contamination(docs.withColumn("items", F.lit(3)), bench).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_hit"], r["items"]))
    assert got[7] == [(27, 11, ["1"])] * 2 and got[4] == [(2, 2, ["2"])] and got[1] == [(0, 0, [])] and got[5] == [(30_000, 0, [])]
    assert sum(map(len, got.values())) == 13
    kept = decontam.drop_contaminated(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5, 9, 10, 11] and kept.columns == docs.columns
    assert decontam.contamination(empty, bench).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(docs, bench.limit(0)).collect()} == {0}
    # beyond the broadcast bound the joins shuffle, with the same result
    assert rows(decontam.contamination(docs, bench, broadcast_rows=0)) == rows(decontam.contamination(docs, bench))


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/path": ("", "", None, "allow"), "http://EXAMPLE.com/en/x?q": ("example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/a#b": ("www.example.com", "/en/a", "www.example.com/en/", "allow"), "x://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"), "http://example.com/de/": ("example.com", "/de/", "com/", "allow"),
        "http://myexample.net/es/1": ("myexample.net", "/es/1", "net/es/", "block"), "http://a.net/en/1": ("a.net", "/en/1", None, "allow"), "http://com?x": ("com", "", None, "allow"), "http://a.org/en/": ("a.org", "/en/", None, "allow"),
        "http://example.com:80/en/": ("example.com:80", "/en/", None, "allow"), "http://É.COM/": ("É.com", "/", "com/", "allow"), "http://" + "a." * 5000 + "net/fr/": ("a." * 5000 + "net", "/fr/", "net/fr/", "block"),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)] * 2, "page_id bigint, url string, rule string")
    got = urls.match_urls(df, urls.rules_frame(spark)).collect()
    assert len(got) == 2 * len(cases)
    assert {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == cases
    assert rows(urls.match_urls(df, urls.rules_frame(spark), broadcast_rules=0)) == rows(urls.match_urls(df, urls.rules_frame(spark)))
    assert {r["verdict"] for r in urls.match_urls(df, urls.rules_frame(spark).limit(0)).collect()} == {"allow"}
    assert urls.match_urls(df.limit(0), urls.rules_frame(spark)).count() == 0
