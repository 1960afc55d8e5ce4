"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import pytest

import public_tokenizers as P
from claimloom.llm import ann, common, host_rules, language, line_dedup, mixing, ngram_join, packing, quality, token_counts, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, class int, Key double, log_weight int, score string, removed string, g string"
LONG = " ".join(f"w{i}" for i in range(30_000)) + "x" * 50_000


def rows():
    extra = ("x", 1, 1.0, 2, "s", "r", "k")
    base = [
        (1, "the cat sat on the mat and then it went home", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, " \n\t ", None, "b"),
        (5, "the cat sat on the mat and then it went home", "en", "a"),
        (6, LONG, "de", "b"),
        (7, "größe é 漢字 \U0001f600 <|endoftext|> it's\u00a0x", "de", None),
        (None, "a document without id but with words in it", "de", "b"),
        (8, "one\ntwo\none", None, "a"),
        (8, "one\ntwo\none", None, "a"),
    ]
    return [(*r, len(r[1] or ""), *extra) for r in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, data=((1, 1), (5, 1), (6, 0), (6, 1), (None, 1), (3, None))):
    return spark.createDataFrame(list(data), "doc_id long, quality int")


def test_quality(spark, docs, empty):
    got = {r["doc_id"]: r for r in quality.resample(docs, labels(spark)).collect()}
    assert got[2]["log_weight"] is None and not got[2]["kept"] and not got[3]["kept"] and got[1]["kept"]
    assert sorted(r["doc_id"] or 0 for r in quality.resample(docs, labels(spark)).collect()) == sorted((r[0] or 0) for r in rows())
    assert quality.resample(docs, labels(spark, ())).where("kept").count() == 7  # nothing is known: all with words
    kept = quality.select(docs, labels(spark))
    assert kept.columns == docs.columns and kept.where("doc_id = 1").first()["log_weight"] == 2
    assert quality.resample(empty, labels(spark)).count() == 0


def test_ngram_join(docs, empty):
    got = ngram_join.Join(docs).documents().collect()
    by = {r["id"]: r for r in got if r["id"] is not None}
    assert len(got) == len(rows())
    assert (by[1]["component"], by[5]["component"]) == (1, 1)
    assert (by[2]["n"], by[2]["component"], by[3]["component"], by[4]["component"]) == (0, 2, 3, 4)
    assert by[8]["n"] == 1 and by[8]["component"] == 8
    assert ngram_join.Join(empty).documents().count() == 0


def test_line_dedup(spark, docs, empty):
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows())
    assert line_dedup.without_repeats(empty).count() == 0
    long = " ".join(f"q{i}" for i in range(60))
    some = spark.createDataFrame([(3, f"a\n{long}\nb"), (1, f"{long}\nc"), (None, long), (2, f"{long}\n{long}"), (1, f"{long}\nc")], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in line_dedup.without_repeats(some).collect()))
    assert got == [(False, 1, f"{long}\nc"), (False, 1, f"{long}\nc"), (False, 2, ""), (False, 3, "a\nb"), (True, 0, "")]


def test_language(docs, empty):
    from pyspark.sql import functions as F

    path = P.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in language.identify(docs, path, F.lit(True)).collect()}
    assert got[1]["lang_pred"] == "en" and got[6]["lang_pred"] == "de"
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[4]["lang_pred"] == "und" and got[2]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(docs, path, F.lit(False)).where("lang_pred <> 'und'").count() == 0
    assert language.identify(empty, path, F.lit(True)).count() == 0


def test_token_counts(spark, docs, empty):
    path, cache = P.path("byte_bpe_50k.json"), common.scratch(spark, "cache")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, path, cache).collect()}
    tok = token_counts.load_tokenizer(path)
    for i, text, *_ in rows():
        assert got[i]["n_tokens"] == len(tok.encode(text or "", add_special_tokens=False).ids)
        assert got[i]["n_bytes"] == len((text or "").encode())
    # a second time, all come from the cache, and it doesn't grow
    held = spark.read.parquet(cache).count()
    assert token_counts.count_tokens(docs, path, cache).count() == len(rows()) and spark.read.parquet(cache).count() == held
    assert token_counts.count_tokens(empty, path, cache).count() == 0


def test_host_rules(docs, empty):
    got = {r["doc_id"]: r for r in host_rules.judge(docs).collect()}
    assert got[2]["n_words"] == 0 and got[2]["base_failed"] and not got[2]["kept"]
    assert got[8]["n_dup_lines"] == 1 and got[6]["n_words"] == 30_000 and got[6]["n_repeat_words"] == 0
    assert host_rules.judge(empty).count() == 0


def test_packing(docs, empty):
    got = packing.pack(docs, P.path("word_bpe_49k.json"), capacity=64).collect()
    check_packing(got, 64)
    assert {r["doc_id"] for r in got} == {r[0] for r in rows()}
    assert sum(r["doc_id"] == 8 for r in got) == 2 and [r["length"] for r in got if r["doc_id"] == 3] == [1]
    assert packing.pack(empty, P.path("word_bpe_49k.json")).count() == 0


def check_packing(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity


def test_mixing(docs, empty):
    got = mixing.mix(docs, block_words=4).collect()
    assert len(got) == len(rows()) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert sorted((r["doc_id"] or 0, r["taken"]) for r in got) == sorted((r["doc_id"] or 0, r["taken"]) for r in mixing.mix(docs, block_words=4).collect())
    assert mixing.mix(empty).count() == 0
    out = mixing.mixed(docs, block_words=4)
    assert out.columns == docs.columns
    assert out.where("doc_id is null").count() <= 3 and mixing.mixed(empty).count() == 0


def test_url_filter(spark):
    urls = [(1, "https://A.Example.com/en/x?q#f"), (2, None), (3, "no scheme"), (4, "http://www.example.com/en/"), (5, "http://com"), (6, "x://b.net/es/1"), (6, "x://b.net/es/1"), (7, "://com/"), (8, "http://acom/")]
    pages = spark.createDataFrame([(i, u, None, "h", "r") for i, u in urls], "page_id long, url string, html string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.RULES).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2] == got[3] == ("", "", None, "allow")
    assert got[4][2:] == ("www.example.com/en/", "allow") and got[5] == ("com", "", None, "allow")
    assert got[6][3] == "block" and got[7] == ("com", "/", "com/", "allow") and got[8][2] is None
    assert url_filter.judge(pages, url_filter.RULES).count() == len(urls)
    assert url_filter.judge(pages.limit(0), url_filter.RULES).count() == 0


def test_neighbours(spark):
    v = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0])]
    vectors = spark.createDataFrame([(i, x, 1, "s") for i, x in v], "vec_id long, embedding array<float>, shard int, score string")
    index = ann.Index(vectors)
    got = index.search(index.rows.where("id % 50 = 0").select("id", "vector").dropDuplicates(["id"])).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 8, 7] and got[0]["score"] == 1.0 and got[3]["score"] == 0.0
    none = ann.Index(vectors.limit(0))
    assert none.search(none.rows.select("id", "vector")).count() == 0


def test_links_of_odd_pages(spark):
    page = "http://www.site.org/a/b?q"
    link = lambda attrs, more="": f"<html>{more}<head><link {attrs}></head>"
    cases = {
        link('rel="canonical" href="p"'): ["http://www.site.org/a/p"],
        link('rel="canonical" href="../es/9"'): ["http://www.site.org/es/9"],
        link('rel=canonical href="?x=1&amp;y=2"'): ["http://www.site.org/a/b?x=1&y=2"],
        link('rel="nofollow Canonical" href=//x.net/es/'): ["http://x.net/es/"],
        link('rel="canonical" href="c"', '<base href="https://o.org/d/e">'): ["https://o.org/d/c"],
        link('data-rel="canonical" href="http://x.net/es/"'): [],
        link('rel="canonical"'): [],
        link('rel="canonical" href="http://[x/"'): [],
        link('rel="canonical" href="mailto:a@x.net"'): [],
        '<!-- <link rel="canonical" href="http://x.net/es/"> -->': [],
        '<script>"<link rel=canonical href=http://x.net/es/>"</script>': [],
        '<meta http-equiv="Refresh" content="0; URL=\'/k\'">': ["http://www.site.org/k"],
        '<meta http-equiv="refresh" content="5">': [],
        "": [],
    }
    for html, found in cases.items():
        assert url_filter.targets(page, html) == found, html
    assert url_filter.targets("x://h/a/b", link('rel=canonical href="c"')) == ["x://h/a/c"]
    assert url_filter.targets(None, link('rel=canonical href="c"')) == []
    rows = [(1, page, link('rel="canonical" href="http://x.net/es/9"')), (2, "http://www.site.org/a/p", link('rel=canonical href="b?q"')), (2, "http://www.site.org/a/p", None), (3, "http://k.com/", link('rel=canonical href="http://www.site.org/a/b?q"')), (4, None, link('rel=canonical href="http://x.net/es/9"'))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["verdict"]) for r in url_filter.judge(df, url_filter.RULES).collect())
    assert got == [(1, "block"), (2, "block"), (2, "block"), (3, "allow"), (4, "allow")]


def test_single_document_hosts_condemn_nobody(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    alone = [(i, bad if i % 10 == 0 else good, f"h{i}") for i in range(2000)]
    got = host_rules.judge(spark.createDataFrame(alone, "doc_id long, text string, source string")).collect()
    assert all(r["kept"] != r["base_failed"] for r in got) and {round(r["host_rate"], 3) for r in got} == {0.1}
    # two failures of three among hosts that differ no more than by chance say little; among hosts that do differ, much
    three = [(9000 + k, bad if k < 2 else good, "three") for k in range(3)]
    rate = lambda rows: {r["host"]: r["host_rate"] for r in host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).join(spark.createDataFrame(rows, "doc_id long, t string, host string"), "doc_id").collect()}
    assert rate(alone + three)["three"] < 0.2
    apart = [(i, bad if i % 50 < (45 if i < 500 else 1) else good, f"h{i // 50}") for i in range(2000)]
    assert rate(apart + three)["three"] > 0.4
