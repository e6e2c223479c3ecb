"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from fieldlake.llm import decontaminate, exact_dedup, html_text, licences, line_dedup, lm_score, near_dedup, quality, sentencepiece_codec, url_filter

LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(30_000))
TEXTS = [(1, "one two three four five six seven."), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (5, LONG), (None, "nobody knows this text at all"), (7, "one two three four five six seven."), (8, "word"), (9, "\x00 \ud7ff é 😀")]
CLASH = "score component_id kept keep_id n lines removed g rep comp cluster row pos h held_out ids size key"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").select("doc_id", "text", *[F.lit("x").alias(c) for c in CLASH.split()])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "word"), (None, "one"), (4, "one two three four five six seven. and more than forty characters")], "item_id long, text string")


def ops(labels, bench):
    return {
        "lm": lm_score.score, "sp": sentencepiece_codec.encode, "lic": licences.scan, "dec": lambda d: decontaminate.find_leaks(d, bench), "drop": lambda d: decontaminate.drop_leaks(d, bench), "line": line_dedup.dedup_lines,
        "near": near_dedup.near_groups, "one": near_dedup.keep_one, "q": lambda d: quality.score(d, labels), "good": lambda d: quality.keep_good(d, labels), "exact": exact_dedup.exact_groups,
    }


NAMES = ["lm", "sp", "lic", "dec", "drop", "line", "near", "one", "q", "good", "exact"]
PER_ROW = ["lm", "sp", "lic", "line", "near", "q", "exact"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, labels, bench, name):
    rows = ops(labels, bench)[name](docs).collect()
    if name in PER_ROW:
        assert len(rows) == len(TEXTS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, labels, bench, name):
    assert ops(labels, bench)[name](docs.filter("false")).count() == 0


def test_pages(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://A.Example.COM/en/7?x", "<p>a"), (None, "x://", "<p><"), (3, "http://A.Example.COM/en/7?x", "<p>a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(1))
    texts = html_text.extract(pages).collect()
    assert sorted(r["text"] for r in texts) == ["", "", "<", "a", "a"]
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect()}
    assert found[3] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and found[2] == ("", "", None, "allow") and found[1] == ("", "", None, "allow")
    assert html_text.extract(pages.filter("false")).count() == url_filter.filter_urls(pages.filter("false")).count() == 0


def test_defined_results(docs):
    near = {(r["doc_id"], r["n_shingles"]): r for r in near_dedup.near_groups(docs).collect()}
    assert near[7, 3]["component_id"] == 1 and not near[7, 3]["kept"] and near[2, 0]["kept"] and near[8, 1]["component_id"] == 8 and near[4, 0]["component_id"] == 4
    exact = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs).collect()}
    assert exact[1]["keep_id"] == 7 and exact[2]["keep_id"] == 3 and exact[5]["group_size"] == 2 and exact[5]["kept"] and exact[None]["kept"]
    tokens = {r["doc_id"]: r for r in sentencepiece_codec.encode(docs).collect()}
    assert tokens[2]["n_tokens"] == 0 and all(r["round_trip"] for r in tokens.values())


def test_empty_side_tables(docs, labels, bench):
    """Without labels every score is the prior; without items nothing is found and every document stays."""
    rows = quality.score(docs, labels.filter("false")).collect()
    assert len(rows) == len(TEXTS) and {r["score"] for r in rows} == {0.5}
    assert decontaminate.find_leaks(docs, bench.filter("false")).count() == 0 and decontaminate.drop_leaks(docs, bench.filter("false")).count() == len(TEXTS)


def test_long_and_odd_pages(spark):
    rows = [(1, None, "<article>" + "<p>word and word</p>" * 20_000 + "</article>"), (2, "http://", "<div>" * 3000 + "x" + "</div>" * 3000), (2, "://:", "\x00<p title='>y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1)).withColumn("n_chars", F.lit("x"))
    texts = {(r["page_id"], r["url"]): r["text"] for r in html_text.extract(pages).collect()}
    assert len(texts[1, None]) == 20_000 * 14 - 1 and texts[2, "http://"] == "x"
    assert {r["verdict"] for r in url_filter.filter_urls(pages).collect()} == {"allow"}
