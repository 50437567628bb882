import pytest

from claimloom.llm import quality, secrets, url_filters


@pytest.mark.parametrize("tag", ['<LINK REL="Canonical" HREF="{}">', '<link rel=cAnonical href="{}">', '<Meta HTTP-EQUIV="ReFresh" content="0; URL={}">'])
def test_tags_in_any_case(spark, tag):
    rows = [(1, "https://alias.example.com/en/2", tag.format("http://bad.example.net/fr/1")), (2, "https://other.example.com/en/2", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    judged = url_filters.judge(pages, [url_filters.Rule("net", "/", "block")])
    assert {r["page_id"]: r["verdict"] for r in judged.collect()} == {1: "block", 2: "allow"}


def test_queries_tell_pages_apart(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://shop.example.com/index.php?id=1&utm_campaign=a", link.format("http://bad.example.net/x")),
        (2, "http://shop.example.com/index.php?id=2", None),
        (3, "http://www.shop.example.com/index.php?SID=9&id=1&page=3", None),
        (4, "http://a.example.com/t?b=2&a=1", link.format("http://a.example.com/u")),
        (5, "http://a.example.com/u", link.format("http://bad.example.net?q=1")),
        (6, "http://a.example.com/t?a=1&b=2#top", None),
        (7, "http://a.example.com/t", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    judged = url_filters.judge(pages, [url_filters.Rule("net", "", "block")])
    assert {r["page_id"]: r["verdict"] for r in judged.collect()} == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow"}


def test_columns_of_the_inner_names_stay(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", None)], "page_id long, url string, html string")
    names = ["at", "node", "own", "spread", "_node", "_own", "_rule", "_spread", "component", "a", "b", "to"]
    wide = pages.selectExpr("*", *[f"'{n}' AS {n}" for n in names])
    row = url_filters.judge(wide, [url_filters.Rule("net", "/", "block")]).first()
    assert [row[n] for n in names] == names and row["verdict"] == "block"


@pytest.mark.parametrize("names", [["_facts", "_classes", "facts", "classes", "of", "_lang", "char_reference", "word_reference", "_of"]])
def test_quality_keeps_columns_of_the_inner_names(spark, names):
    docs = spark.createDataFrame([(1, "the cat and the dog " * 9, "en"), (2, None, None)], "doc_id long, text string, lang string")
    plain = quality.judge(docs)
    wide = quality.judge(docs.selectExpr("*", *[f"'{n}' AS {n}" for n in names]))
    assert all(r[n] == n for r in wide.collect() for n in names)
    assert sorted(map(tuple, wide.select(*plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_secrets_keep_columns_of_the_inner_names(spark):
    docs = spark.createDataFrame([(1, "password: hunter22", "t", "u")], "doc_id long, text string, tested string, _tested string")
    row = secrets.scan(docs).first()
    assert (row["tested"], row["_tested"], len(row["base"])) == ("t", "u", 1)
