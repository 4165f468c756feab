"""Trees of headings, lists and tables."""

import json

from pyspark.sql import functions as F

from cartulary.sources import structure

PAGE = """<html><head><title>no</title><script>var a = "<p>no</p>";</script></head><body>before<h1>One &amp; all</h1><p>first<br>line <b>bold</b></p>
<ul><li>a</li><li>b<ul><li>b1</li></ul></li></ul><h2>Two</h2><table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td></tr></table><p>open<p>next<h1>Three</h1>tail"""


def shown(found):
    return [(n["kind"], n["level"], n["text"], n["parent"]) for n in found]


def test_html_tree():
    got = structure.html_nodes(PAGE)
    assert [n["node"] for n in got] == list(range(len(got)))
    assert shown(got) == [
        ("text", 1, "before", None),
        ("heading", 1, "One & all", None),
        ("paragraph", 1, "first line bold", 1),
        ("list", 1, "", 1),
        ("item", 2, "a", 3),
        ("item", 2, "b", 3),
        ("list", 2, "", 3),
        ("item", 3, "b1", 6),
        ("heading", 2, "Two", 1),
        ("table", 1, "", 8),
        ("row", 2, "", 9),
        ("cell", 3, "x", 10),
        ("cell", 3, "y", 10),
        ("row", 2, "", 9),
        ("cell", 3, "1", 13),
        ("cell", 3, "2", 13),
        ("paragraph", 1, "open", 8),
        ("paragraph", 1, "next", 8),
        ("heading", 1, "Three", None),
        ("text", 1, "tail", 18),
    ]
    assert got[16]["section"] == ["One & all", "Two"] and got[18]["section"] == [] and got[19]["section"] == ["Three"]
    assert structure.html_nodes("") == [] and structure.html_nodes("<ul></ul></table></li>")[0]["kind"] == "list"


def test_markdown_tree():
    got = structure.markdown_nodes("intro\nmore\n\n# A #\ntext\n- one\n- two\n\n## B\n| x | y |\n|---|---|\n| 1 | 2 |\nafter\n# C\n1. first")
    assert shown(got) == [
        ("paragraph", 1, "intro more", None),
        ("heading", 1, "A", None),
        ("paragraph", 1, "text", 1),
        ("list", 1, "", 1),
        ("item", 2, "one", 3),
        ("item", 2, "two", 3),
        ("heading", 2, "B", 1),
        ("table", 1, "", 6),
        ("row", 2, "", 7),
        ("cell", 3, "x", 8),
        ("cell", 3, "y", 8),
        ("row", 2, "", 7),
        ("cell", 3, "1", 11),
        ("cell", 3, "2", 11),
        ("paragraph", 1, "after", 6),
        ("heading", 1, "C", None),
        ("list", 1, "", 15),
        ("item", 2, "first", 16),
    ]


def test_rows_and_outline(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>x</p>"), (4, "<p>x</p>")], "id long, html string").withColumn("text", F.lit("mine"))
    rows = structure.nodes(df, "id", "html", "html")
    assert rows.columns == ["id", "node", "parent", "kind", "level", "text", "section"]
    assert {r["id"]: r["count"] for r in rows.groupBy("id").count().collect()} == {1: 20, 4: 2}
    one = json.loads(structure.outline(df.where("id = 1"), "id", "html", "html").first()["structure"])
    assert [n["kind"] for n in one][:3] == ["text", "heading", "paragraph"]
