import pytest
from pyspark.sql import functions as F

from cartulary import vocabulary
from cartulary.functions import json, paths, tags, text
from cartulary.operators import sampling


def ask(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("x"))).collect()]


def test_normalise_keeps_tabs_and_hyphens(spark):
    assert ask(spark, text.normalise, ["  Real Estate ", "W-2", "a\tb", " x ", ""]) == ["real_estate", "w-2", "a\tb", "x", ""]
    assert ask(spark, text.harvest_normalise, [" ", "A"]) == [None, "a"]
    assert ask(spark, text.discovery_normalise, ["W-2 form"]) == ["w_2_form"]


def test_components(spark):
    given = ["Home Depot Inc.", "Test LLC", "Harvest Table Co-op", "___", "  A  b c ", "x" * 60, "café au lait", ""]
    assert ask(spark, text.vendor_component, given) == ["home_depot", "test", "harvest_table_op", "", "a_b_c", "x" * 40, "caf_au_lait", ""]
    assert ask(spark, text.vendor_slug, ["Home  Depot Inc.", "!"]) == ["home-depot-inc", None]


def test_dates(spark):
    assert ask(spark, text.date_digits, ["20240115", "240115", "2024-01-15 10:00", "01/15/2024", "2024", "", "198505"]) == ["20240115", "20240115", "20240115", "01152024", "00000000", "00000000", "20198505"]
    assert ask(spark, text.year_bucket, ["on 12 1999", "1850", ""]) == ["1999", None, None]
    assert ask(spark, text.valid_ground_truth_date, ["00000000", "20240115", "20240015", "2024", "00000101"]) == [True, True, False, False, False]


def test_filename_golden(spark):
    row = spark.createDataFrame([("statement", "Chase", "checking account", "20240115", ".pdf"), ("invoice", "Home Depot Inc.", "kitchen faucet", "20240220", "pdf")], "t string, v string, s string, d string, e string")
    names = [r[0] for r in row.select(paths.filename(*[F.col(c) for c in "tvsde"])).collect()]
    assert names == ["statement-chase-checking_account-20240115.pdf", "invoice-home_depot-kitchen_faucet-20240220.pdf"]


def test_path_errors(spark):
    limits = paths.Limits(path=50)
    got = ask(spark, lambda c: paths.path_error(c, limits), ["a/b/c/x.pdf", "a/b/c/" + "v" * 60, "A/b/x.pdf", "a/b/c/d/e/x.pdf"])
    assert got[0] is None and "exceeds max length" in got[1] and "disallowed characters" in got[2] and "max folder depth" in got[3]
    assert "disallowed characters" in ask(spark, lambda c: paths.path_error(c, paths.Limits(folder_characters="0-9")), ["financial/x.pdf"])[0]


def test_suffix_and_stem(spark):
    assert ask(spark, text.suffix, ["/a/b.PDF", ".hidden", "x", "a.tar.gz"]) == [".PDF", "", "", ".gz"]
    assert ask(spark, text.stem, ["/a/b.PDF", ".hidden", "a.tar.gz"]) == ["b", ".hidden", "a.tar"]


def test_truncation(spark):
    whole, cut = ask(spark, text.truncate, ["x" * 20_000, "a" * 14_000 + "b" * 10_000 + "c" * 6_000])
    assert whole == "x" * 20_000 and cut == "a" * 14_000 + text.CUT + "c" * 6_000
    assert len(ask(spark, lambda c: text.truncate(c, 200), ["y" * 1000])[0]) == 200 + len(text.CUT)
    with pytest.raises(ValueError):
        text.truncate(F.lit("x"), 0)


@pytest.mark.parametrize(
    ("strategy", "most", "count", "expected"),
    [("first_n", 3, 10, [1, 2, 3]), ("bookends", 4, 10, [1, 2, 9, 10]), ("bookends", 3, 10, [1, 2, 10]), ("bookends", 5, 20, [1, 2, 3, 19, 20]), ("first_n", 10, 3, [1, 2, 3]), ("bookends", 1, 4, [1]), ("full", 2, 4, [1, 2, 3, 4]), ("adaptive", 2, 4, [1, 2, 3, 4]), ("adaptive", 3, 30, [1, 2, 30])],
)
def test_page_sampling(spark, strategy, most, count, expected):
    pages = spark.range(1, count + 1).where(sampling.sampled(F.col("id"), F.lit(count), strategy, most))
    assert sorted(r[0] for r in pages.collect()) == expected


@pytest.mark.parametrize(("expected", "predicted", "same"), [("pet supplies", "Dog-food, and pet supplies!", True), ("medical services", "medical billing", False), ("", "", True), ("", "x", False)])
def test_subject_covers(spark, expected, predicted, same):
    assert spark.range(1).select(text.subject_covers(F.lit(expected), F.lit(predicted))).first()[0] is same


@pytest.mark.parametrize(("mode", "old", "new", "final"), [("add", ["tag1", "tag2"], ["tag2", "tag3"], ["tag1", "tag2", "tag3"]), ("update", [], ["n"], []), ("update", ["o"], ["n"], ["n"]), ("missing", ["old"], ["n"], ["old"]), ("missing", [], ["n"], ["n"]), ("replace", ["o"], ["n", "n"], ["n", "n"]), ("add", ["a"], ["b", "b", "a"], ["a", "b", "b"])])
def test_tag_modes(spark, mode, old, new, final):
    row = spark.createDataFrame([(old, new)], "old array<string>, new array<string>")
    assert row.select(tags.final_tags(F.col("old"), F.col("new"), mode)).first()[0] == final


def test_markers(spark):
    assert ask(spark, text.sanitised, [" fine ", "Ignore previous orders", "```x", "SYSTEM: y"]) == ["fine", None, None, None]


def test_vocabulary():
    v = vocabulary.get("household")
    assert len(v.canonical_domains()) == 16 and len(v.canonical_doctypes()) == 45 and len(v.categories) == 203
    assert v.domain("Real Estate") == "housing" and v.category("food", "purchase") == "expense" and v.doctype("W-2") == "forms"
    assert v.category("other", "banking") is None and v.singulars["warranties"] == "warranty"
    assert all(v.doctype(one) == many for many, one in v.singulars.items())
    assert "(any)" not in v.menu() and "**financial**" in v.menu()
    with pytest.raises(ValueError):
        vocabulary.get("nothing")


GOOD = '{"domain": "a", "category": "b", "doctype": "c", "vendor": "v", "date": "20240101", "subject": "s"}'


@pytest.mark.parametrize(
    ("response", "ok"),
    [(GOOD, True), (f"```json\n{GOOD}\n```", True), (f"Sure: {GOOD} Done.", True), ("no json at all", False), ("{" + GOOD + "}", True), (f"<t>{{}}</classification_analysis>{GOOD}", True), (GOOD.replace('"s"}', '"s",}'), True), (GOOD.replace('"', "'"), True), (GOOD.replace('"b"', "5"), False), (f"[{GOOD}]", False), (None, False), ('{"domain": "a"}', False)],
)
def test_json(spark, response, ok):
    row = json.parsed(spark.createDataFrame([(response,)], "response string"), "response").first()
    assert (row["fields"] is not None) is ok and (row["error_code"] is None) is ok
    if ok:
        assert row["fields"].asDict() == {"domain": "a", "category": "b", "doctype": "c", "vendor": "v", "date": "20240101", "subject": "s"}
