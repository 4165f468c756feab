import json

import pytest
from pyspark.sql import functions as F

from cartulary import config, prompts
from cartulary.classify import TransientError, classify, invoke, outcome
from cartulary.operators import canonicalise, dashboard, evaluate, experiments, harvest, metrics
from cartulary.plans import actions, coverage
from cartulary.sources import files, lines
from cartulary.vocabulary import get


def test_canonicalise_modes(spark):
    rows = spark.createDataFrame([("Finance", "checking", "bank_statement"), ("nope", "banking", "bill"), (None, None, None), ("food", "recipe", "cv")], "domain string, category string, doctype string")
    got = [tuple(r)[3:] for r in canonicalise.canonicalise(rows).collect()]
    assert sorted(got) == sorted([("financial", "banking", "statements"), ("other", "other", "bills"), ("other", "other", "other"), ("food", "other", "resumes")])
    strict = {r["domain"]: r for r in canonicalise.canonicalise(rows, mode="strict").collect()}
    assert strict["Finance"]["error_code"] is None and strict["nope"]["error_message"] == "unknown domain: nope" and strict["food"]["error_message"] == "unknown category: recipe"
    again = canonicalise.canonicalise(canonicalise.canonicalise(rows).select(*[F.col(f"canon_{a}").alias(a) for a in canonicalise.AXES]))
    assert again.where("domain <> canon_domain OR category <> canon_category OR doctype <> canon_doctype").count() == 0


def test_latency_is_not_a_percentile(spark):
    rows = spark.createDataFrame([("p", "m", x, True) for x in (1, 2, 3, 4)] + [("p", "m", 99, False), ("p", "n", 7, True)], "provider string, model string, latency_ms int, success boolean")
    got = {r["model"]: tuple(r)[2:] for r in experiments.latency(rows).collect()}
    assert got == {"m": (4, 3, 4, 2, 4), "n": (1, 7, 7, 7, 7)}


def test_evaluation(spark):
    p = spark.createDataFrame([("a", "X", "c", "t", "v", "20240101"), ("b", "x", "c", "t", None, None), ("z", "x", "c", "t", None, None)], "filename string, domain string, category string, doctype string, vendor string, date string")
    t = spark.createDataFrame([("a", "x", "c", "u", "V", None), ("b", "y", "c", "t", "w", "20240101"), ("q", "x", "c", "t", None, None)], p.schema)
    rows = evaluate.compared(p, t)
    score = evaluate.accuracy(rows).first()
    assert (score["total"], score["domain_accuracy"], score["doctype_accuracy"], score["vendor_accuracy"], score["date_accuracy"]) == (2, 0.5, 0.5, 0.5, 0.0)
    assert evaluate.confusion(rows).agg(F.sum("n")).first()[0] == 6
    assert [r[0] for r in evaluate.unmatched(t, p).select("filename").collect()] == ["q"]
    empty = evaluate.accuracy(rows.limit(0)).first()
    assert empty["domain_accuracy"] == 0.0 and empty["vendor_accuracy"] is None


def test_experiment_reports(spark):
    docs = spark.createDataFrame([("d1",), ("d2",)], "document string")
    runs = experiments.matrix(docs, [("p", "m"), ("p", "n")])
    records = runs.select(F.lit("e").alias("experiment"), F.lit("2026-01-01T00:00:00").alias("timestamp"), "document", "provider", "model", F.lit(5).alias("latency_ms"), (F.col("model") == "m").alias("success"), F.create_map(F.lit("domain"), F.col("document") == "d1").alias("matches"), (F.col("document") == "d1").alias("all_match"))
    s = experiments.summary(records).first()
    assert (s["total"], s["successful"], s["failed"], s["documents"], s["models"], s["exit_code"]) == (4, 2, 2, 2, 2, 1)
    assert [r["model"] for r in experiments.accuracy_by_model(records).collect()] == ["m"]
    field = {r["field"]: (r["correct"], r["total"]) for r in experiments.accuracy_by_field(records).collect()}
    assert field["domain"] == (1, 2) and field["vendor"] == (0, 2) and field["ALL"] == (1, 2)
    assert "Successful: 2" in experiments.text_report(records)
    assert experiments.csv_rows(records).where("match_vendor = ''").count() == 4


def test_harvest(spark):
    rows = spark.createDataFrame([("Finance", "checking", "statement", "A Inc", "20240101"), ("x y", "z", "statement", "", "n"), ("", "a", "b", "A Inc", "1999")], "domain string, category string, doctype string, vendor string, date string")
    h = harvest.normalised(rows)
    assert tuple(harvest.counters(h).first()) == (2, 1)
    drift = {(r["field"], r["raw"], r["canonical"], r["domain"]) for r in harvest.drift(h).collect()}
    assert ("category", "checking", "banking", "financial") in drift and ("category", "z", None, "x_y") in drift and ("domain", "x_y", None, None) in drift
    assert {r["vendor"]: r["n"] for r in harvest.vendors(rows).collect()} == {"a-inc": 2}
    assert harvest.sample(spark.createDataFrame([("a",), ("b",)], "path string"), 1, 3).count() == 1


def test_prices(spark):
    rows = spark.createDataFrame([("openai/gpt-4o-mini",), ("gpt-4",), ("none",)], "model string")
    best = {r["model"]: r["price_in"] for r in metrics.priced(rows).collect()}
    first = {r["model"]: r["price_in"] for r in metrics.priced(rows, first=True).collect()}
    assert best == {"openai/gpt-4o-mini": 0.15, "gpt-4": 30.0, "none": None} and first["openai/gpt-4o-mini"] == 2.5
    half = spark.range(1).select(metrics.cost(F.lit(0.5), F.lit(0.0), F.lit(1.0), F.lit(0.0))).first()[0]
    assert half == 0.0
    costs = spark.createDataFrame([(1, 3), (2, 3), (3, 3), (4, 3)], "seq int, cents int")
    assert [r["seq"] for r in metrics.running_cost(costs, "seq", "cents", 5).orderBy("seq").collect()] == [1, 2]


def test_dashboard(spark):
    row = spark.createDataFrame([("post-audit-20260501", "gemma4_docling.json")], "folder string, file string")
    got = row.select(dashboard.date_of(F.col("folder")), dashboard.corpus_of(F.col("folder")), dashboard.variant_of(F.col("folder")), dashboard.loader_of(F.col("file"))).first()
    assert tuple(got) == ("2026-05-01", "real-world", "full-page-ocr", "docling")
    assert spark.range(1).select(dashboard.runtime(F.lit(1643.0), F.lit(80))).first()[0] == "20.5s"


def test_plans(spark):
    rows = spark.createDataFrame([(1, "f", "a.pdf"), (2, "f", "a.pdf"), (3, "g", "a.pdf")], "n int, folder string, target string")
    assert [r["new_name"] for r in actions.rename_all(rows, "folder", "target", "n").orderBy("n").collect()] == ["a.pdf", "a-1.pdf", "a.pdf"]
    have = spark.createDataFrame([("financial", "banking", "statements")], "domain string, category string, doctype string")
    lack = {r["domain"]: r for r in coverage.state(have, 3).collect()}
    assert len(lack) == 16 and lack["financial"]["deficit"] == 2 and lack["financial"]["missing_categories"] == 6 and lack["food"]["documents"] == 0
    pool = coverage.candidates(get(), spark, {"financial": ["statements", "bills"]})
    added = coverage.top_up(have, 3, 1, pool).collect()
    assert len(added) == 2 and all(r["stage"] == 0 for r in added)


def test_ground_truth_reader(spark, tmp_path):
    body = ["# head", "", json.dumps({"filename": "a", "domain": "x", "category": "c", "doctype": "t"}), "{bad", json.dumps({"filename": "a", "domain": "y", "category": "c", "doctype": "t", "more": 1}), json.dumps({"filename": "b", "domain": "y", "category": "c"})]
    path = tmp_path / "truth.jsonl"
    path.write_text("\n".join(body))
    rows = lines.ground_truth(spark, str(path)).collect()
    assert [(r["filename"], r["domain"], r["vendor"]) for r in rows] == [("a", "y", None)]


def test_files_to_paths(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_text("bank statement of financial banking")
    (tmp_path / "sub" / "b.html").write_text("<p>medical &amp; prescription</p><script>x</script>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.exe").write_bytes(b"no")
    (tmp_path / "e.md").write_text("  \n")
    docs = files.documents(spark, str(tmp_path))
    got = {r["original"]: r for r in classify(docs).collect()}
    assert set(got) == {"a.TXT", "b.html", "c.pdf", "e.md"}
    assert got["a.TXT"]["suggested_path"].startswith("financial/banking/") and got["a.TXT"]["suggested_path"].endswith(".txt")
    assert got["b.html"]["domain"] == "medical" and got["c.pdf"]["error_code"] == got["e.md"]["error_code"] == "DOCUMENT_LOAD_FAILED"
    assert files.found(spark, str(tmp_path)).count() == 4
    assert outcome(classify(docs)) == 1 and outcome(classify(docs), "fail") == 2


def test_retries(spark):
    class Flaky:
        def __init__(self):
            self.calls = 0

        def answer(self, system, human):
            self.calls += 1
            if "never" in human or self.calls % 2:
                raise TransientError("busy")
            return "{}"

    docs = spark.createDataFrame([("p", "once", None, None), ("q", "never", None, None), ("r", "", "DOCUMENT_LOAD_FAILED", "x")], "path string, content string, error_code string, error_message string").coalesce(1)
    got = {r["path"]: r for r in invoke(docs, Flaky).collect()}
    assert got["p"]["response"] == "{}" and got["q"]["error_code"] == "LLM_API_ERROR" and got["r"]["error_code"] == "DOCUMENT_LOAD_FAILED"


def test_prompts():
    system, human = prompts.split(prompts.DEFAULT)
    assert "JSON" in system and prompts.render(human, "menu", "{taxonomy_menu}") == "{taxonomy_menu}"
    for bad in ("{taxonomy_menu}", "# System Prompt\n{taxonomy_menu}{document_content}"):
        with pytest.raises(ValueError):
            prompts.split(bad)


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"ai": {"model": "m", "max_tokens": 5}, "max_pages": 3}')
    s = config.load(str(path), {"CARTULARY_MAX_PAGES": "7", "CARTULARY_MODEL": ""}, concurrency=2, on_error=None)
    assert (s.model, s.max_tokens, s.max_pages, s.concurrency, s.on_error) == ("m", 5, 7, 2, "fail")
    for bad in ({"temperature": 3.0}, {"retry_min_wait": 20.0}, {"max_retries": 0}):
        with pytest.raises(ValueError):
            config.load(None, {}, **bad)


def test_queries_run_on_small_tables(spark):
    from cartulary import catalogue

    for name in ("q03_suggested_path", "q19_drift", "q38_stream_classify"):
        assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1


def test_cli(spark, tmp_path, capsys):
    from cartulary import cli

    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("financial banking statement")
    truth = tmp_path / "truth.jsonl"
    truth.write_text(json.dumps({"filename": "a.txt", "domain": "financial", "category": "banking", "doctype": "statements"}))
    assert cli.main(["classify", str(docs)], spark) == 0
    assert '"suggested_path":"financial/banking/statements/' in capsys.readouterr().out
    assert cli.main(["evaluate", str(docs), "--ground-truth", str(truth)], spark) == 0
    assert cli.main(["tag", str(docs)], spark) == 0
    assert '"final_tags":["financial","banking","statements"]' in capsys.readouterr().out
