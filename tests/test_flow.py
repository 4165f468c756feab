"""The ways through the engine: backends, one call a document, experiments, actions, plans, reports, commands."""

import http.server
import json
import os
import sys
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cartulary import backends, cli, config, prompts, storage
from cartulary.classify import classify, failure, invoke
from cartulary.functions import paths, text
from cartulary.operators import dashboard, evaluate, experiments, harvest, metrics
from cartulary.plans import actions, coverage
from cartulary.sources import files, lines
from cartulary.vocabulary import available, get, household, register

# workers cannot import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])
GOOD = {"domain": "financial", "category": "banking", "doctype": "statement", "vendor": "Chase", "date": "20240115", "subject": "checking account"}


class Counting:
    """A backend that leaves a file for each call."""

    def __init__(self, folder, answer=None):
        self.folder, self.text = folder, json.dumps(GOOD) if answer is None else answer

    def answer(self, system, human):
        with open(os.path.join(self.folder, "calls"), "a") as f:
            f.write("x\n")
        return self.text


def calls(folder):
    path = os.path.join(folder, "calls")
    return len(open(path).readlines()) if os.path.exists(path) else 0


@pytest.mark.parametrize("answer", [json.dumps(GOOD), "Here: " + json.dumps(GOOD), "nothing"])
def test_one_call_a_document(spark, tmp_path, answer):
    docs = spark.createDataFrame([(f"{i}.txt", "text", None, None) for i in range(6)], "path string, content string, error_code string, error_message string")
    folder = str(tmp_path)
    rows = classify(docs, lambda: Counting(folder, answer)).collect()
    assert len(rows) == 6 and calls(folder) == 6


def test_one_call_a_document_through_the_commands(spark, tmp_path, capsys, monkeypatch):
    docs, folder = tmp_path / "docs", str(tmp_path)
    docs.mkdir()
    for i in range(3):
        (docs / f"{i}.txt").write_text("financial banking statement")
    truth = tmp_path / "truth.jsonl"
    truth.write_text("\n".join(json.dumps({"filename": f"{i}.txt", "domain": "financial", "category": "banking", "doctype": "statements"}) for i in range(3)))
    monkeypatch.setattr(cli, "_maker", lambda args, s: lambda: Counting(folder))
    for n, argv in enumerate((["classify", str(docs)], ["tag", str(docs)], ["evaluate", str(docs), "--ground-truth", str(truth)], ["organise", str(docs), "--dry-run"]), 1):
        assert cli.main(argv, spark) == 0
        assert calls(folder) == 3 * n
    assert '"processed": 3, "renamed": 3' in capsys.readouterr().out


def test_one_parse_a_file_and_plugged_parsers(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.pdf").write_bytes(b"one\ftwo\f \fthree")
    (tmp_path / "docs" / "b.docx").write_bytes(b"x")
    (tmp_path / "docs" / "c.txt").write_bytes(b"\xff\xfe")
    folder = str(tmp_path)

    def pdf(data):
        Counting(folder).answer("", "")
        return data.decode().split("\f")

    parsers = files.PARSERS | {".pdf": files.Parser(pdf, name="split"), ".docx": files.Parser(pdf, lambda: False, "office")}
    assert files.unavailable(parsers) == [".docx"]
    got = {r["path"][-6:]: r for r in files.documents(spark, str(tmp_path / "docs"), parsers=parsers).collect()}
    assert calls(folder) == 1
    a = got["/a.pdf"]
    assert (a["content"], a["page_count"], a["pages_sampled"], a["loader_backend"]) == ("one\n\ntwo\n\nthree", 4, 4, "split") and a["loader_latency_ms"] >= 0
    assert got["b.docx"]["error_message"] == "the parser office is not available" and got["/c.txt"]["error_code"] == "DOCUMENT_LOAD_FAILED"
    (tmp_path / "docs" / ".hid").mkdir()
    (tmp_path / "docs" / ".hid" / "x.txt").write_text("t")
    assert files.found(spark, str(tmp_path / "docs")).count() == 3 and files.found(spark, str(tmp_path / "docs"), hidden=True).count() == 4


@pytest.fixture
def server():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, dict(self.headers), body))
            if "refuse" in json.dumps(body):
                self.send_error(429, "busy")
                return
            answer = {
                "/api/chat": {"message": {"content": json.dumps(GOOD)}, "prompt_eval_count": 7, "eval_count": 5},
                "/chat/completions": {"choices": [{"message": {"content": json.dumps(GOOD)}}], "usage": {"prompt_tokens": 7, "completion_tokens": 5, "total_tokens": 0}},
                "/messages": {"content": [{"type": "tool_use", "input": GOOD}], "usage": {"input_tokens": 7, "output_tokens": 5, "cache_read_input_tokens": 3}},
            }[self.path]
            data = json.dumps(answer).encode() if "odd" not in json.dumps(body) else b"[]"
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", seen
    made.shutdown()


@pytest.mark.parametrize("provider", sorted(backends.PROVIDERS))
def test_backends(server, monkeypatch, provider):
    url, seen = server
    key = backends.PROVIDERS[provider].key
    settings = config.Settings(provider=provider, model="m", max_tokens=10)
    if key:
        monkeypatch.delenv(key, raising=False)
        with pytest.raises(ValueError, match=key):
            backends.maker(settings, url)
        monkeypatch.setenv(key, "secret")
    got = backends.maker(settings, url)().answer("menu", "text")
    assert json.loads(got.text) == GOOD and (got.input_tokens, got.output_tokens, got.total_tokens) == (7, 5, 12)
    body = seen[-1][2]
    if provider == "ollama":
        assert body["format"] == "json" and body["options"]["num_predict"] == backends.LOCAL_FLOOR
    elif provider == "anthropic":
        assert body["tool_choice"]["name"] == body["tools"][0]["name"] and got.cache_read_input_tokens == 3 and {k.lower(): v for k, v in seen[-1][1].items()}["x-api-key"] == "secret"
    else:
        assert body["response_format"]["json_schema"]["strict"] and seen[-1][1]["Authorization"] == "Bearer secret" and body["max_tokens"] == 10
    with pytest.raises(backends.ApiError, match="429"):
        backends.Http(settings, url).answer("", "refuse")
    with pytest.raises(backends.ApiError, match="no completion"):
        backends.Http(settings, url).answer("", "odd")
    with pytest.raises(ConnectionError):
        backends.Http(settings, "http://127.0.0.1:1").answer("", "")


def test_failures_have_codes_in_order():
    assert [failure(e)[0] for e in (prompts.TemplateError("x"), ConnectionResetError("x"), TimeoutError(), backends.ApiError("x"), ValueError("x"), KeyError("x"))] == ["TEMPLATE_ERROR", "LLM_API_ERROR", "LLM_API_ERROR", "LLM_API_ERROR", "CONFIG_ERROR", "UNEXPECTED_ERROR"]


def test_stop_after_the_first_failure_and_metrics(spark, tmp_path):
    folder = str(tmp_path)

    class Failing(Counting):
        def answer(self, system, human):
            super().answer(system, human)
            raise backends.ApiError("no")

    docs = spark.createDataFrame([(f"{i}.txt", "text", None, None) for i in range(4)], "path string, content string, error_code string, error_message string").coalesce(1)
    rows = invoke(docs, lambda: Failing(folder), stop=True, debug=True).orderBy("path").collect()
    assert calls(folder) == 1 and [r["error_code"] for r in rows] == ["LLM_API_ERROR"] + ["UNEXPECTED_ERROR"] * 3 and "text" in rows[0]["prompt"]

    class Telling:
        def answer(self, system, human):
            return backends.Answer(json.dumps(GOOD), 1_000_000, 100_000)

    row = classify(docs, Telling, model="gpt-4o").first()
    assert (row["metrics"]["total_tokens"], row["metrics"]["cost_usd"], row["metrics"]["model"]) == (1_100_000, 3.5, "gpt-4o")
    assert metrics.price_of(None) is None and metrics.price_of("nobody") is None


def test_templates(tmp_path):
    body = "# System Prompt\n{taxonomy_menu}\n# Human Prompt\n{document_content}"
    path = tmp_path / "p.md"
    path.write_text("---\nname: one\n---\n" + body)
    matter, got = prompts.load(str(path))
    assert matter == {"name": "one"} and prompts.split(got) == ("{taxonomy_menu}", "{document_content}")
    for content, match in ((b"\xff", "UTF-8"), (b"---\na: [\n---\n" + body.encode(), "frontmatter"), (b"none", "lacks")):
        path.write_bytes(content)
        with pytest.raises(prompts.TemplateError, match=match):
            prompts.load(str(path))
    with pytest.raises(prompts.TemplateError, match="not found"):
        prompts.load(str(tmp_path / "none"))
    with pytest.raises(prompts.TemplateError):
        prompts.load(str(tmp_path))


def test_experiment(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("financial banking statement")
    manifest = {"name": "e", "models": [{"provider": "ollama", "model": "m"}, {"provider": "openai", "name": "n"}], "documents": [{"path": str(tmp_path / "a.txt"), "expected": GOOD | {"doctype": "statements"}}]}
    path, out = tmp_path / "e.json", tmp_path / "out.jsonl"
    path.write_text(json.dumps(manifest))
    assert cli.main(["experiment-validate", str(path)], spark) == 0
    assert cli.main(["experiment-run", str(path), "--dry-run"], spark) == 0 and not out.exists()
    assert cli.main(["experiment-run", str(path), "--output", str(out)], spark) == 0
    records = lines.records(spark, str(out))
    got = sorted((r["provider"], r["model"], r["success"], r["matches"]["domain"], r["matches"]["vendor"], r["all_match"]) for r in records.collect())
    assert got == [("ollama", "m", True, True, False, False), ("openai", "n", True, True, False, False)]
    assert {(r["field"]) for r in experiments.mismatches(records).collect()} >= {"vendor", "subject"}
    for form in ("text", "csv", "json"):
        assert cli.main(["report", str(out), "--format", form], spark) == 0
    shown = capsys.readouterr().out
    assert json.loads(shown[shown.rindex('\n{\n') :])["models"] == ["ollama/m", "openai/n"]
    manifest["documents"] += [{"path": str(tmp_path / "a.txt")}, {"path": "~/none.txt"}]
    manifest["models"] += [{"provider": "nobody", "model": "m"}]
    manifest["config"] = {"prompt": str(tmp_path / "none.md")}
    path.write_text(json.dumps(manifest))
    assert cli.main(["experiment-validate", str(path)], spark) == 1
    issues = capsys.readouterr().err
    assert all(x in issues for x in ("duplicate document", "document not found", "unknown provider: nobody", "template not found"))


def test_csv_has_blanks_for_nulls(spark):
    record = spark.createDataFrame([("e", "t", "d/x.pdf", None, None, None, False, None, None, None, None, None, None)], lines.RECORD)
    assert list(experiments.csv_rows(record).first()) == ["x.pdf", "", "", "false", "", "", "", "", "", "", "", "false"]


def test_renames_meet_no_name(spark):
    rows = spark.createDataFrame([(1, "f", "a.pdf", "q"), (2, "f", "a.pdf", "r"), (3, "f", "a-1.pdf", "s"), (4, "f", "a-1.pdf", "t"), (5, "f", "b.pdf", "u"), (6, "f", "b.pdf", "v"), (7, "g", "b", "b"), (8, "g", "b", "w")], "n int, folder string, target string, own string")
    held = spark.createDataFrame([("f", "b.pdf"), ("f", "b-2.pdf"), ("g", "b"), ("f", "a-3.pdf")], "folder string, name string")
    got = {r["n"]: r["new_name"] for r in actions.rename_all(rows, "folder", "target", "n", held).collect()}
    assert got == {1: "a.pdf", 2: "a-2.pdf", 3: "a-1.pdf", 4: "a-1-1.pdf", 5: "b-1.pdf", 6: "b-3.pdf", 7: "b", 8: "b-1"}


def test_organise_and_tag(spark, tmp_path, capsys):
    docs = tmp_path / "docs"
    docs.mkdir()
    for n in ("one.txt", "two.txt", "odd.bin"):
        (docs / n).write_text("financial banking statement")
    assert cli.main(["organise", str(docs)], spark) == 0
    names = sorted(os.listdir(docs))
    assert len(names) == 3 and names[0] == "odd.bin" and names[1].endswith("-1.txt") and names[2] == names[1].replace("-1.txt", ".txt")
    capsys.readouterr()
    assert cli.main(["organise", str(docs)], spark) == 0
    assert '"renamed": 0' in capsys.readouterr().out
    store = actions.AttributeTags()
    try:
        store.write(str(docs / "odd.bin"), ["a"])
    except OSError:
        pytest.skip("a file system without attributes")
    assert store.read(str(docs / "odd.bin")) == ["a"]
    store.write(str(docs / "odd.bin"), [])
    assert store.read(str(docs / "odd.bin")) == []
    assert cli.main(["tag", str(docs), "--store", "attributes", "--tag-mode", "missing"], spark) == 0
    assert store.read(str(docs / names[2])) == ["financial", "banking", "statements"]


def test_actions_fail_as_rows(spark):
    class Broken(actions.Tagger):
        def execute(self, row):
            raise OSError("disk")

    actions.register("Broken", Broken)
    rows = spark.createDataFrame([("p", "d", "c", "t")], "path string, domain string, category string, doctype string")
    action = actions.ACTIONS["broken"](None)
    plan = action.plan(rows)
    assert [d.success for d in actions.carry_out(plan, action, dry_run=True)] == [True]
    done = list(actions.carry_out(plan, action))
    assert not done[0].success and done[0].error == "OSError: disk"
    assert [actions.totals(3, a, b) for a, b in ((0, 0), (1, 1), (1, 2))] == [0, 1, 2] and actions.totals(0, 0, 0) == 0
    results = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "original string, seq int")
    found = spark.createDataFrame([("a", "y/a"), ("a", "x/a")], "name string, path string")
    assert sorted((r["original"], r["seq"], r["path"]) for r in actions.by_rank(results, found).collect()) == [("a", 1, "x/a"), ("a", 2, "y/a"), ("b", 3, None)]
    assert {r["path"] for r in actions.first_match(results, found).collect()} == {"x/a", None}


def test_coverage_from_nothing(spark):
    rows = [tuple(r) for r in coverage.from_nothing(spark, 40, 5, 1).collect()]
    assert len(rows) == len({r[:3] for r in rows}) == 40 and sum(r[3] == 0 for r in rows) == 5
    assert {r[0] for r in rows} == set(get().canonical_domains())
    assert sorted(rows) == sorted(tuple(r) for r in coverage.from_nothing(spark, 40, 5, 1).repartition(7).collect())
    few = coverage.from_nothing(spark, 6, 5, 1)
    assert few.count() == 6 and few.where("stage = 0").count() == 5
    checked = coverage.checked(coverage.from_nothing(spark, 60, 12, 2).select("domain", "category", "doctype"))
    assert checked.where("error IS NOT NULL").count() == 0
    assert coverage.checked(spark.createDataFrame([("nope", "x", "y")], coverage.TRIPLE)).first()["error"] == "unknown domain: nope"
    asked = {r["doctype"]: r for r in coverage.asked(spark.createDataFrame([("legal", "estate", "will"), ("pets", "vet_visit", "bill")], coverage.TRIPLE)).collect()}
    assert asked["will"]["words"] == 1100 and asked["bill"]["words"] == 320 and asked["bill"]["subject"] == "vet visit bill"


def test_three_stages(spark):
    have = spark.createDataFrame([("financial", "banking", "statement")] * 4 + [("food", None, None), ("none", "a", "b")], coverage.TRIPLE)
    rows = coverage.three_stages(have, 8, 3, 3, 7).collect()
    by = lambda d, s: [r for r in rows if r["domain"] == d and r["stage"] == s]
    for d in get().canonical_domains():
        total = sum(r["n"] for r in rows if r["domain"] == d)
        assert total == 8 - {"financial": 4, "food": 1}.get(d, 0)
        own = get().canonical_categories(d)
        assert all(r["category"] in own for r in rows if r["domain"] == d and r["stage"] < 3)
    assert len({r["category"] for r in by("financial", 1)} | {"banking"}) == 3
    assert len({r["doctype"] for s in (1, 2) for r in by("financial", s)} | {"statement"}) == 3
    assert len({r["category"] for r in by("food", 1)}) == min(3, len(get().canonical_categories("food"))) and {r["domain"] for r in rows} == set(get().canonical_domains())
    # a domain with enough documents still gets the categories it lacks
    full = spark.createDataFrame([("financial", "banking", "statement")] * 20, coverage.TRIPLE)
    assert sum(r["n"] for r in coverage.three_stages(full, 8, 3, 3, 7).where("domain = 'financial'").collect()) == 2 + len({r["doctype"] for r in coverage.three_stages(full, 8, 3, 3, 7).where("domain = 'financial' AND stage = 2").collect()})


def test_names_and_terms(spark):
    one = spark.createDataFrame([("a",), (None,), ("a",)], "filename string")
    two = spark.createDataFrame([("b",)], "filename string")
    assert sorted(r[0] for r in coverage.taken_names(one, two).collect()) == ["a", "b"]
    plan = spark.createDataFrame([("a", 1), ("c", 2)], "filename string, n int")
    assert [r["n"] for r in coverage.not_yet(plan, one, two).collect()] == [2]
    shared = {r["term"] for r in coverage.shared_terms(get(), spark).collect()}
    v = get()
    assert shared == {c for d in v.canonical_domains() for c in v.canonical_categories(d)} & ({*v.singulars} | {*v.singulars.values()})
    assert coverage.shared_terms(get(), spark, tuple(shared)).count() == 0


def test_dashboard_files(spark, tmp_path):
    runs = tmp_path / "runs"
    for folder, file, body in (("20260501-b", "gemma4_docling.json", {"model": "m", "domain_accuracy": 0.5, "total": 4, "wallclock_s": 12.0, "documents": [{"secret": 1}]}), ("20260401-a", "x.json", {"model": "n", "category_accuracy": 0.25}), ("20260401-a", "bad.json", None), ("undated", "x.json", {"model": "n", "domain_accuracy": 0.1})):
        (runs / folder).mkdir(parents=True, exist_ok=True)
        (runs / folder / file).write_text(json.dumps(body) if body else "{")
    (runs / "20260401-a" / "eval.stderr").write_text("2026-04-01 10:00:00 a\n2026-04-01 10:01:30 b\n")
    data, page = tmp_path / "data.json", tmp_path / "page.html"
    page.write_text(f"<html>{dashboard.OPEN}old</script><p>rest</p></html>")
    for _ in range(2):
        assert cli.main(["dashboard", str(runs), str(data), "--page", str(page)], spark) == 0
        got = json.loads(data.read_text())["runs"]
        assert [r["run_id"] for r in got] == ["20260401-a/x.json", "20260501-b/gemma4_docling.json"]
        assert got[0]["runtime_seconds"] == 90 and got[1]["runtime_seconds"] == 12 and got[1]["loader"] == "docling"
    assert "secret" not in page.read_text() and page.read_text().endswith("</script><p>rest</p></html>") and '"runs"' in page.read_text()
    with pytest.raises(ValueError, match="no block"):
        dashboard.spliced("<p>", "{}")
    rows = spark.createDataFrame([("synthetic",), ("real-world",)], "corpus string")
    assert dashboard.of_corpus(rows, real=False).count() == 1
    assert spark.range(1).select(dashboard.seconds_between(F.lit("2026-01-01 00:00:05"), F.lit("2026-01-01 00:01:05"))).first()[0] == 60


def test_harvest_outputs(spark, tmp_path, capsys):
    answers = tmp_path / "answers.jsonl"
    answers.write_text("\n".join(json.dumps(x) for x in (GOOD, GOOD | {"doctype": "Some Thing"}, {"domain": "x"})))
    out = tmp_path / "h" / "out.json"
    assert cli.main(["harvest", str(answers), "--output", str(out)], spark) == 0
    got = json.loads(out.read_text())
    assert got["metadata"]["processed"] == 2 and got["metadata"]["errors"] == 1 and got["vendor_frequency"] == {"chase": 2} and got["date_frequency"] == {"2024": 2}
    assert {"field": "doctype", "raw": "some_thing", "canonical": None, "domain": None, "count": 1} in got["drift"] and got["raw_tuples"][0]["count"] == 1
    assert cli.main(["discover", str(answers), "--format", "json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["doctypes"] == ["some_thing", "statement"]
    assert cli.main(["discover", str(answers)], spark) == 0
    space: dict = {}
    exec(capsys.readouterr().out, space)
    assert space["DISCOVERED_DOMAINS"] == {"financial", "x"} and space["DISCOVERED_CATEGORIES"]["financial"] == {"banking"}
    (tmp_path / "docs").mkdir()
    for i in range(4):
        (tmp_path / "docs" / f"{i}.txt").write_text("financial banking statement")
    assert cli.main(["harvest", str(tmp_path / "docs"), "--documents", "--sample", "3", "--seed", "1"], spark) == 0
    assert json.loads(capsys.readouterr().out)["metadata"]["corpus_size"] == 3
    base, new = (spark.createDataFrame(x, "term string, n long") for x in ([("a", 1), ("b", 9), ("c", 9), ("d", 6)], [("a", 7), ("c", 20), ("d", 7)]))
    assert {r["term"]: r["verdict"] for r in harvest.verdicts(harvest.delta(base, new, "term")).collect()} == {"a": "new", "b": "gone", "c": "moved", "d": "steady"}
    counts = spark.createDataFrame([(533, 14)], "processed long, errors long")
    assert harvest.within(counts, counts).first()["accepted"]


def test_evaluation_summary(spark, tmp_path, capsys):
    fields = ("domain", "category", "doctype", "vendor", "date")
    schema = "filename string, " + ", ".join(f"{c} string" for c in fields)
    truth = spark.createDataFrame([(f"{i}", "x", "c", "t", None, None) for i in range(7)] + [("e", "", " ", "t", None, None)], schema)
    guess = spark.createDataFrame([(f"{i}", "y", "c", "t", None, None) for i in range(7)] + [("z", "x", "c", "t", None, None)], schema)
    shown = evaluate.text_summary(evaluate.compared(guess, truth), "p", "m")
    assert "Domain accuracy:     0.0%" in shown and "Vendor" not in shown and "  0: x -> y" in shown and shown.endswith("... and 2 more")
    issues = {(r["filename"], r["issue"]) for r in evaluate.stub_issues(truth, guess).collect()}
    assert issues == {("e", "empty: domain, category"), ("e", "no file"), ("z", "no entry")}


def test_side_by_side_keeps_one_sided_rows(spark):
    schema = "filename string, domain string, category string, doctype string, vendor string, date string"
    truth = spark.createDataFrame([(f, "x", "c", "t", None, None) for f in "abc"], schema)
    guess = lambda names: spark.createDataFrame([(f, "x", "d", "t", None, None) for f in names], schema)
    rows = evaluate.side_by_side(evaluate.compared(guess("ab"), truth), evaluate.compared(guess("bc"), truth))
    got = {r["filename"]: (r["domain_a"], r["category_a"], r["domain_b"], r["category_b"]) for r in rows.collect()}
    assert got == {"a": (True, False, None, None), "b": (True, False, True, False), "c": (None, None, True, False)}


def test_files_of_lines(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    for i in range(3):
        lines.append(str(path), {"filename": f"f{i % 2}", "domain": "d"})
    with path.open("a") as f:
        f.write("# note\n{bad\n")
    assert [r["filename"] for r in lines.rows(spark, str(path)).orderBy("line").collect()] == ["f0", "f1", "f0"] and os.listdir(tmp_path) == ["t.jsonl"]
    rows = spark.createDataFrame([(True, 600), (True, 5), (False, 9)], "ok boolean, tokens int")
    assert tuple(metrics.generation(rows, "tokens", "ok").first()) == (2, 1, 1, True)


def test_registries(spark):
    paths.register("Plain", lambda doctype, vendor, subject, date, ext: F.concat(doctype, ext))
    docs = spark.createDataFrame([("a.txt", "financial banking statement", None, None)], "path string, content string, error_code string, error_message string")
    assert classify(docs, naming="plain").first()["suggested_filename"] == "statement.txt"
    with pytest.raises(ValueError, match="unknown naming policy"):
        paths.policy("none")
    register("Own", household)
    assert "own" in available() and get("OWN").canonical_domains() == get().canonical_domains()
    with pytest.raises(ValueError, match="unknown vocabulary"):
        get("none")


def test_small_functions(spark):
    one = spark.range(1)
    assert one.select(metrics.cached_cost(F.lit(1000), F.lit(200), F.lit(100), F.lit(10), {"input": 1.0, "read": 0.1, "write": 2.0, "output": 5.0})).first()[0] == pytest.approx((700 + 20 + 200 + 50) / 1e6)
    assert one.select(metrics.cached_cost(F.lit(1), F.lit(0), F.lit(0), F.lit(0), None)).first()[0] == 0
    log = "2026-01-01 00:00:00 a\nx\n2026-01-02 00:00:10 b"
    assert one.select(lines.log_runtime(F.lit(log)), lines.log_runtime(F.lit("2026-01-01 00:00:00"))).first()[:] == (86410, None)
    kinds = ["", "---", "|-|-|", "| a |", "# a", "## a", "### a", "- a", "1. a", "a"]
    rows = spark.createDataFrame([(k,) for k in kinds], "l string").select(text.line_kind(F.col("l")).alias("k")).collect()
    assert sorted(r["k"] for r in rows) == sorted(["blank", "rule", "separator", "row", "h1", "h2", "h3", "bullet", "numbered", "text"])


def test_version_check(tmp_path):
    (tmp_path / "p.toml").write_text('[project]\nversion = "1.2"\n')
    (tmp_path / "m.py").write_text("__version__ = '1.2'\n")
    argv = ["version-check", str(tmp_path / "p.toml"), str(tmp_path / "m.py")]
    assert cli.main(argv) == 0
    (tmp_path / "m.py").write_text("__version__ = '1.3'\n")
    assert cli.main(argv) == 1


def test_plan_command(spark, tmp_path, capsys):
    truth = tmp_path / "t.jsonl"
    truth.write_text(json.dumps({"filename": "a", "domain": "financial", "category": "banking", "doctype": "statement"}))
    assert cli.main(["plan", str(truth), "--count", "20", "--min-long", "2"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 20
    assert cli.main(["plan", str(truth)], spark) == 0
    assert '"subject"' in capsys.readouterr().out


def test_organise_with_tags_and_counters(spark, tmp_path, capsys):
    docs = tmp_path / "docs"
    docs.mkdir()
    for n in ("one", "two"):
        (docs / f"{n}.txt").write_text("financial banking statement")
    (docs / "bad.pdf").write_bytes(b"x")
    store = actions.AttributeTags()
    try:
        store.write(str(docs / "one.txt"), ["mine"])
    except OSError:
        pytest.skip("no extended attributes here")
    argv = ["organise", str(docs), "--store", "attributes", "--tag-fields", "domain,doctype"]
    assert cli.main([*argv, "--dry-run"], spark) == 1
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"processed": 3, "renamed": 2, "tagged": 2, "skipped": 1, "dry_run": True}
    assert (docs / "one.txt").exists() and store.read(str(docs / "one.txt")) == ["mine"]
    assert cli.main(argv, spark) == 1
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"processed": 3, "renamed": 2, "tagged": 2, "skipped": 1, "dry_run": False}
    found = {p.name: store.read(str(p)) for p in docs.iterdir() if p.suffix == ".txt"}
    assert len(found) == 2 and "one.txt" not in found
    assert sorted(map(len, found.values())) == [2, 3] and all("financial" in t for t in found.values())
    assert cli.main(argv, spark) == 1
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"processed": 3, "renamed": 0, "tagged": 2, "skipped": 1, "dry_run": False}


def test_structure_beside_the_results(spark, tmp_path, capsys):
    docs, debug = tmp_path / "docs", tmp_path / "debug"
    docs.mkdir()
    (docs / "a.md").write_text("# Financial\n\nA banking statement.\n\n- one\n- two\n")
    assert cli.main(["classify", str(docs), "--debug-dir", str(debug), "--debug-structure", "--capture-debug"], spark) == 0
    rows = spark.read.json(f"{debug}/structure").collect()
    assert [n["kind"] for n in json.loads(rows[0]["structure"])] == ["heading", "paragraph", "list", "item", "item"]
    assert spark.read.json(f"{debug}/calls").first()["prompt"]


def test_spooled_rows(spark):
    rows = storage.spooled(spark, ({"path": f"é{i}\n", "tags": ["a"] * (i % 3)} for i in range(500)), "path string, tags array<string>", size=1000)
    assert {r["path"]: len(r["tags"]) for r in rows.collect()} == {f"é{i}\n": i % 3 for i in range(500)}
    assert storage.spooled(spark, [], "path string").count() == 0
