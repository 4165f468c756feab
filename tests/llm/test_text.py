"""Encoding, rules, classifiers, personal data, pages and mixing: against plain versions, and their edge cases."""

import base64
import collections
import random
import time
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.llm import byte_bpe, html_text, labelled, mixing, pii, quality_classifier, quality_rules, toxicity
from cartulary.llm.queries import vocabulary

DOC = "doc_id long, text string"
ODD = [None, "", " ", "\n\n", "a", "naïve café  — \t x\U0001f600y", "the the the\nthe the the\n", "A" * 5000, "x\x00y", "1" * 3000, "w " * 3000]


def odd(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "no id", "clash"), (4, "a", "clash")], DOC + ", score string")


# ---- byte-level BPE --------------------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path, pattern = vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("abcd-=é 1\n.xyzthe☃　") * rng.choice([1, 1, 2, 9]) for _ in range(60)) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), DOC)
    rows = byte_bpe.decode(byte_bpe.encode(frame, path, pattern, offsets=True), path, pattern).withColumn("again", byte_bpe.decoded_text()).collect()
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert ids == plain.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == texts[r["doc_id"]].encode() and r["again"] == texts[r["doc_id"]]
        for i, s, e in zip(ids, r["starts"], r["ends"], strict=True):
            assert byte_bpe.model(path, pattern).tokens[i] in texts[r["doc_id"]][s:e].encode()


def test_bpe_edges(spark):
    path, pattern = vocabulary()
    rows = byte_bpe.encode(odd(spark), path, pattern)
    assert rows.columns == ["doc_id", "text", "score", "ids", "n_tokens"] and rows.count() == len(ODD) + 2
    assert rows.where("doc_id = 0").first()["n_tokens"] == 0
    assert byte_bpe.encode(odd(spark).limit(0), path, pattern).count() == 0
    cut = byte_bpe.ByteBPE(path, pattern)
    assert cut.decode(cut.encode(["\U0001f600"])[0][:4]) != b""


# ---- quality rules ---------------------------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_counts_equal_plain_ones(spark):
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice(["a ", "b ", "c\n", "é# ", "\t", "|", "d "]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), DOC)
    for r in quality_rules.features(frame).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(texts[r["doc_id"]])


def test_judged(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ka lo mi re tu sa ne vo pi du".split()) for _ in range(rng.randint(1, 4)))
    clean = lambda: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(8))
    docs = [(i, clean()) for i in range(60)] + [(100 + i, " ".join(f"w{i}{k}&&&" for k in range(90))) for i in range(6)] + [(200, "buy now! " * 60), (201, None)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(docs, DOC)).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not any(got[100 + i]["kept"] for i in range(6))
    assert got[200]["base_failed"] and not got[200]["kept"] and got[201]["base_failed"]
    assert quality_rules.judge(odd(spark)).count() == len(ODD) + 2 and quality_rules.judge(odd(spark).limit(0)).count() == 0


# ---- classifiers -----------------------------------------------------------------------------------------------------


def corpus(n=500):
    rng = random.Random(4)
    syllables = "ka lo mi re tu sa ne vo pi du".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, toxic, good = [], [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 300))]
        toxic.append(int(rng.random() < 0.25))
        good.append(int(rng.random() < 0.8))
        if toxic[-1]:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbolt", "snarfik"]) + rng.choice(["", "s", "ed", "ik"]))
        docs.append((i, " ".join(words if good[-1] else [w.upper() + "!!" for w in words])))
    return docs, toxic, good


def auc(scores, y):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    y = np.array(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize(("operator", "label", "least"), [(toxicity, "toxic", 0.9), (quality_classifier, "quality", 0.97)])
def test_classifiers_on_held_out_rows(spark, operator, label, least):
    docs, toxic, good = corpus()
    frame = spark.createDataFrame(docs, DOC)
    labels = spark.createDataFrame([(d, q, t) for (d, _), q, t in zip(docs, good, toxic, strict=True)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    model = operator.train(frame, labels)
    rows = operator.score(frame, model).withColumn("fold", labelled.fold()).collect()
    assert all(r["fold"] == zlib.crc32(str(r["doc_id"]).encode()) % 3 for r in rows)
    held = [r for r in rows if r["fold"] == 1]
    truth = toxic if label == "toxic" else good
    assert auc([r["score"] for r in held], [truth[r["doc_id"]] for r in held]) >= least
    out = operator.score(odd(spark), model)
    assert out.count() == len(ODD) + 2 and out.where("score IS NULL OR score < 0 OR score > 1 OR isnan(score)").count() == 0
    assert operator.score(odd(spark).limit(0), model).count() == 0
    # without labels of both kinds there is nothing to learn
    assert operator.score(odd(spark), operator.train(frame, labels.limit(0))).where("score NOT IN (0, 0.5)").count() == 0


def test_misspellings_share_ngrams():
    docs, toxic, _ = corpus()
    model = toxicity.fit([t for _, t in docs], toxic)
    plain = " ".join(w for w in docs[0][1].lower().split() if "grumb" not in w and "snarf" not in w)
    assert model.scores([plain + " grumboltz snarfikk"])[0] > model.scores([plain])[0] + 0.2


def test_toxic_copies_score_like_each_alone():
    docs, toxic, _ = corpus()
    model = toxicity.fit([t for _, t in docs], toxic)
    texts = ["grumbolt", "grumbolt", "", "grumbolt snarfik", "grumbolt snarfik", "lo lo snarfik", "snarfik lo lo lo lo lo lo", "grumbolt grumbolt"]
    alone = [float(model.scores([t])[0]) for t in texts]
    assert model.scores(texts).tolist() == alone and alone[0] > alone[2]


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(300)], DOC)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(7, 0), (7, 1)], "doc_id long, y int")
    texts, y = labelled.sample(docs, labels, "y", 50)
    assert len(texts) == 50 and all(zlib.crc32(t.encode()) % 3 != 1 and int(t) % 2 == v for t, v in zip(texts, y, strict=True)) and "7" not in texts


# ---- personal data ---------------------------------------------------------------------------------------------------


def plain_spans(s):
    digits = lambda x: re.sub(r"[^0-9]", "", x)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", s) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    bits = ["a", "b.c", "@", ".", "1", "22", "255", "4111111111111111", "+", "-", " ", "(", ")", "é", "٣", "x@y.z", "1.2.3.4", "+1 (212) 555-0199", "\n"]
    for _ in range(4000):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(s) == plain_spans(s), s


def test_long_runs_are_linear():
    assert pii.base_spans("7" * 200_000 + "a" * 200_000 + "@") == []


def test_field_adds_and_keeps(spark):
    texts = ["call (212) 555-0142 now", "cards 4111111111111111 4111111111111111 here", "write jane [at] mail.example.org soon", "mail a@b.co at 10.0.0.1", "in 2024 there were 15 of them, 3.5%", None]
    rows = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    cut = lambda i, c: [(s["kind"], texts[i][s["start"] : s["end"]]) for s in rows[i][c]]
    assert cut(0, "added_spans") == [("phone", "(212) 555-0142")]
    assert ("card", "4111111111111111") in cut(1, "added_spans")
    assert cut(2, "added_spans") == [("email", "jane [at] mail.example.org")]
    assert cut(3, "base_spans") == [("email", "a@b.co"), ("ip", "10.0.0.1")] and cut(4, "added_spans") == [] and rows[5]["base_spans"] == []
    clean = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    assert clean[3] == "mail <EMAIL> at <IP>" and clean[5] is None and clean[4] == texts[4]
    assert pii.find(odd(spark)).count() == len(ODD) + 2 and pii.find(odd(spark).limit(0)).count() == 0


def test_checks_take_any_text():
    rng = random.Random(2)
    for _ in range(3000):
        s = "".join(rng.choice(["1", "22", ".", "& ", "[", "]", "²", "x", "@", "(at)", " ", "+", "-"]) for _ in range(rng.randint(0, 12)))
        for kind in range(4):
            got = pii.trimmed(kind, s, 0, len(s))
            assert got is None or pii.WHOLE[kind].fullmatch(s[slice(*got)])
        pii.all_spans([s, s + " " + s], pii.field())


def test_spans_are_joined_by_start_then_kind(spark):
    span = "array<struct<kind:string,start:int,end:int>>"
    row = spark.createDataFrame([([("phone", 5, 9), ("card", 5, 8), ("email", 7, 9), ("ip", 1, 2)],), ([],)], f"s {span}")
    assert [r[0] for r in row.select(pii.joined(F.col("s"))).collect()] == ["ip:1:2,card:5:8,phone:5:9,email:7:9", ""]


def test_field_learns_its_table():
    trained, right, total = pii.field(), 0, 0
    for text, spans in pii.training_rows():
        starts, ends, shapes = pii._tokens(text, 0, len(text))
        labels = trained.decode(trained.scores([shapes]), np.array([len(starts)]))[0]
        gold = np.zeros(len(starts), dtype=int)
        for s, kind, e in spans:
            inside = [i for i, p in enumerate(starts) if s <= p < e]
            gold[inside] = 2 + 2 * kind
            gold[inside[0]] = 1 + 2 * kind
        right, total = right + int((labels == gold).sum()), total + len(gold)
    assert right / total > 0.98


# ---- pages -----------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies &amp; more of them.</div>
<article><h1>The  title</h1><p>First &lt;b&gt; paragraph with a <a href="x">link</a>
and more.</p>{middle}<p>Last.</p></article><aside>Read also this</aside><section id="comments"><p>Great text, I liked it a lot, thank you very much!</p></section>
<form><label>Name</label></form><footer>&copy; 2020</footer></body></html>"""


def test_page(spark):
    pages = [PAGE.format(middle=""), PAGE.format(middle='<div class="ad">Buy this</div><p>Mid<br>dle.'), None, "", "<p>unclosed <b>text", "no markup at all", "<" * 50, "<script>" + "x" * 100]
    frame = spark.createDataFrame([(i, p, "old") for i, p in enumerate(pages)], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(frame).collect()}
    assert got[0] == "The title\nFirst <b> paragraph with a link and more.\nLast."
    assert got[1] == "The title\nFirst <b> paragraph with a link and more.\nMid dle.\nLast."
    assert got[2] == got[3] == got[7] == "" and got[4] == "unclosed text" and got[5] == "no markup at all"
    assert html_text.extract(frame.limit(0)).count() == 0


def test_tree_fits_its_table():
    x, y = html_text.labelled_blocks()
    assert all(html_text.judge(html_text.tree(), r) == v for r, v in zip(x, y, strict=True))


# ---- mixing ----------------------------------------------------------------------------------------------------------


def test_pattern_deviates_by_less_than_a_block():
    rng = random.Random(5)
    for _ in range(100):
        weights = {s: rng.randint(1, 30) for s in range(rng.randint(1, 8))}
        order = mixing.pattern(weights)
        assert collections.Counter(order) == weights and mixing.deviation(order, weights) < 1


def plain_mix(blocks, weights):
    left, out = {s: n for s, n in blocks.items() if n}, []
    while left:
        held = {s: weights[s] for s in left if weights.get(s, 0) > 0} or dict.fromkeys(left, 1)
        order, t = mixing.pattern(held), 0
        while all(left.get(s, 0) for s in held):
            s = order[t % len(order)]
            out.append(s)
            left[s] -= 1
            t += 1
        left = {s: n for s, n in left.items() if n}
    return out


def test_mix_equals_a_simulation(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 50)
    rows = [(i, f"text {i}", None if i % 9 == 0 else f"s{i % 4}") for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in (None, {"s0": 5, "s1": 1, None: 2}):
        got = mixing.mix(frame, weights).toPandas().sort_values("place")
        assert len(got) == 700 and got.place.is_unique and ((got.slot >= got.release) & (got.slot < got.due)).all()
        counts = {k: v for k, v in frame.groupBy("source").count().collect()}
        held = mixing.default_weights(counts) if weights is None else weights
        names = sorted(counts, key=lambda s: (s is not None, s))
        blocks = {i: -(-counts[s] // mixing.BLOCK) for i, s in enumerate(names)}
        order = plain_mix(blocks, {i: held.get(s, 0) for i, s in enumerate(names)})
        first = got.drop_duplicates("slot")
        assert [names[i] for i in order] == [None if x is None or x != x else x for x in first.source]


def test_many_sources_and_one_of_most_rows(spark):
    rows = [(i, f"text {i}", "large" if i % 3 else f"s{i % 1500}") for i in range(12_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    mixed = mixing.mix(frame)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    # rows meet phases by nothing but their part
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    got = mixed.toPandas().sort_values("place")
    counts = {k: v for k, v in frame.groupBy("source").count().collect()}
    names, held = sorted(counts), mixing.default_weights(counts)
    order = plain_mix({i: -(-counts[s] // mixing.BLOCK) for i, s in enumerate(names)}, {i: held[s] for i, s in enumerate(names)})
    assert len(got) == 12_000 and got.place.is_unique and [names[i] for i in order] == list(got.drop_duplicates("slot").source)


def test_five_thousand_sources_are_scheduled_in_seconds():
    blocks = {s: 1 + s % 9 for s in range(5000)} | {5000: 2_000_000}
    began = time.time()
    spans, slots = mixing.phases(blocks, mixing.default_weights({s: 16 * n for s, n in blocks.items()}))
    assert time.time() - began < 60 and len(spans) <= sum(blocks.values())
    assert sum(end - first for _, _, first, end, *_ in spans) == sum(blocks.values()) and len(slots) < 200_000


def test_mix_edges(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, None, None), (2, "", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("slot", F.lit("old"))
    got = mixing.mix(frame).collect()
    assert len(got) == 4 and len({r["place"] for r in got}) == 4
    assert mixing.mix(frame.limit(0)).count() == 0
