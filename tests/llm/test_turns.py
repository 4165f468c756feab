"""Conversation repair against full audit strings, and by trial of every audit on small conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb

from pyspark.sql import functions as F

from cartulary.llm import oracles, queries, turns

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def follows(last, letter):
    return (letter == "s" and last == "") or (letter == "u" and last in ("", "s", "a")) or (letter == "a" and last == "u")


def solved(rows):
    """(cost, audit, items) with whole strings in place of ranks, by relaxation to a fixed point."""
    best = {"": (0, "", ())}

    def insert(of):
        changed = True
        while changed:
            changed = False
            for last, (cost, audit, items) in list(of.items()):
                for role in ("user", "assistant"):
                    new = (cost + 2, audit + "I", (*items, (role, "")))
                    if follows(last, role[0]) and (role[0] not in of or new[:2] < of[role[0]][:2]):
                        of[role[0]], changed = new, True

    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        insert(best)
        after = {}

        def put(last, new, after=after):
            if last not in after or new[:2] < after[last][:2]:
                after[last] = new

        for last, (cost, audit, items) in best.items():
            put(last, (cost + 3, audit + "D", items))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if role[:1] and follows(last, role[:1]):
                put(role[:1], (cost + more, audit + "K", (*items, (role, text))))
            for other in ("user", "assistant"):
                if follows(last, other[0]):
                    put(other[0], (cost + 2 + more, audit + "R", (*items, (other, text))))
        best = after
    insert(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def expected(conversation):
    """The row of one conversation's turns in order."""
    if not conversation:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    cost, audit, items = solved(conversation)
    found, numbers, letters = faults(conversation), [t for t, _, _ in conversation if t is not None], [r[:1] for _, r, _ in conversation]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(letters))
    return (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in items).encode()).hexdigest())


def grouped(rows):
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn, role if role is not None else " ", text if text is not None else " "))
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2][:64], hashlib.md5(x[2].encode()).hexdigest())
    return {conv: expected(sorted(some, key=order)) for conv, some in of.items()}


def reported(df, **options):
    return {r[0]: tuple(r)[1:] for r in turns.report(turns.parts(df, **options)).collect()}


def random_rows(rng, conversations, longest):
    roles = ["user", "assistant", "system", "tool", "", None, "User", "super"]
    texts = ["Yes.", "No", "", " \t", None, "Why?", "long text without an end", "Fin!\n ", "é.", "Yes.x"]
    out = []
    for c in range(conversations):
        for _ in range(rng.randrange(1, longest)):
            out.append((c or None, rng.choice([None, *range(12)]), rng.choice(roles[:3] * 4 + roles), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}."))
    return out


def test_random_conversations_in_whole_and_in_parts(spark):
    rows = random_rows(random.Random(5), 60, 14)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = grouped(rows)
    assert reported(df) == want
    # parts of three turns: repeats, illegal pairs, gaps, costs and ties go across them
    assert reported(df, most=3) == want
    assert reported(df, most=1) == want


def test_audit_is_least_of_all_audits():
    rng = random.Random(9)
    for _ in range(60):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c?"])) for i in range(rng.randrange(1, 5))]
        found = faults(rows)
        every = []
        for choice in itertools.product(["D", "K", "R"], repeat=len(rows)):
            for gaps in itertools.product(range(3), repeat=len(rows) + 1):
                audit = "".join("I" * g + c for g, c in zip(gaps, choice, strict=False)) + "I" * gaps[-1]
                cost, letters, right = 2 * sum(gaps), "", True
                for g, c, (_, role, _), fault in zip(gaps, choice, rows, found, strict=False):
                    for _ in range(g):
                        letters += "a" if letters[-1:] == "u" else "u"
                    cost += {"D": 3, "K": 0, "R": 2}[c] + (fault == "truncated" and c != "D")
                    right &= c == "D" or fault not in ("blank", "duplicate")
                    letters += {"D": "", "K": role[0], "R": "a" if letters[-1:] == "u" else "u"}[c]
                for _ in range(gaps[-1]):
                    letters += "a" if letters[-1:] == "u" else "u"
                if right and LEGAL.match(letters):
                    every.append((cost, audit))
        cost, audit, _ = solved(rows)
        assert (cost, audit) == min(every)


def test_one_conversation_of_most_rows(spark):
    rng = random.Random(1)
    rows = [(7, i // 3, rng.choice(["user", "assistant"]), rng.choice(["ok.", f"number {i}.", f"cut {i}"])) for i in range(3000)] + [(8, 0, "user", "a."), (8, 1, "assistant", "b.")]
    rows += [(9, 4, "user", "same.")] * 1500
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert reported(df) == grouped(rows)
    parts = turns.parts(df)
    assert parts.agg(F.max(F.size("turns"))).first()[0] <= 2 * turns.PART + 2
    assert parts.where("NOT whole").count() > 3


def test_repaired_turns_are_a_legal_conversation(spark):
    rows = random_rows(random.Random(2), 20, 10)
    out = defaultdict(list)
    for r in turns.parts(spark.createDataFrame(rows, SCHEMA), most=4).orderBy("at").collect():
        out[r["conv"]] += [x for x in r["turns"] if x["edit"] != "D"]
    assert len(out) <= 20
    for conversation in out.values():
        assert LEGAL.match("".join(x["role"][:1] for x in conversation))


def test_empty_table_other_columns_and_texts_ids(spark):
    assert reported(spark.createDataFrame([], SCHEMA)) == {}
    odd = spark.createDataFrame([("c", 0, "user", "Hi."), ("c", 1, "assistant", "Ho.")], "conv_id string, turn int, role string, text string")
    odd = odd.withColumns({c: F.lit("mine") for c in ("conv", "at", "whole", "draw", "cost", "turns")})
    assert reported(odd)["c"][-3:-1] == (0, "KK")


def test_long_text_is_a_part_of_its_own(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i} " + "x" * 3_000_000 + ".") for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert reported(df) == grouped(rows) and turns.parts(df).count() >= 4


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        left += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    want = dict.fromkeys((r[0] for r in rows), expected([])) | grouped(left)
    got = queries.op11_turns(spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_damage_of_nulls(spark):
    rows = [(None, None, None, None), (1, None, "user", "x."), (None, 3, "user", None)]
    got = queries.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        want += [(conv, turn, "user" if fault == 4 else " " if role is None else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_sql_on_random_conversations(spark, tmp_path):
    rows = random_rows(random.Random(12), 40, 12)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in duck.execute(oracles.TURNS_SQL).fetchall()}
    assert {r[0]: tuple(r)[1:] for r in queries.op11_turns(spark, str(tmp_path)).collect()} == want
