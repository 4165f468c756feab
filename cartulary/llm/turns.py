"""Conversation structure repair: the cheapest edits that make a conversation a system turn at most, then user and assistant in turn.

Roles must read (s?(ua)+)? by their first letters.  A turn is kept (0), given the role user or assistant (2) or deleted (3, and
that is required of a blank or repeated one); an empty turn of either role may stand anywhere (2); a truncated turn that
stays adds 1.  Of equally cheap ways the one whose initials (K, R, D, I) come first in ASCII is taken.

A dynamic program goes through the turns by the states of that pattern: nothing yet, after a system turn, after the user,
after the assistant.  Its steps are macro edits, a run of insertions and what becomes of the next turn, whose codes (D, ID, IID,
... R) are prefix-free and sorted.  So audit strings of one layer compare as (rank of the string before, rank of the code), and a
layer keeps a cost, a rank and a parent for each state, no strings; these are put together once the last layer is known.

Turns are dealt by ranges of (conversation, turn, role, text) and cut into parts of PART turns or PART_BYTES.  A conversation that
one part holds whole, as nearly all do, is repaired there.  Of others each part works out costs and ranks from every
state to every state, which are composed in order, a record a part; then each part knows where it begins and ends and puts
its edits together.  Repeats across parts are found by the least place of each hash of (role, text).

Defined results: a null role or text is one space, so such a turn is blank or has no known role; turns of equal number, or without one (these come
first), are in the order of role and text; a null conversation id is one conversation; roles are told by their first letter as it is, and
an empty role is none; conversations and turns of any length are read whole; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import give_back, join_hot, stored_at

BLANK = " \t\n\x0b\x0c\r"
#: Turns, and characters of text, of a part.
PART, PART_BYTES = 1000, 4_000_000
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: Roles that a turn's state stands for.
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: From a state: (insertions, state after them).  Runs that come back to a state are never cheapest.
RUNS = {START: ((0, START), (1, USER), (2, ASSISTANT)), SYSTEM: ((0, SYSTEM), (1, USER), (2, ASSISTANT)), USER: ((0, USER), (1, ASSISTANT)), ASSISTANT: ((0, ASSISTANT), (1, USER))}
#: Which state a turn may follow, by the state that it leads to.
AFTER = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
LETTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
CODES = sorted("I" * k + x for k in range(3) for x in "DKR")
LEGAL = {"su", "ua", "au"}
#: A repaired conversation's turns; deleted ones are there too, with their edit D.
TURNS = "array<struct<edit:string,role:string,text:string>>"
COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "distinct_turns", "min_turn", "max_turn")
FACTS = ", ".join(f"{c} long" for c in COUNTS) + ", first_initial string, last_initial string"


def _steps(letter: int | None, must_go: bool, cut_off: bool) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, code) of every macro edit that ends with a turn of this kind."""
    out = []
    for before in STATES:
        for k, at in RUNS[before]:
            ends = [(at, DELETE, "D")]
            if not must_go:
                ends += [(letter, 0, "K")] * (letter is not None and at in AFTER[letter])
                ends += [(to, REROLE, "R") for to in (USER, ASSISTANT) if at in AFTER[to]]
            out += [(before, to, INSERT * k + cost + (TRUNCATED if cut_off and x != "D" else 0), CODES.index("I" * k + x)) for to, cost, x in ends]
    return out


STEPS = {(letter, must_go, cut_off): _steps(letter, must_go, cut_off) for letter in (None, SYSTEM, USER, ASSISTANT) for must_go in (False, True) for cut_off in (False, True)}


def layers(kinds: list[tuple], entry: int) -> tuple[dict[int, tuple[int, int]], list[dict[int, tuple[int, int]]]]:
    """From ``entry`` through turns of these kinds: (cost, rank) of each state reached, and each layer's (parent, code)."""
    now, parents = {entry: (0, 0)}, []
    for kind in kinds:
        best: dict[int, tuple] = {}
        for before, to, cost, code in STEPS[kind]:
            if before in now:
                spent, rank = now[before]
                new = (spent + cost, rank, code, before)
                if to not in best or new < best[to]:
                    best[to] = new
        order = sorted(best, key=lambda s: best[s][1:3])
        now = {s: (best[s][0], i) for i, s in enumerate(order)}
        parents.append({s: (b[3], b[2]) for s, b in best.items()})
    return now, parents


LAST = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}


def ending(now: dict[int, tuple[int, int]]) -> tuple[int, int, int]:
    """(cost, state, insertions) of the best way to end after these states: with no turn at all, or with an assistant's."""
    cost, _, k, state = min((spent + INSERT * LAST[s], rank, LAST[s], s) for s, (spent, rank) in now.items())
    return cost, state, k


def codes(parents: list[dict[int, tuple[int, int]]], state: int) -> list[str]:
    """The macro edits of the way to ``state``, from the last layer's parents back to the first's."""
    out = []
    for layer in reversed(parents):
        state, code = layer[state]
        out.append(CODES[code])
    return out[::-1]


def _state(initial: str) -> int | None:
    return LETTER.get(initial)


def kinds_of(rows: list[tuple], repeated: set[int]) -> tuple[list[tuple], dict]:
    """Kinds of turns (turn, role, text), and the facts of a part of them; ``repeated``: places of those seen before."""
    kinds, fact = [], dict.fromkeys(COUNTS, 0) | {"rows": len(rows)}
    for i, (_, role, text) in enumerate(rows):
        bare = text.rstrip(BLANK)
        fault = "blank" if not bare else "duplicate" if i in repeated else "truncated" if bare[-1] not in ".!?" else None
        if fault:
            fact[fault] += 1
        kinds.append((_state(role[:1]), fault in ("blank", "duplicate"), fault == "truncated"))
    initials = [role[:1] for _, role, _ in rows]
    fact["illegal"] = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))
    numbers = {t for t, _, _ in rows if t is not None}
    fact |= {"distinct_turns": len(numbers), "min_turn": min(numbers, default=None), "max_turn": max(numbers, default=None)}
    return kinds, fact | {"first_initial": initials[0], "last_initial": initials[-1]}


def repaired(rows: list[tuple], edits: list[str], entry: int, tail: int) -> list[dict]:
    """The turns that macro edits make of these, from the state ``entry`` on, deleted ones included; tail: insertions after them."""
    out, state = [], entry

    def insert(k: int) -> None:
        nonlocal state
        for _ in range(k):
            state = ASSISTANT if state == USER else USER
            out.append({"edit": "I", "role": ROLE[state], "text": ""})

    for (_, role, text), code in zip(rows, edits, strict=True):
        insert(len(code) - 1)
        if code[-1] == "R":
            state = ASSISTANT if state == USER else USER
            role = ROLE[state]
        elif code[-1] == "K":
            state = _state(role[:1])
        out.append({"edit": code[-1], "role": role, "text": text})
    insert(tail)
    return out


def _local_repeats(rows: list[tuple]) -> set[int]:
    seen, out = set(), set()
    for i, (_, role, text) in enumerate(rows):
        key = (role, text)
        if key in seen:
            out.add(i)
        seen.add(key)
    return out


FACT_TYPES = [*((c, pa.int64()) for c in COUNTS), ("first_initial", pa.string()), ("last_initial", pa.string())]
TURN_TYPE = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
ROW_TYPE = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
ROWS = "array<struct<turn:bigint,role:string,text:string>>"


def _batch(rows: list[dict], conv: pa.DataType, *fields: tuple[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv", conv), *fields]))


def _tuples(rows: list[dict]) -> list[tuple]:
    return [(r["turn"], r["role"], r["text"]) for r in rows]


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Turns in order, with their place ``at``, to parts; a part that begins and ends within this stream's conversations is repaired."""
    rows: list[tuple] = []
    conv, at, size, began, kind, empty = None, None, 0, False, None, True

    def part(ends: bool) -> pa.RecordBatch:
        one = {"conv": conv, "at": at, "whole": began and ends, "cost": 0}
        if one["whole"]:
            kinds, fact = kinds_of(rows, _local_repeats(rows))
            now, parents = layers(kinds, START)
            cost, state, tail = ending(now)
            one |= fact | {"cost": cost, "turns": repaired(rows, codes(parents, state), START, tail)}
        else:
            one["source"] = [dict(zip(("turn", "role", "text"), r, strict=True)) for r in rows]
        return _batch([one], kind, ("at", pa.int64()), ("whole", pa.bool_()), ("source", ROW_TYPE), *FACT_TYPES, ("cost", pa.int64()), ("turns", TURN_TYPE))

    for batch in batches:
        kind = batch.schema.field(0).type
        for new_conv, new_at, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            other = not empty and new_conv != conv
            if rows and (other or len(rows) >= most or size + len(text) > PART_BYTES):
                yield part(other)
                rows, size, began = [], 0, other
            if not rows:
                at = new_at
            conv, empty = new_conv, False
            rows.append((turn, role, text))
            size += len(text)
    if rows:
        yield part(False)
    give_back()


def packed(df: DataFrame, conv: str, turn: str, role: str, text: str, most: int = PART) -> DataFrame:
    """(conv, at, whole, source, facts, cost, turns): one row a part, in the order of ``at``."""
    plain = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    # bounds of ranges are sampled rows, so they hold no whole text; equal turns of one conversation fall apart by the draw
    keyed = plain.withColumns({"head": F.substring("text", 1, 64), "mark": F.md5("text"), "draw": F.rand(42)})
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "head", "mark", "draw"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", F.monotonically_increasing_id().alias("at"), "turn", "role", "text")
    kind = plain.schema["conv"].dataType.simpleString()
    return stored_at(ranged.mapInArrow(lambda batches: _pack(batches, most), f"conv {kind}, at long, whole boolean, source {ROWS}, {FACTS}, cost long, turns {TURNS}"))[0]


def _with_repeats(opened: DataFrame) -> DataFrame:
    """Parts of divided conversations with the places of turns that an earlier part, or this one, has already."""
    turns = opened.select("conv", "at", F.posexplode("source").alias("i", "x")).where(F.length(F.btrim("x.text", F.lit(BLANK))) > 0)
    keys = [F.xxhash64("conv", "x.role", "x.text").alias("h1"), F.xxhash64(F.lit(1), "conv", "x.role", "x.text").alias("h2")]
    hashed, _ = stored_at(turns.select("at", "i", *keys))
    first = hashed.groupBy("h1", "h2").agg(F.min(F.struct("at", "i")).alias("first"), F.count("*").alias("many")).where(F.col("many") > 1)
    late = join_hot(hashed, first, ["h1", "h2"], hashed.count()).where(F.struct("at", "i") > F.col("first"))
    return stored_at(opened.join(late.groupBy("at").agg(F.collect_set("i").alias("repeats")), "at", "left").select("conv", "at", "source", "repeats"))[0]


TABLE = [("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))]


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of each part, and cost and rank from every state to every state; -1 where none leads."""
    for batch in batches:
        kind = batch.schema.field("conv").type
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            kinds, fact = kinds_of(_tuples(row["source"]), set(row["repeats"] or ()))
            each = [layers(kinds, entry)[0] for entry in STATES]
            costs, ranks = ([now[s][k] if s in now else -1 for now in each for s in STATES] for k in (0, 1))
            yield _batch([{"conv": row["conv"], "at": row["at"], **fact, "costs": costs, "ranks": ranks}], kind, ("at", pa.int64()), *FACT_TYPES, *TABLE)
    give_back()


ROUTE = [("at", pa.int64()), ("entry", pa.int64()), ("leave", pa.int64()), ("tail", pa.int64()), ("cost", pa.int64()), *FACT_TYPES]


def _merged(a: dict | None, b: dict) -> dict:
    """Facts of two neighbouring stretches as one."""
    if a is None:
        return {c: b[c] for c, _ in FACT_TYPES}
    out = {c: a[c] + b[c] for c in COUNTS if c not in ("min_turn", "max_turn")}
    out["illegal"] += a["last_initial"] + b["first_initial"] not in LEGAL
    # turns come in order, so only the ones that meet can be equal
    out["distinct_turns"] -= a["max_turn"] is not None and a["max_turn"] == b["min_turn"]
    known = [x for x in (a["min_turn"], b["min_turn"]) if x is not None]
    last = [x for x in (a["max_turn"], b["max_turn"]) if x is not None]
    return out | {"min_turn": min(known, default=None), "max_turn": max(last, default=None), "first_initial": a["first_initial"], "last_initial": b["last_initial"]}


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts' tables, in order, to the state in which each begins and ends; facts and cost of all stand with the last one."""
    conv, kind, fact = None, None, None
    now: dict[int, tuple[int, int]] = {}
    ats: list[int] = []
    parents: list[bytes] = []

    def routes() -> Iterator[pa.RecordBatch]:
        cost, state, tail = ending(now)
        leaves = [state]
        for p in reversed(parents):
            leaves.append(p[leaves[-1]])
        way = leaves[::-1]
        for start in range(0, len(ats), 10_000):
            some = range(start, min(start + 10_000, len(ats)))
            last = len(ats) - 1
            yield _batch([{"conv": conv, "at": ats[i], "entry": way[i], "leave": way[i + 1], "tail": tail if i == last else 0, "cost": cost if i == last else None} | (fact if i == last else {}) for i in some], kind, *ROUTE)

    for batch in batches:
        kind = batch.schema.field("conv").type
        for row in batch.to_pylist():
            if ats and row["conv"] != conv:
                yield from routes()
                ats, parents, fact = [], [], None
            if not ats:
                conv, now = row["conv"], {START: (0, 0)}
            best: dict[int, tuple] = {}
            for before, (spent, rank) in now.items():
                for to in STATES:
                    cost = row["costs"][4 * before + to]
                    if cost >= 0:
                        new = (spent + cost, rank, row["ranks"][4 * before + to], before)
                        if to not in best or new < best[to]:
                            best[to] = new
            order = sorted(best, key=lambda s: best[s][1:3])
            now = {s: (best[s][0], i) for i, s in enumerate(order)}
            parents.append(bytes(best[s][3] if s in best else 0 for s in STATES))
            ats.append(row["at"])
            fact = _merged(fact, row)
    if ats:
        yield from routes()


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts with their states to their repaired turns."""
    for batch in batches:
        kind = batch.schema.field("conv").type
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            rows = _tuples(row["source"])
            kinds, _ = kinds_of(rows, set(row["repeats"] or ()))
            _, parents = layers(kinds, row["entry"])
            turns = repaired(rows, codes(parents, row["leave"]), row["entry"], row["tail"])
            yield _batch([{c: row[c] for c in ("conv", "at", "cost", *(c for c, _ in FACT_TYPES))} | {"turns": turns}], kind, ("at", pa.int64()), *FACT_TYPES, ("cost", pa.int64()), ("turns", TURN_TYPE))
    give_back()


def _divided(opened: DataFrame) -> DataFrame:
    """(conv, at, facts, cost, turns) of the parts of divided conversations; facts and cost stand with a conversation's last part."""
    kind = opened.schema["conv"].dataType.simpleString()
    opened = _with_repeats(opened)
    tables = opened.mapInArrow(_sum_up, f"conv {kind}, at long, {FACTS}, costs array<long>, ranks array<long>")
    # a record a part: of 10^9 turns 10^6 records, read as a stream
    routes = tables.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "at").mapInArrow(_compose, f"conv {kind}, at long, entry long, leave long, tail long, cost long, {FACTS}")
    met = opened.join(routes.drop("conv"), "at")
    return stored_at(met.mapInArrow(_put_together, f"conv {kind}, at long, {FACTS}, cost long, turns {TURNS}"))[0]


def text_of(turns: str = "turns") -> F.Column:
    """Repaired turns as role:text, joined by newlines; null where none is left."""
    left = F.filter(turns, lambda x: x["edit"] != "D")
    return F.when(F.size(left) > 0, F.array_join(F.transform(left, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n"))


def audit_of(turns: str = "turns") -> F.Column:
    return F.array_join(F.transform(turns, lambda x: x["edit"]), "")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and audits of parts in order to one row a conversation; only the running hash is kept of the texts."""
    conv, kind, audits, some, began = None, None, [], False, False
    running = hashlib.sha256()
    row = lambda: _batch([{"conv": conv, "audit": "".join(audits), "sha256": running.hexdigest()}], kind, ("audit", pa.string()), ("sha256", pa.string()))
    for batch in batches:
        kind = batch.schema.field("conv").type
        for new, audit, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "text")), strict=True):
            if began and new != conv:
                yield row()
                running, audits, some = hashlib.sha256(), [], False
            conv, began = new, True
            audits.append(audit)
            if text is not None:
                running.update((b"\n" if some else b"") + text.encode())
                some = True
    if began:
        yield row()
    give_back()


def parts(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = PART) -> DataFrame:
    """(conv, at, whole, facts, cost, turns): the repaired turns of each part, in the order of ``at``; a conversation's facts and cost stand with its last part."""
    cut = packed(df, conv, turn, role, text, most)
    columns = ["conv", "at", *(c for c, _ in FACT_TYPES), "cost", "turns"]
    done = cut.where("whole").select(*columns).withColumn("whole", F.lit(True))
    return done.unionByName(_divided(cut.where("NOT whole")).select(*columns).withColumn("whole", F.lit(False)))


def report(repaired_parts: DataFrame) -> DataFrame:
    """One row a conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    The hash of a divided conversation is one stream over its parts in order, as SHA-256 is sequential.
    """
    gaps = F.coalesce(F.expr("max_turn - min_turn + 1 - distinct_turns"), F.lit(0)).cast("long").alias("gaps")
    facts = [gaps, "blank", "duplicate", "truncated", "illegal", "cost"]
    one = repaired_parts.where("whole").select("conv", *facts, audit_of().alias("audit"), F.sha2(F.coalesce(text_of(), F.lit("")), 256).alias("repaired_sha256"))
    several = repaired_parts.where("NOT whole")
    kind = several.schema["conv"].dataType.simpleString()
    texts = several.select("conv", "at", audit_of().alias("audit"), text_of().alias("text"))
    hashed = texts.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "at").mapInArrow(_digests, f"conv {kind}, audit string, sha256 string")
    last = several.where("cost IS NOT NULL").select(F.col("conv").alias("_conv"), *facts)
    rest = last.join(hashed, F.col("_conv").eqNullSafe(F.col("conv"))).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"))
    return one.unionByName(rest)
