"""Personal data: base patterns, and spans that a linear-chain conditional random field adds.

The base patterns find plain e-mail addresses, IP addresses, card and phone numbers.  The field reads word shapes around
every word that holds a digit or a sign of an address, is trained by gradient ascent on the small labelled table below,
and is decoded by Viterbi over numpy batches; spans that it finds are kept where they pass the same kind of check as the
base ones and overlap none of them.  Words of letters alone, away from any such sign, can hold no kind and are not scored.

Defined results: a null text is the empty text and has no spans; repeated rows give equal results; offsets count code
points whatever the length of the text; extra columns pass through, output columns replace input columns of the same
name; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.byte_bpe import _schema, _with
from cartulary.llm.common import per_slice

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
N = len(LABELS)
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# as given, with a look-behind or possessive loops that leave the matches alone but keep long runs of digits linear
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]|[\[({](?:at|AT)[\])}]")
SIGNED = re.compile(r"\S*(?:[0-9@]|[\[({](?:at|AT)[\])}])\S*")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
#: Words beside a sign that are scored with it.
AROUND = 3

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def is_card(s: str) -> bool:
    return 12 <= len(d := _digits(s)) <= 19 and luhn(d)


def is_ip(s: str) -> bool:
    parts = s.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping matches of each kind; a match that fails its check is dropped and not tried again."""
    spans: list[Span] = []
    if not SIGN.search(text):
        return spans
    done = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            spans.append((start, 0, done))
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if is_ip(m[0])]
    spans += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if is_card(m[0])]
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(spans)


# ---- the field -------------------------------------------------------------------------------------------------------

#: Labelled rows: {kind|text}; each # stands for some digit, so that one row gives several training sequences.
LABELLED = """
call {phone|(###) ###-####} today for more
call me at {phone|###-###-####} or write
her number is {phone|###.###.####} she said
tel: {phone|0## #### ####} fax none
phone {phone|+## ### ### ####} please
reach us on {phone|+# (###) ###-####} any day
mobile {phone|0####-######} or office
telephone {phone|(0##) ### ## ##} in the morning
dial {phone|1-800-###-####} now
fax {phone|###-###-####}
the office ({phone|###-###-####}) is open
{phone|###-###-####} {phone|###-###-####} are both ours
or on {phone|+##########}.
her line {phone|(###)###-####}, his line {phone|(###)###-####}
card {card|#### #### #### ####} expires soon
card {card|################} was charged
paid with {card|####-####-####-####} last week
cards {card|################} {card|################} on file
visa {card|#### #### #### ####} {card|#### #### #### ####} both
number {card|#### ###### #####} amex
charged {card|###############}, then refunded
the card {card|################}.
and {card|################} and {card|################} then
server {ip|##.##.##.##} is down
from {ip|###.##.#.###} to {ip|##.#.#.#} by night
address {ip|###.###.#.#}:8080 answered
ping {ip|##.###.##.#}, please
host [{ip|1##.1##.##.1##}] replied
blocked {ip|##[.]##[.]##[.]##} at the gate
from {ip|##[.]#[.]#[.]#} and {ip|###[.]##[.]#[.]###} by night
{ip|1##[.]1##[.]##[.]#} was blocked
host {ip|##(.)##(.)#(.)##} replied
write to {email|ann.lee@mail.example.com} soon
mail {email|info##@site.org} or call
contact {email|bob (at) example.com} for it
{email|ann.lee (at) example.org} wrote
mail {email|kim## [at] example [dot] net}, then call
contact {email|jane [at] mail.example.org} for it
reach {email|joe_x [at] example [dot] com} today
reach {email|sue (at) post (dot) org} today
email: {email|first.last+tag@sub.domain.co}
<{email|a-b@c-d.net}> wrote
or {email|tim {at} example.org} instead
in #### there were ## of them
on ####-##-## at ##:## we met
version #.##.# was released in ####
page ## of ###, line ####
costs $###.## or ##,###.## in all
id ########## was closed
order ###### shipped on ##/##/####
section #.#.# and table #.#
about ### ### people and #,###,### more
between #### and #### it grew ##.#%
hash b#c###e###b#f###### of the block
key a##b##c##d##e##f in hex
token ##BC###E#### was found
the digest ##A#F###C##E## of it
secret AKIA##QX##ZT##LM##PR leaked
password pw######## and ##hunter##
serial AB-######-CD-#### here
word ################ and more
parts ###-####-### and ####-####-#### in stock
account ########## balance ####
license ##########-#### granted
room ### floor ## tower #
the ## and the ## of ####
isbn ###-#-##-######-# in print
sum ################### is large
serial ########-####-####-####-############ here
ratio #.## against #.###
meet @ noon with @someone there
see (at) last and [at] once
temperature -##.# to +##.# degrees
score ##-## after ## minutes
chapter # verse ##
number ######## in the list
call number ### is next
the card has ## points
ip has ## letters
mail ## letters at once
phone book of ####
""".strip().split("\n")
SEED, COPIES, STEPS, RATE, PENALTY = 7, 4, 100, 0.15, 0.02
CUES = frozenset("call tel telephone phone mobile fax dial card cards visa amex paid ip host server ping address mail email contact write reach at dot isbn".split())


def _shape(token: str) -> str:
    c = token[0]
    if "0" <= c <= "9":
        n = len(token)
        return f"9{n if n <= 4 else '5' if n < 8 else '8' if n < 12 else 'c' if n <= 19 else 'l'}"
    if c.isalpha():
        low = token.lower()
        if low in CUES:
            return f"={low}"
        return "x" if token == low else "X" if token == token.upper() else "Xx"
    return c if ord(c) < 128 else "?"


def _tokens(text: str, start: int, end: int) -> tuple[list[int], list[int], list[str]]:
    starts, ends, shapes, last = [], [], [], start
    for m in TOKEN.finditer(text, start, end):
        s, e = m.span()
        starts.append(s)
        ends.append(e)
        shapes.append(("_" if s > last else "") + _shape(m[0]))
        last = e
    return starts, ends, shapes


def _features(shapes: list[str]) -> list[list[str]]:
    p = ["<", "<", *shapes, ">", ">"]
    return [[f"0{p[i]}", f"a{p[i - 1]}", f"b{p[i + 1]}", f"c{p[i - 2]}", f"d{p[i + 2]}", f"e{p[i - 1]} {p[i]}", f"f{p[i]} {p[i + 1]}", f"g{p[i - 1]} {p[i + 1]}"] for i in range(2, len(p) - 2)]


WIDTH = 8


def training_rows() -> list[tuple[str, list[Span]]]:
    """The labelled table with digits in place of #: text and spans."""
    rng, rows = np.random.default_rng(SEED), []
    for line in LABELLED:
        for _ in range(COPIES):
            text, spans, kind, at, rest = "", [], None, 0, line
            while rest:
                if kind is None and (m := re.match(r"\{(email|ip|card|phone)\|", rest)):
                    kind, at, rest = KINDS.index(m[1]), len(text), rest[m.end() :]
                elif kind is not None and rest[0] == "}" and text[-3:] not in ("{at",):
                    spans.append((at, kind, len(text)))
                    kind, rest = None, rest[1:]
                else:
                    text += str(rng.integers(1, 10)) if rest[0] == "#" else rest[0]
                    rest = rest[1:]
            rows.append((text, spans))
    return rows


class Field:
    """Weights of the features (a row for each label) and of the steps from label to label."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.index, self.emit, self.step = index, emit, step

    def scores(self, shapes: list[list[str]]) -> np.ndarray:
        """Emission scores of all tokens of some sequences, one after the other."""
        get = self.index.get
        ids = np.array([[get(f, 0) for f in token] for s in shapes for token in _features(s)], dtype=np.int64).reshape(-1, WIDTH)
        return self.emit[ids].sum(axis=1)

    def decode(self, emissions: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The best labels of each sequence: Viterbi over all sequences at once, the longest first."""
        order = np.argsort(-lengths, kind="stable")
        first = np.concatenate(([0], np.cumsum(lengths)))[:-1][order]
        long = lengths[order]
        score, back = emissions[first] + START, []
        for t in range(1, int(long[0]) if len(long) else 0):
            live = int(np.searchsorted(-long, -t, side="left"))
            paths = score[:live, :, None] + self.step + LEGAL
            back.append(paths.argmax(axis=1))
            score[:live] = paths.max(axis=1) + emissions[first[:live] + t]
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(lengths)
        best = score.argmax(axis=1)
        for k, where in enumerate(order):
            labels = np.empty(long[k], dtype=np.int64)
            labels[-1] = best[k]
            for t in range(int(long[k]) - 2, -1, -1):
                labels[t] = back[t][k, labels[t + 1]]
            out[where] = labels
        return out


START = np.array([-1e9 if x[0] == "I" else 0.0 for x in LABELS])
LEGAL = np.array([[-1e9 if b[0] == "I" and a[2:] != b[2:] else 0.0 for b in LABELS] for a in LABELS])


def sums(e: np.ndarray, s: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward sums over padded sequences: log of each one's total, each place's chances, all steps' expected counts.

    e: scores of labels at each place; s: of steps from label to label; mask: 1 where a sequence goes on.
    """
    n, m, _ = e.shape
    fwd, bwd = np.empty((n, m, N)), np.zeros((n, m, N))
    fwd[:, 0] = e[:, 0] + START
    for t in range(1, m):
        z = fwd[:, t - 1, :, None] + s
        top = z.max(axis=1)
        new = top + np.log(np.exp(z - top[:, None]).sum(axis=1)) + e[:, t]
        fwd[:, t] = np.where(mask[:, t, None] > 0, new, fwd[:, t - 1])
    for t in range(m - 2, -1, -1):
        z = s + (e[:, t + 1] + bwd[:, t + 1])[:, None, :]
        top = z.max(axis=2)
        new = top + np.log(np.exp(z - top[..., None]).sum(axis=2))
        bwd[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
    top = fwd[:, -1].max(axis=1)
    logz = top + np.log(np.exp(fwd[:, -1] - top[:, None]).sum(axis=1))
    p = np.exp(fwd + bwd - logz[:, None, None]) * mask[..., None]
    both = fwd[:, :-1, :, None] + s + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - logz[:, None, None, None]
    return logz, p, (np.exp(np.minimum(both, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))


@lru_cache(maxsize=1)
def field() -> Field:
    """Train on the labelled table: gradient ascent on the penalised log-likelihood, by forward and backward sums."""
    rows, index, seqs = training_rows(), {"": 0}, []
    for text, spans in rows:
        starts, _, shapes = _tokens(text, 0, len(text))
        labels = np.zeros(len(starts), dtype=np.int64)
        for s, kind, e in spans:
            inside = [i for i, p in enumerate(starts) if s <= p < e]
            labels[inside] = 2 + 2 * kind
            labels[inside[0]] = 1 + 2 * kind
        seqs.append(([[index.setdefault(f, len(index)) for f in token] for token in _features(shapes)], labels))
    n, m = len(seqs), max(len(x[1]) for x in seqs)
    ids, gold, mask = np.zeros((n, m, WIDTH), dtype=np.int64), np.zeros((n, m), dtype=np.int64), np.zeros((n, m))
    for i, (x, y) in enumerate(seqs):
        ids[i, : len(y)], gold[i, : len(y)], mask[i, : len(y)] = x, y, 1
    emit, step = np.zeros((len(index), N)), np.zeros((N, N))
    moment = [[np.zeros_like(w), np.zeros_like(w)] for w in (emit, step)]
    one = np.eye(N)[gold] * mask[..., None]
    pairs = np.einsum("ntj,ntk->jk", one[:, :-1], one[:, 1:])
    flat = ids.reshape(-1, WIDTH)
    for r in range(1, STEPS + 1):
        _, p, q = sums(emit[ids].sum(axis=2), step + LEGAL, mask)
        delta, grad = (one - p).reshape(-1, N), np.zeros_like(emit)
        for k in range(WIDTH):
            np.add.at(grad, flat[:, k], delta)
        for w, g, (a, b) in zip((emit, step), (grad - PENALTY * emit, pairs - q - PENALTY * step), moment, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w += RATE * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.999**r)) + 1e-8)
        emit[0] = 0
    return Field(index, emit, step)


def _clusters(text: str) -> list[tuple[int, int]]:
    """Stretches of words around signs, AROUND words to each side; they join where they meet."""
    out: list[tuple[int, int]] = []
    for m in SIGNED.finditer(text):
        s, e = m.span()
        for _ in range(AROUND):
            p = s
            while p > 0 and text[p - 1].isspace():
                p -= 1
            while p > 0 and not text[p - 1].isspace():
                p -= 1
            s = p
            p = e
            while p < len(text) and text[p].isspace():
                p += 1
            while p < len(text) and not text[p].isspace():
                p += 1
            e = p
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


#: What an added span of each kind may consist of, from its first character to its last.
WHOLE = (
    re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|[\[({](?:at|AT)[\])}])\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[({](?:dot|DOT|\.)[\])}])\s?[A-Za-z0-9-]+)*\s?(?:\.|[\[({](?:dot|DOT|\.)[\])}])\s?[A-Za-z]+"),
    re.compile(r"[0-9]+(?:[\[(]?\.[\])]?[0-9]+){3}"),
    re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    re.compile(r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])+"),
)
#: The characters that such a span may begin and end with; others at its ends are cut off.
FIRST = (LOCAL, frozenset("0123456789"), frozenset("0123456789"), frozenset("0123456789+("))


def trimmed(kind: int, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The part of a decoded span that is its kind and nothing else, or None.

    Letters can be no part of a number, and a number that is part of a longer word or key is none.
    """
    last = LOCAL - set("._%+-") if kind == 0 else FIRST[1]
    while start < end and text[start] not in FIRST[kind]:
        start += 1
    while end > start and text[end - 1] not in last:
        end -= 1
    held = text[start:end]
    if not WHOLE[kind].fullmatch(held) or (start and (text[start - 1].isalnum() or text[start - 1] == "_")) or (end < len(text) and (text[end].isalnum() or text[end] == "_")):
        return None
    good = is_ip(re.sub(r"[\[\]()]", "", held)) if kind == 1 else is_card(held) if kind == 2 else 9 <= len(_digits(held)) <= 15 if kind == 3 else True
    return (start, end) if good else None


def all_spans(texts: list[str], trained: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    found, work, shapes = [], [], []
    for i, text in enumerate(texts):
        found.append((base_spans(text), []))
        if SIGN.search(text):
            for s, e in _clusters(text):
                starts, ends, shape = _tokens(text, s, e)
                if starts:
                    work.append((i, starts, ends))
                    shapes.append(shape)
    if work:
        lengths = np.array([len(s) for s in shapes], dtype=np.int64)
        for (i, starts, ends), labels in zip(work, trained.decode(trained.scores(shapes), lengths), strict=True):
            base, added = found[i]
            begin = np.flatnonzero(labels % 2 == 1)
            for b in begin.tolist():
                kind = (int(labels[b]) - 1) // 2
                last = b
                while last + 1 < len(labels) and labels[last + 1] == 2 + 2 * kind:
                    last += 1
                cut = trimmed(kind, texts[i], starts[b], ends[last])
                if cut and not any(cut[0] < y and x < cut[1] for x, _, y in base):
                    added.append((cut[0], kind, cut[1]))
    return found


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``added_spans``: arrays of (kind, start, end) by start, then kind."""
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    trained = field()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(batch.schema.names.index(text)).to_pylist()]
        rows = all_spans(texts, trained)
        show = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(spans)]
        return _with(batch, {n: pa.array([show(r[j]) for r in rows], kind) for j, n in enumerate(("base_spans", "added_spans"))})

    return df.mapInArrow(per_slice(run, df.columns.index(text)), _schema(df, [("base_spans", span), ("added_spans", span)]))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Put <KIND> in place of every span of ``text``; overlapping spans become one, named after the first.  Null stays null."""
    trained = field()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.names.index(text)).to_pylist()
        out = []
        for t, (base, added) in zip(texts, all_spans([x or "" for x in texts], trained), strict=True):
            spans, parts, at = sorted(base + added), [], 0
            for s, k, e in spans:
                if s >= at:
                    parts += [t[at:s], f"<{KINDS[k].upper()}>"]
                at = max(at, e)
            out.append(t if not spans else "".join(parts) + t[at:])
        place = batch.schema.names.index(text)
        return batch.set_column(place, text, pa.array(out, pa.string()))

    return df.mapInArrow(per_slice(run, df.columns.index(text)), df.schema)


def joined(spans) -> F.Column:
    """kind:start:end of an array of spans by start, then kind in the order of KINDS, comma-joined."""
    rank = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), F.array_position(rank, x["kind"]).alias("r"), x["end"].alias("e"), x["kind"].alias("k"))))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")
