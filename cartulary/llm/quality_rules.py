"""Quality rules by weak supervision, in DataFrame and SQL functions only.

Each rule votes good or bad on a document, or abstains.  Documents with the same votes are counted, which leaves at most
3 ** rules patterns however large the corpus is; expectation-maximisation over the counted patterns estimates each rule's
accuracy on good and on bad documents and the share of good documents, and a document is kept where its posterior probability of being good is at
least a half, unless it fails one of the two base rules.

Defined results: a null or empty text has no words, fails the base rules and is not kept; repeated rows are judged each
on its own; documents of any length are read whole; an empty table gives an empty table; output columns replace input
columns of the same name, and the text itself is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import cut, fresh

SPACE = r"\\x20\\x09-\\x0D"
SYMBOLS = "[#*$%&|<>]"
#: name -> (good if, bad if); neither: the rule abstains.  Both Spark and DuckDB read these.
RULES = {
    "word_length": ("word_chars >= 3 * n_words AND word_chars <= 10 * n_words AND n_words > 0", "word_chars < 2 * n_words OR word_chars > 14 * n_words OR n_words = 0"),
    "symbols": ("50 * n_symbols <= n_words AND n_words > 0", "10 * n_symbols > n_words"),
    "symbol_runs": ("100 * n_run_symbols <= n_words AND n_words > 0", "10 * n_run_symbols > n_words"),
    "letters": ("100 * n_letters >= 85 * word_chars AND n_words > 0", "100 * n_letters < 75 * word_chars OR n_words = 0"),
    "repeated_lines": ("n_dup_lines = 0 AND n_lines >= 3", "10 * n_dup_lines > 3 * n_lines"),
    "repeated_words": ("20 * n_repeat_words <= n_words AND n_words > 0", "10 * n_repeat_words > 3 * n_words"),
    "capitals": ("20 * n_upper >= n_words AND 100 * n_upper <= 15 * word_chars", "10 * n_upper > 4 * word_chars"),
    "sentence_ends": ("2 * n_ended >= n_lines AND n_lines > 0", "10 * n_ended < n_lines"),
}
ROUNDS = 25
#: Where the estimates start: accuracy of a vote on good and on bad documents, share of good documents.
START_ON_GOOD, START_ON_BAD, START_GOOD = 0.9, 0.5, 0.8
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_ended", "n_letters", "n_run_symbols")


def let(name: str, value: str, body: str) -> str:
    """SQL in which ``name`` stands for ``value``, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words(w: str) -> str:
    """Words covered by three-word windows that occur twice or more in the array ``w``.

    Windows sort by 40 bits of their hash and their place, packed in one long; neighbours of equal hash are compared
    word by word.  Where two unlike windows share those bits, or the text has 2 ** 24 words, the windows sort whole.
    """
    same = f"{w}[a] = {w}[b] AND {w}[a + 1] = {w}[b + 1] AND {w}[a + 2] = {w}[b + 2]"
    place = "CAST({} & 16777215L AS INT)"
    equal = let("a", place.format("x"), let("b", place.format("y"), same))
    near = lambda x, y: f"(shiftrightunsigned({x}, 24) = shiftrightunsigned({y}, 24))"
    like = lambda x, y: f"({near(x, y)} AND {equal.replace('(x &', f'({x} &').replace('(y &', f'({y} &')})"
    last = "size(s) - 1"
    spots = f"filter(transform(s, (v, k) -> CASE WHEN (k > 0 AND {near('v', 's[k - 1]')}) OR (k < {last} AND {near('v', 's[k + 1]')}) THEN CAST(v & 16777215L AS INT) ELSE -1 END), q -> q >= 0)"
    clash = f"exists(s2, k -> NOT {like('s[k - 1]', 's[k]')})"
    s2 = f"filter(sequence(1, {last}), k -> {near('s[k - 1]', 's[k]')})"
    packed = f"sort_array(transform(sequence(0, size({w}) - 3), i -> shiftleft(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]), 24) | CAST(i AS BIGINT)))"
    whole = f"sort_array(transform(sequence(0, size({w}) - 3), i -> struct(concat_ws(' ', {w}[i], {w}[i + 1], {w}[i + 2]) AS g, i AS i)))"
    whole_spots = "filter(transform(z, (v, k) -> CASE WHEN (k > 0 AND v.g = z[k - 1].g) OR (k < size(z) - 1 AND v.g = z[k + 1].g) THEN v.i ELSE -1 END), q -> q >= 0)"
    exact = let("z", whole, whole_spots)
    # only texts with a repeated window are looked at more closely
    fast = let("s", packed, let("d", spots, f"CASE WHEN size(d) = 0 THEN d WHEN {let('s2', s2, clash)} THEN {exact} ELSE d END"))
    covered = "aggregate(sort_array(f), named_struct('e', 0, 'n', 0L), (acc, p) -> named_struct('e', p + 3, 'n', acc.n + CAST(p + 3 - greatest(p, acc.e) AS BIGINT)), acc -> acc.n)"
    return f"CASE WHEN size({w}) < 4 THEN 0L ELSE {let('f', f'CASE WHEN size({w}) >= 16777216 THEN {exact} ELSE {fast} END', covered)} END"


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by the counts that rules read, all of them longs."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text and c not in FEATURES]
    t, words, lines = fresh(df, "t", "words", "lines")
    body = let(
        "w",
        f"array_remove(split({t}, '[{SPACE}]+'), '')",
        "named_struct('n_words', CAST(size(w) AS BIGINT), 'word_chars', CAST(length(array_join(w, '')) AS BIGINT), 'n_repeat_words', " + _repeat_words("w") + ")",
    )
    by_line = let(
        "l",
        f"filter(split({t}, '\\n'), x -> x RLIKE '[^{SPACE}]')",
        f"named_struct('n_lines', CAST(size(l) AS BIGINT), 'n_dup_lines', CAST(size(l) - size(array_distinct(l)) AS BIGINT), 'n_ended', CAST(size(filter(l, x -> x RLIKE '[.!?][{SPACE}]*$')) AS BIGINT))",
    )
    without = lambda pattern: f"CAST(length({t}) - length(regexp_replace({t}, '{pattern}', '')) AS BIGINT)"
    patterns = {"n_symbols": f"{SYMBOLS}+", "n_upper": r"\\p{Lu}+", "n_letters": r"\\p{L}+", "n_run_symbols": f"{SYMBOLS}{{2,}}"}
    counted = fresh(df, *patterns)
    made = df.select(*rest, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(t)).select(*rest, F.expr(body).alias(words), F.expr(by_line).alias(lines), *[F.expr(without(x)).alias(n) for n, x in zip(counted, patterns.values(), strict=True)])
    places = dict(zip(patterns, counted, strict=True)) | {c: f"{words}.{c}" for c in ("n_words", "word_chars", "n_repeat_words")} | {c: f"{lines}.{c}" for c in ("n_lines", "n_dup_lines", "n_ended")}
    return made.select(*rest, *[F.col(places[c]).alias(c) for c in FEATURES])


def votes() -> list[str]:
    """SQL of each rule's vote: 1 good, -1 bad, 0 abstained."""
    return [f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for good, bad in RULES.values()]


def posteriors(patterns: DataFrame) -> DataFrame:
    """(votes array, n) of every pattern -> (votes, posterior), by expectation-maximisation in one row of SQL.

    At most 3 ** rules rows come together here, whatever the number of documents.
    """
    k = len(RULES)
    start = f"named_struct('good', CAST({START_GOOD} AS DOUBLE), 'on_good', array_repeat(CAST({START_ON_GOOD} AS DOUBLE), {k}), 'on_bad', array_repeat(CAST({START_ON_BAD} AS DOUBLE), {k}))"
    said = "CASE WHEN p.v[j] = 1 THEN ln(m.on_good[j]) - ln(1 - m.on_bad[j]) WHEN p.v[j] = -1 THEN ln(1 - m.on_good[j]) - ln(m.on_bad[j]) ELSE CAST(0 AS DOUBLE) END"
    posterior = f"1 / (1 + exp(-aggregate(sequence(0, {k - 1}), ln(m.good) - ln(1 - m.good), (a, j) -> a + {said})))"
    judged = f"transform(ps, p -> named_struct('v', p.v, 'n', p.n, 'g', {posterior}))"
    bound = "greatest(CAST(0.02 AS DOUBLE), least(CAST(0.98 AS DOUBLE), {}))"
    total = lambda what: f"aggregate(e, CAST(0 AS DOUBLE), (a, p) -> a + p.n * ({what}))"
    weigh = lambda vote, g: "({} + 4) / ({} + 5)".format(total(f"CASE WHEN p.v[j] = {vote} THEN {g} ELSE 0 END"), total(f"CASE WHEN p.v[j] = 0 THEN 0 ELSE {g} END"))
    each = lambda vote, g: f"transform(sequence(0, {k - 1}), j -> {bound.format(weigh(vote, g))})"
    share = bound.format(f"({total('p.g')} + 1) / ({total('1')} + 2)")
    step = let("e", judged, f"named_struct('good', {share}, 'on_good', {each(1, 'p.g')}, 'on_bad', {each(-1, '(1 - p.g)')})")
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("ps"))
    fitted = one.select("ps", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (m, r) -> {step})").alias("m"))
    return fitted.select("m", F.explode("ps").alias("p")).select(F.col("p.v").alias("_votes"), F.expr(posterior).alias("posterior"))


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts, base verdict, posterior probability of quality and ``kept`` of every document."""
    df = df.drop("base_failed", "posterior", "kept")
    (said,) = fresh(df, "votes")
    counted = cut(features(df, text)).withColumn(said, F.array(*[F.expr(v) for v in votes()]))
    fitted = posteriors(counted.groupBy(F.col(said).alias("v")).agg(F.count("*").alias("n"))).withColumnRenamed("_votes", said)
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    # at most 3 ** rules rows
    return counted.join(F.broadcast(fitted), said, "left").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= 0.5)).drop(said)
