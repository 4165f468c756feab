"""Structured answers out of text: plain JSON in the JVM, anything else by a small repair in Arrow batches.

In order: what follows the first closing tag of a reasoning block; the text as JSON; doubled braces made single; the first
fenced block, then repaired; the whole text repaired (an object somewhere in it, single quotes, bare keys, trailing
commas, Python's constants).  A repaired answer must be an object.  Then six fields must be there, each of them text.
The repair covers less than a full repair library does.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("domain", "category", "doctype", "vendor", "date", "subject")
PARSE_ERROR = "LLM_PARSE_ERROR"
REASONING = "</classification_analysis>"
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'', re.S)
SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])


def balanced(text: str) -> str | None:
    """The longest {...} whose braces balance outside strings."""
    best, depth, start, at = None, 0, 0, 0
    while at < len(text):
        c = text[at]
        if c == '"' and depth:
            m = re.compile(r'"(?:[^"\\]|\\.)*"', re.S).match(text, at)
            at = m.end() if m else at + 1
            continue
        if c == "{":
            start = at if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth and (best is None or at + 1 - start > len(best)):
                best = text[start : at + 1]
        at += 1
    return best


def _loads(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def repaired(text: str) -> dict | None:
    """An object read from text that is nearly JSON, or None."""
    body = balanced(text)
    if body is None:
        head = text.find("{")
        if head < 0:
            return None
        body = text[head:] + "}"  # cut short
    found = _loads(body)
    if isinstance(found, dict):
        return found
    parts, at = [], 0

    def plain(s: str) -> str:
        s = re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", re.sub(r"\bNone\b", "null", s)))
        return re.sub(r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3', s)

    strings = []
    for m in _QUOTED.finditer(body):
        quote = m[0][0]
        inner = m[0][1:-1].replace("\\'", "'") if quote == "'" else m[0][1:-1]
        strings.append('"' + (re.sub(r'(?<!\\)"', r"\"", inner) if quote == "'" else inner) + '"')
        parts += [body[at : m.start()], "\0"]
        at = m.end()
    shape = re.sub(r",(\s*[}\]])", r"\1", plain("".join([*parts, body[at:]])))
    for s in strings:
        shape = shape.replace("\0", s, 1)
    found = _loads(shape)
    return found if isinstance(found, dict) else None


def read(response: str | None):
    """The answer in a response, or None; a list or other value is returned as it is."""
    if response is None:
        return None
    text = response.strip()
    if REASONING in text:
        text = text.split(REASONING, 1)[1].strip()
    found = _loads(text)
    if found is not None:
        return found
    if text.startswith("{{") and text.endswith("}}"):
        text = "{" + text[2:-2] + "}"
        found = _loads(text)
        if found is not None:
            return found
    fenced = _FENCE.search(text)
    if fenced:
        found = _loads(fenced[1].strip())
        found = found if isinstance(found, dict) else repaired(fenced[1])
        if found is not None:
            return found
    return repaired(text)


def fields(answer) -> dict | None:
    """The six fields if all are there and text; a list or any other value has none."""
    if not isinstance(answer, dict) or any(not isinstance(answer.get(f), str) for f in FIELDS):
        return None
    return {f: answer[f] for f in FIELDS}


@F.pandas_udf(SCHEMA)
def _slow(responses: pd.Series) -> pd.DataFrame:
    """Answers that Spark could not read; null: it could, and there is nothing to do."""
    rows = [None if r is None else fields(read(r)) for r in responses]
    return pd.DataFrame([r or dict.fromkeys(FIELDS) for r in rows], columns=list(FIELDS))


def parsed(df: DataFrame, response: str) -> DataFrame:
    """Add ``fields`` (null if there is no answer), error_code and error_message (with the response's beginning).

    One pass: rows are not split by kind, so whatever made the responses, say a model, runs once.  Of answers that parse
    at once only a null goes to Python.
    """
    tree = F.try_parse_json(F.trim(response))
    typed = [F.schema_of_variant(F.try_variant_get(tree, f"$.{f}", "variant")) == "STRING" for f in FIELDS]
    fast = F.when(F.coalesce(F.forall(F.array(*typed), lambda x: F.coalesce(x, F.lit(False))), F.lit(False)), F.struct(*[F.try_variant_get(tree, f"$.{f}", "string").alias(f) for f in FIELDS]))
    quick = df.withColumn("_fast", F.when(F.startswith(F.trim(response), F.lit("{")), fast))
    both = quick.withColumn("_slow", _slow(F.when(F.col("_fast").isNull(), F.coalesce(response, F.lit("")))))
    out = both.withColumn("fields", F.coalesce("_fast", F.when(F.col("_slow.domain").isNotNull(), F.col("_slow")))).drop("_fast", "_slow")
    failed = F.col("fields").isNull()
    return out.withColumns({"error_code": F.when(failed, PARSE_ERROR), "error_message": F.when(failed, F.concat(F.lit("no classification in: "), F.substring(F.coalesce(response, F.lit("")), 1, 200)))})
