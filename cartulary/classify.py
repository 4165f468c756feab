"""The classification pipeline: documents to canonical terms, paths and names; every failure is a row.

The model is a backend that answers a batch of prompts inside a partition.  The one that comes with the engine is a
stand-in for tests: it looks for vocabulary terms in the text, and says nothing about a language model's accuracy.
"""

from __future__ import annotations

import json as plain_json
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary import calls, prompts, storage
from cartulary.backends import TRANSIENT, Answer, ApiError
from cartulary.functions import json, paths, text
from cartulary.operators import metrics
from cartulary.operators.canonicalise import canonicalise, with_singular
from cartulary.operators.experiments import exit_code
from cartulary.vocabulary import Vocabulary, get

CODES = ("DOCUMENT_LOAD_FAILED", "LLM_PARSE_ERROR", "LLM_API_ERROR", "TAXONOMY_VALIDATION_FAILED", "TEMPLATE_ERROR", "CONFIG_ERROR", "FILENAME_POLICY_VIOLATION", "UNEXPECTED_ERROR")


class TransientError(ConnectionError):
    """A failure worth another attempt."""


#: Which code an exception of a backend gets: the first that it is an instance of.
FAILURES = ((prompts.TemplateError, "TEMPLATE_ERROR"), (TRANSIENT, "LLM_API_ERROR"), (ApiError, "LLM_API_ERROR"), (ValueError, "CONFIG_ERROR"), (Exception, "UNEXPECTED_ERROR"))
TOKENS = calls.TOKENS
#: Rows that a partition hands on together, as their calls have ended.
AT_ONCE = 32


class Backend(Protocol):
    """Answers with a text, or with an Answer that also tells its tokens."""

    def answer(self, system: str, human: str) -> str | Answer: ...


def failure(e: Exception) -> tuple[str, str]:
    """Code and message of a failed call."""
    code = next(c for kind, c in FAILURES if isinstance(e, kind))
    return code, f"{type(e).__name__}: {e}" if code == "UNEXPECTED_ERROR" else str(e)


class Keywords:
    """Deterministic stand-in: the first vocabulary term of each axis that occurs as a word of the text."""

    def __init__(self, vocabulary: Vocabulary | None = None):
        v = vocabulary or get()
        self.domains, self.doctypes = sorted(v.domains), sorted(v.doctypes)
        self.categories = {d: v.canonical_categories(d) for d in v.canonical_domains()}
        self.canonical = v.domains

    def answer(self, system: str, human: str) -> str:
        words = set(human.lower().replace("\n", " ").split())
        pick = lambda terms, default: next((t for t in terms if t in words), default)
        domain = pick(self.domains, "reference")
        category = pick(self.categories[self.canonical[domain]], self.categories[self.canonical[domain]][0])
        return plain_json.dumps({"domain": domain, "category": category, "doctype": pick(self.doctypes, "document"), "vendor": "unknown", "date": text.NO_DATE, "subject": " ".join(human.split()[:3])})


def asker(make: Callable[[str | None, str | None], Callable[[], Backend]], template: str = prompts.DEFAULT, menu: str = "", attempts: int = 3, wait: float = 0.0, most_wait: float = 10.0, on_token: Callable[[str], None] | None = None) -> calls.Asker:
    """Asks with a template's two parts; make(provider, model): what makes a thread's backend."""
    system, human = prompts.split(template)
    system = prompts.render(system, menu, "")
    return calls.Asker(make, lambda content: (system, prompts.render(human, menu, content)), failure, attempts, wait, most_wait, on_token)


def invoke(df: DataFrame, make: Callable[[], Backend], template: str = prompts.DEFAULT, menu: str = "", attempts: int = 3, wait: float = 0.0, most_wait: float = 10.0, stop: bool = False, debug: bool = False, width: int = 1, sign: str | None = None, on_token: Callable[[str], None] | None = None) -> DataFrame:
    """(path, content, error_code, ...) -> with response, latency_ms and tokens.

    Each partition has up to ``width`` calls open, each of these with a backend of its own, and hands rows on as calls end.
    Transient failures are tried ``attempts`` times in all, waiting twice as long each time, from ``wait`` to
    ``most_wait`` seconds; what fails is a row with a code.  stop: after the first failure no more is asked, in the
    partition where it was and, if ``sign`` names a file in a folder that all tasks share, in every other; the rest are rows
    that say so.  debug: also ``prompt``, what was asked.  on_token: see ``calls.Asker``; it runs in the workers.
    """
    ask = asker(lambda provider, model: make, template, menu, attempts, wait, most_wait, on_token)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(row: tuple[pd.DataFrame, int]) -> calls.Outcome:
            batch, i = row
            code = batch["error_code"].iat[i]
            return ask(batch["content"].iat[i]) if code is None else calls.Outcome(None, code, batch["error_message"].iat[i], asked=False)

        def given(rows: list[tuple[tuple[pd.DataFrame, int], calls.Outcome]]) -> Iterator[pd.DataFrame]:
            by_batch: dict[int, list] = {}
            for (batch, i), got in rows:
                by_batch.setdefault(id(batch), [batch]).append((i, got))
            for batch, *some in by_batch.values():
                part, outs = batch.iloc[[i for i, _ in some]], [got for _, got in some]
                tokens = {t: pd.array([getattr(o.answer, t, None) for o in outs], dtype="Int64") for t in calls.TOKENS}
                asked = {"prompt": ["\n\n".join(ask.render(c)) for c in part["content"].fillna("")]} if debug else {}
                yield part.assign(response=[o.answer and o.answer.text for o in outs], error_code=[o.code for o in outs], error_message=[o.message for o in outs], latency_ms=[o.latency_ms for o in outs], **tokens, **asked)

        rows, ended = ((batch, i) for batch in batches for i in range(len(batch))), []
        for pair in calls.pooled(rows, one, width, calls.Stop(sign) if stop else None):
            ended.append(pair)
            if len(ended) >= AT_ONCE:
                yield from given(ended)
                ended = []
        yield from given(ended)

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", response string, latency_ms double, " + ", ".join(f"{t} long" for t in calls.TOKENS) + ", prompt string" * debug
    return df.mapInPandas(run, schema)


def prepared(documents: DataFrame, cap: int = 20_000) -> DataFrame:
    """Documents with their text cut to ``cap`` characters and the columns that tell how they were loaded."""
    none = lambda kind: F.lit(None).cast(kind)
    loader = [(F.col(n) if n in documents.columns else none(kind)).alias(n) for n, kind in (("loader_latency_ms", "double"), ("loader_backend", "string"))]
    return documents.select("path", text.truncate(F.col("content"), cap).alias("content"), "error_code", "error_message", *loader)


def classify(documents: DataFrame, make: Callable[[], Backend] = Keywords, vocabulary: Vocabulary | None = None, mode: str = "fallback", cap: int = 20_000, partitions: int | None = None, template: str = prompts.DEFAULT, naming: str = "nara", model: str | None = None, debug: bool = False, stop: bool = False, **options) -> DataFrame:
    """(path, content, error_code, error_message) -> original, suggested_path, suggested_filename, six fields, error, code, message.

    partitions times ``width`` bounds the calls that are open at once; without partitions the input's count.  ``metrics``
    holds latency and tokens, with ``model`` its name and cost, and what the loader said.  debug: also ``prompt`` and
    ``response``.  stop: the first failure ends the calls of all partitions.  Further arguments go to ``invoke``.  The backend is asked
    again by everything that reads the result: hold it before that.
    """
    v = vocabulary or get()
    ready = prepared(documents, cap)
    ready = ready.repartition(partitions) if partitions else ready
    sign = f"{storage.shared_folder(documents.sparkSession)}/stops/{uuid.uuid4().hex}" if stop else None
    answered = invoke(ready, make, template, v.menu(), debug=debug, stop=stop, sign=sign, **options)
    return finished(answered, v, mode, naming, model, debug)


def finished(answered: DataFrame, vocabulary: Vocabulary | None = None, mode: str = "fallback", naming: str = "nara", model: str | None = None, debug: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """What ``invoke`` or a log of calls says, parsed, canonical, with path and name; ``keep``: further columns that stay."""
    v = vocabulary or get()
    rows = json.parsed(answered.withColumnsRenamed({"error_code": "_code", "error_message": "_message"}), "response")
    rows = rows.withColumns({"error_code": F.coalesce("_code", "error_code"), "error_message": F.when(F.col("_code").isNotNull(), F.col("_message")).otherwise(F.col("error_message"))})
    kept = ("latency_ms", *TOKENS, "loader_latency_ms", "loader_backend", *(("prompt", "response") if debug else ()), *keep)
    rows = rows.select("path", *kept, "error_code", "error_message", *[F.col(f"fields.{f}").alias(f) for f in json.FIELDS])
    if mode == "strict":
        held = canonicalise(rows.withColumnsRenamed({"error_code": "_code", "error_message": "_message"}), v, "strict")
        held = held.withColumns({"error_code": F.coalesce("_code", "error_code"), "error_message": F.when(F.col("_code").isNotNull(), F.col("_message")).otherwise(F.col("error_message"))}).drop("_code", "_message")
    else:
        held = canonicalise(rows, v)
    held = with_singular(held, vocabulary=v)
    d, c, t = (F.col(f"canon_{a}") for a in ("domain", "category", "doctype"))
    name = paths.policy(naming)(F.col("singular"), F.col("vendor"), F.col("subject"), F.col("date"), text.suffix(F.col("path")))
    held = held.withColumns({"_name": name, "_path": F.concat_ws("/", paths.folder(d, c, t), name)})
    bad = F.coalesce(paths.filename_error(F.col("_name")), paths.path_error(F.col("_path")))
    held = held.withColumns({"error_message": F.when(F.col("error_code").isNotNull(), F.col("error_message")).otherwise(bad), "error_code": F.coalesce("error_code", F.when(bad.isNotNull(), "FILENAME_POLICY_VIOLATION"))})
    price = [F.lit(x).cast("double") for x in metrics.price_of(model) or (None, None)]
    dollars = metrics.cost(F.col("input_tokens"), F.col("output_tokens"), *price)
    measured = F.struct(F.lit(model).cast("string").alias("model"), *TOKENS, "latency_ms", dollars.alias("cost_usd"), "loader_latency_ms", "loader_backend")
    ok = F.col("error_code").isNull()
    return held.select(
        text.basename(F.col("path")).alias("original"), "path", F.when(ok, F.col("_path")).alias("suggested_path"), F.when(ok, F.col("_name")).alias("suggested_filename"),
        *[F.when(ok, F.col(f"canon_{a}")).alias(a) for a in ("domain", "category", "doctype")], *[F.when(ok, F.col(a)).alias(a) for a in ("vendor", "date", "subject")],
        (~ok).alias("error"), "error_code", "error_message", measured.alias("metrics"), *(("prompt", "response") if debug else ()), *keep,
    )


def outcome(results: DataFrame, on_error: str = "continue") -> int:
    """0, 1 or 2 as exit_code says; with on_error fail any failure is 2."""
    failed, n = results.agg(F.count_if("error"), F.count("*")).first()
    if on_error == "fail" and failed:
        return 2
    return 0 if not failed else (1 if failed < n else 2)


__all__ = ["CODES", "FAILURES", "Backend", "Keywords", "TransientError", "asker", "classify", "exit_code", "failure", "finished", "invoke", "outcome", "prepared"]
