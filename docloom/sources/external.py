"""Adapters for services that stay outside: OCR and layout engines, extended formats, language models.

Each takes a callable; without one, rows carry an error and the deterministic path goes on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions.rows import SLICE


class Retryable(Exception):
    """A failure worth another attempt: 429, 5xx, network."""


def content_text(content) -> str:
    """The text of a model's content: a string, nothing, or a list of parts."""
    if content is None:
        return ""
    if isinstance(content, str):
        return content
    return "".join(p if isinstance(p, str) else str(p.get("text", "")) for p in content)


def complete(request: dict, models: list[str], call: Callable[[str, dict], dict], retries: int = 2, wait: float = 0.25, sleep=time.sleep) -> dict:
    """The first answer of a chain of models; each is tried again with growing waits while failures are retryable."""
    last: Exception | None = None
    for model in models:
        for n in range(retries + 1):
            try:
                got = call(model, request)
                return {"model": model, "text": content_text(got.get("content")), **{k: got.get(k) for k in ("prompt_tokens", "completion_tokens", "cost_usd")}}
            except Retryable as e:
                last = e
                if n < retries:
                    sleep(wait * 2**n)
    raise RuntimeError(f"no model answered: {last}")


class LineWorker:
    """A converter that runs beside a Python worker: a JSON object per line in, one out ({"ok", "markdown", "error"}).

    It starts with the first request and again after it died; a request that takes longer than `timeout`
    seconds ends it.  Whatever waits for a process that died gets an error, not an answer to another request.
    """

    def __init__(self, command: list[str], timeout: float = 120.0):
        self.command, self.timeout, self.process, self.number = command, timeout, None, 0

    def __getstate__(self):
        return {"command": self.command, "timeout": self.timeout, "process": None, "number": 0}

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.wait()
            self.process = None

    def __call__(self, row: dict) -> str:
        import base64
        import json
        import subprocess
        import threading

        if self.process is None or self.process.poll() is not None:
            self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8")
        self.number += 1
        plain = {k: base64.b64encode(v).decode() if isinstance(v, (bytes, bytearray)) else v for k, v in row.items()}
        expired = threading.Timer(self.timeout, self.close)
        expired.start()
        process = self.process
        try:
            process.stdin.write(json.dumps({"id": self.number, **plain}, default=str) + "\n")
            process.stdin.flush()
            line = process.stdout.readline()
        except OSError as e:
            line, cause = "", e
        else:
            cause = None
        finally:
            expired.cancel()
        if not line:
            self.close()
            raise RuntimeError(f"the converter ended or took over {self.timeout:g} s") from cause
        got = json.loads(line)
        if got.get("id") != self.number:
            self.close()
            raise RuntimeError("the converter answered another request")
        if not got.get("ok"):
            raise RuntimeError(got.get("error") or "the converter refused")
        return got["markdown"]


def rest_engine(url: str, timeout: float = 300.0, field: str = "markdown") -> Callable[[dict], str]:
    """A layout engine behind HTTP: the row's content and page range as JSON, the answer's Markdown; 429, 5xx and network failures are tried again."""

    def call(row: dict) -> str:
        import base64
        import json
        import urllib.error
        import urllib.request

        body = {"content": base64.b64encode(bytes(row["content"])).decode(), **{k: row[k] for k in ("path", "first_page", "last_page", "ocr") if row.get(k) is not None}}
        request = urllib.request.Request(url, json.dumps(body, default=str).encode(), {"Content-Type": "application/json"})

        def once(_, __):
            try:
                with urllib.request.urlopen(request, timeout=timeout) as r:
                    return {"content": json.load(r)[field]}
            except urllib.error.HTTPError as e:
                if e.code == 429 or e.code >= 500:
                    raise Retryable(str(e)) from e
                raise
            except urllib.error.URLError as e:
                raise Retryable(str(e)) from e

        return complete({}, [url], once)["text"]

    return call


def map_service(rows: DataFrame, call: Callable[[dict], str] | None, out_col: str = "markdown", name: str = "service", concurrency: int = 4) -> DataFrame:
    """rows with out_col and error: a partition's rows go through the callable, so many at a time, in order."""
    if call is None:
        return rows.withColumns({out_col: F.lit(None).cast("string"), "error": F.lit(f"{name} is not configured")})
    cols = rows.columns
    at_once = 1 if isinstance(call, LineWorker) else concurrency  # a worker answers line by line

    def one(row: dict) -> tuple[str | None, str | None]:
        try:
            return call(row), None
        except Exception as e:  # noqa: BLE001  a failed call is a row's result
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(at_once) as pool:
            for f in (g.iloc[i : i + SLICE].copy() for g in frames for i in range(0, len(g), SLICE)):
                out = list(pool.map(one, f.to_dict("records")))
                f[out_col], f["error"] = [o[0] for o in out], [o[1] for o in out]
                yield f[[*cols, out_col, "error"]]
        if isinstance(call, LineWorker):
            call.close()

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType()), T.StructField("error", T.StringType())]))


def page_ranges(docs: DataFrame, pages: str = "page_count", chunk: int = 100) -> DataFrame:
    """docs with first_page and last_page of chunks, for engines that take so many pages at once."""
    x = docs.withColumn("first_page", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col(pages)), F.lit(chunk))))
    return x.withColumn("last_page", F.least(F.col(pages), F.col("first_page") + chunk - 1))


def join_ranges(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("first_page", "markdown")))
    return parts.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda p: p["markdown"]), "\n\n").alias("markdown"))


# Rules for a language model, in this library's own words; a caller may hand over others.
RULES = """Rewrite the text as compact Markdown that keeps every requirement, number, name, date and constraint.
Leave out greetings, hedges and repetitions; add nothing that the text does not say.  Answer with the document alone."""
MAIL_RULES = """
The text is an e-mail thread: give decisions, open questions and tasks with their owners and dates.  Quoted parts count once.  Put what is unresolved under "## Open risks"."""
CODING_RULES = """
The text is a request for software: use the headings Goal, Requirements, Constraints, Error handling and Acceptance criteria.
Keep identifiers, versions, paths, commands and error messages verbatim in backticks, and invent no requirement.  Ask for the least code that meets them: reuse before new code, the standard library before dependencies."""
# Words that mark a request for software.
CODING = r"(?i)\b(code|coding|script|function|class|method|bug|error|exception|stack ?trace|traceback|implement|refactor|compile|debug|unit test|python|typescript|javascript|java|rust|golang|c\+\+|sql|regex|api|endpoint|cli|repo)\b"


def prompt_request(text: str, kind: str, budget: int | None = None, rules: str | None = None) -> dict:
    """The request for a model: rules with what the kind adds, temperature 0, a fifth more tokens than the budget."""
    import re

    system = (rules or "").strip() or RULES
    system += MAIL_RULES if kind == "email" else CODING_RULES if kind == "prompt" and re.search(CODING, text) else ""
    request = {"messages": [{"role": "system", "content": system}, {"role": "user", "content": text}], "temperature": 0}
    return request | ({"max_tokens": -(-budget * 12 // 10)} if budget else {})


def summary_request(text: str, target: int) -> dict:
    """The request for a summary of about `target` tokens."""
    system = f"Summarise the text in at most {target} tokens.  Keep names, numbers, dates and decisions.  Answer with the summary alone."
    return {"messages": [{"role": "system", "content": system}, {"role": "user", "content": text}], "temperature": 0, "max_tokens": max(64, -(-target * 3 // 2))}


def whole_answer(got: dict) -> str:
    """The text of a model's answer; an empty one, or one cut off at its length, is a failure, as it would lose content."""
    text = content_text(got.get("content") if "content" in got else got.get("text")).strip()
    if not text:
        raise RuntimeError(f"the answer was empty ({got.get('finish_reason')})")
    if got.get("finish_reason") == "length":
        raise RuntimeError("the answer was cut off")
    return text


def prompt_optimizer(call: Callable[[dict], dict], budget: int | None = None, rules: str | None = None) -> Callable[[dict], str]:
    """A callable for rows of (text, kind) from one that answers requests."""
    return lambda row: whole_answer(call(prompt_request(row["text"], row.get("kind") or "prompt", budget, rules)))


def model_summaries(rows: DataFrame, call: Callable[[dict], dict] | None, text_col: str = "markdown", target_col: str = "target", out_col: str = "summary") -> DataFrame:
    """rows with a model's summary of each text, null where the model failed: the caller falls back to the extractive one."""
    ask = None if call is None else lambda row: whole_answer(call(summary_request(row[text_col], int(row[target_col]))))
    return map_service(rows, ask, out_col, "the language model")


def optimise_prompt(rows: DataFrame, call: Callable[[dict], str] | None, text_col: str = "text", fallback_col: str = "cleaned") -> DataFrame:
    """rows with optimized and warning: the model's text if there is one, else the deterministic result."""
    got = map_service(rows, call, "__llm", "the language model")
    usable: Column = F.col("__llm").isNotNull() & (F.trim("__llm") != "")
    x = got.withColumn("optimized", F.when(usable, F.col("__llm")).otherwise(F.col(fallback_col)))
    return x.withColumn("warning", F.when(~usable | F.col("__llm").isNull(), F.coalesce("error", F.lit("the model's answer was empty")))).drop("__llm", "error")
