"""Runs of tasks: prompts to responses, the outcome of each, what to do again, merging what was done, and differences.

Model calls are outside Spark's plan: ``respond`` calls a function of the caller's in Arrow batches, ``replay`` joins a table of
replies. Both give the same records, so everything after them is columns.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values of the data model.
RETRYABLE = [429, 500, 502, 503, 504]
REPLY = "response_text string, token_usage string, http_status int, finish_reason string, error string"
EMPTY, NULL_BYTE = "Model response is empty.", "Model response contains non-storable null byte."
TRUNCATED = "Response truncated: model hit max_tokens before producing output (finish_reason=length). Increase --max-tokens or reduce prompt size."


# --- outcomes -----------------------------------------------------------------------------------------


def outcome(prompt: Column, response: Column, finish: Column | None = None, error: Column | None = None) -> Column:
    """Status of a task: error_prompt (nothing asked), error (no reply, or one that failed), error_truncated, error_empty, else ok."""
    none = F.lit(None).cast("string")
    finish, error = none if finish is None else finish, none if error is None else error
    said = T.strip(response)
    return (
        F.when(F.coalesce(T.strip(prompt), F.lit("")) == "", "error_prompt")
        .when(error.isNotNull() | response.isNull(), "error")
        .when((said == "") & F.coalesce(finish == "length", F.lit(False)), "error_truncated")
        .when(said == "", "error_empty")
        .when(response.contains("\x00"), "error_truncated")
        .otherwise("ok")
    )


def pairs(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant's next turn, and the outcome."""
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    said = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return user.join(said, ["conv_id", "turn"], "left").withColumn("status", outcome(F.col("prompt"), F.col("response")))


def scorable(records: DataFrame) -> DataFrame:
    """Records that can be scored: ok, with a text."""
    return records.filter((F.col("status") == "ok") & (F.coalesce(F.col("response_text"), F.lit("")) != ""))


def retryable(http_status: Column) -> Column:
    return http_status.isNull() | http_status.isin(RETRYABLE)


@dataclass(frozen=True)
class RetryPolicy:
    """Tries after the first, and the wait before the next: ``base`` times 2 to the number of the try from 0, or (linear) times its number from 1."""

    retries: int = 3
    base: float = 5.0
    linear: bool = False

    def delay(self, attempt: int) -> float:
        return self.base * (attempt + 1) if self.linear else self.base * 2**attempt


def chat(url: str, model: str, key: str = "", temperature: float = 0.2, max_tokens: int = 1800, timeout: float = 600.0, extra: dict | None = None) -> Callable[[str], dict]:
    """An ``ask`` for ``respond``: one POST of a chat completion to ``url``/chat/completions, its outcome as the fields of ``REPLY``.

    A failed status gives the service's code and message, a connection that fails no status at all; neither raises.
    """
    def ask(prompt: str) -> dict:
        import json
        import urllib.error
        import urllib.request

        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": max_tokens, **(extra or {})}
        request = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                status, raw = reply.status, reply.read()
        except urllib.error.HTTPError as e:
            raw = e.read()
            try:
                error = json.loads(raw).get("error", {})
            except (ValueError, AttributeError):
                error = raw.decode("utf-8", "replace")
            said = f"(code={error.get('code', e.code)}): {error.get('message', 'Unknown error')}" if isinstance(error, dict) else f": {error}"
            return {"http_status": e.code, "error": f"chat error {said}"}
        except OSError as e:
            return {"error": f"request failed: {e}"}
        try:
            got = json.loads(raw)
        except ValueError:
            got = {}
        choice = (got.get("choices") or [{}])[0]
        content = choice.get("message", {}).get("content", "")
        parts = [content] if isinstance(content, str) else [b.get("text", "") for b in content or [] if isinstance(b, dict) and b.get("type") == "text"]
        usage = got.get("usage")
        return {"http_status": status, "response_text": "".join(parts), "finish_reason": choice.get("finish_reason"), "token_usage": None if usage is None else json.dumps(usage)}

    return ask


def respond(tasks: DataFrame, prompt: str, ask: Callable[[str], dict], policy: RetryPolicy = RetryPolicy(), wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``tasks`` with the columns of ``REPLY``. ``ask`` gives some of them for a prompt; a reply whose ``error`` has a status to try again, or none, is asked again.

    Each use of the result asks again: ``logged`` writes the replies first.
    """
    fields = [c.split()[0] for c in REPLY.split(", ")]

    def one(text: str | None) -> dict:
        if not (text or "").strip():
            return {}
        for attempt in range(policy.retries + 1):
            reply = ask(text)
            status = reply.get("http_status")
            if reply.get("error") is None or (status is not None and status not in RETRYABLE) or attempt == policy.retries:
                return reply
            wait(policy.delay(attempt))
        return reply

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = [one(p) for p in batch[prompt]]
            yield batch.assign(**{f: [r.get(f) for r in replies] for f in fields})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema.fields)
    return tasks.mapInPandas(run, f"{schema}, {REPLY}")


def logged(answered: DataFrame, path: str) -> DataFrame:
    """Replies appended to a folder of JSON lines as they come, and read back from there: every prompt is asked once, whatever is made of the replies."""
    answered.write.mode("append").json(path)
    return answered.sparkSession.read.schema(answered.schema).json(path)


def replay(tasks: DataFrame, replies: DataFrame, key: str = "task_id") -> DataFrame:
    """``tasks`` with the replies of an earlier run (``key`` and columns of ``REPLY``); null where there is none."""
    return tasks.join(replies, key, "left")


def results(asked: DataFrame, prompt_field: str, dry_run: bool = False) -> DataFrame:
    """Run records of tasks with replies (``respond`` or ``replay``): status, message, and the fields that a failed record leaves empty."""
    prompt = T.strip(F.coalesce(F.col(prompt_field), F.lit("")))
    if dry_run:
        text, status = F.lit("[DRY RUN] call skipped."), F.when(prompt == "", "error_prompt").otherwise("dry_run")
        message = F.when(prompt == "", F.concat(F.lit("Task '"), F.col("task_id"), F.lit(f"' has an empty '{prompt_field}' prompt.")))
    else:
        text, status = F.col("response_text"), outcome(F.col(prompt_field), F.col("response_text"), F.col("finish_reason"), F.col("error"))
        message = (
            F.when(status == "error_prompt", F.concat(F.lit("Task '"), F.col("task_id"), F.lit(f"' has an empty '{prompt_field}' prompt.")))
            .when(status == "error", F.concat(F.lit("HTTPError(status="), F.coalesce(F.col("http_status").cast("string"), F.lit("None")), F.lit("): "), F.coalesce(F.col("error"), F.lit("no reply"))))
            .when(status == "error_empty", EMPTY)
            .when(status == "error_truncated", F.when(T.strip(F.col("response_text")) == "", TRUNCATED).otherwise(NULL_BYTE))
        )
    good = status.isin("ok", "dry_run")
    return asked.withColumns({
        "status": status,
        "error_message": message,
        "prompt_field_used": F.when(good, prompt_field).otherwise(""),
        "prompt": F.when(good, prompt).otherwise(""),
        "response_text": F.when(good, text).otherwise(""),
        "token_usage": F.when(status == "ok", F.col("token_usage") if "token_usage" in asked.columns else F.lit(None).cast("string")),
    })


def utc_slug(at: datetime | None = None) -> str:
    return (at or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")


# --- sets of records ----------------------------------------------------------------------------------


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).join(have.select(key), key, "left_anti")


def present(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).join(have.select(key), key, "left_semi")


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``base``, each row replaced as a whole by the row of ``new`` with its key; keys that ``base`` lacks are left out.

    A row position in ``base`` (a column that ``new`` lacks) stays, so its order can be restored. ``new`` has a key once.
    """
    own = [c for c in base.columns if c != key]
    there = new.select(F.col(key).alias("_of"), F.struct(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in own]).alias("_row")) if own else new.select(F.col(key).alias("_of"))
    joined = base.join(there, F.col(key) == F.col("_of"), "left")
    return joined.select(*[F.when(F.col("_of").isNotNull(), F.col("_row")[c]).otherwise(F.col(c)).alias(c) if c != key and c in new.columns else F.col(c) for c in base.columns])


def diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cells that differ: key, column, old and new value as text (null as empty). A row that only one side has is a cell named ``(row)``."""
    side = lambda df, p: df.select(F.col(key).alias(p), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(p + c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("a_" + c).alias("old"), F.col("b_" + c).alias("new")) for c in columns])
    alone = F.array(F.struct(F.lit("(row)").alias("column_name"), F.when(F.col("a_").isNotNull(), "present").alias("old"), F.when(F.col("b_").isNotNull(), "present").alias("new")))
    changed = F.when(F.col("a_").isNull() | F.col("b_").isNull(), alone).otherwise(F.filter(cells, lambda x: x["old"] != x["new"]))
    both = side(before, "a_").join(side(after, "b_"), F.col("a_") == F.col("b_"), "full_outer")
    return both.select(F.coalesce("a_", "b_").alias(key), F.explode(changed).alias("cell")).select(key, "cell.*")
