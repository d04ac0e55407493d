"""Enrichment: queue rows -> prompts -> answers -> insight rows and errors.

The model is a function from a prompt to (content, prompt tokens, completion tokens), called on the
executors. Answers cost money and may differ, so the caller writes them once and reads them back
before splitting them; a recomputed plan would ask again.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import analysis as A
from ..sources.pages import ContentFiltered
from .pool import bounded

Completer = Callable[[str], tuple[str, int, int]]

_TEXTS = (
    "tldr", "community_take", "top_comments", "sentiment", "controversy", "tags", "article_type", "entities", "ad_likelihood",
    "factuality", "ai_generated", "push_stance", "push_facts", "qa_summary",
)
ANSWERS = T.StructType(
    [T.StructField("article_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in (*_TEXTS, "model", "error")]
    + [T.StructField(c, T.LongType()) for c in ("prompt_tokens", "completion_tokens")]
)


def stub_completer(prompt: str) -> tuple[str, int, int]:
    """A deterministic answer, for tests and dry runs."""
    import json

    title = prompt.split("\n", 1)[0].partition("：")[2]
    answer = {"tldr": f"about {title}", "sentiment": "正面", "controversy": "低", "tags": ["stub"], "entities": [{"name": title, "type": "其他"}]}
    return json.dumps(answer, ensure_ascii=False), len(prompt), 20


def with_prompts(queue: DataFrame) -> DataFrame:
    """(article_id, prompt); ``n_pushes``, if there, is how many pushes an article has where ``pushes`` has the first only."""
    total = F.col("n_pushes") if "n_pushes" in queue.columns else None
    text = A.prompt(F.col("title"), F.col("author"), F.col("content"), F.col("pushes"), total)
    return queue.select(F.col("id").alias("article_id"), text.alias("prompt"))


def _answer(completer: Completer, prompt: str, attempts: int) -> dict:
    for attempt in range(attempts):
        try:
            content, asked, said = completer(prompt)
            return A.parse_analysis(content) | {"error": None, "prompt_tokens": asked, "completion_tokens": said}
        except ContentFiltered:
            return {"error": "content_filter"}
        except ValueError as e:
            failure = f"parse llm output: {e}"
    return {"error": failure}


def analyze(prompts: DataFrame, completer: Completer = stub_completer, model: str = "stub", attempts: int = 2, concurrency: int = 1) -> DataFrame:
    """(article_id, prompt) -> ANSWERS. An answer that can't be read is asked for once more; then, or
    for a declined prompt or a call that fails in whatever way, the row has its error. At most ``concurrency`` calls
    run at once in a task; how many tasks run is the caller's partitioning."""

    def run(batches):
        for frame in batches:
            found = bounded(lambda prompt: _answer(completer, prompt, attempts), frame["prompt"], concurrency)
            rows = [{"article_id": i, "model": model, **(row if error is None else {"error": str(error) or type(error).__name__})} for i, (row, error) in zip(frame["article_id"], found)]
            out = pd.DataFrame(rows, columns=ANSWERS.names, dtype=object)
            out["article_id"] = out["article_id"].astype("int64")
            yield out.astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    return prompts.mapInPandas(run, ANSWERS)


def answers_and_errors(written: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = written.where("error is null").drop("error")
    return good, written.where("error is not null").select("article_id", "error")


def digests(prompts: DataFrame, day: str, now: int, completer: Completer = stub_completer, model: str = "stub", concurrency: int = 1) -> DataFrame:
    """Digest rows from (board_id, article_count, prompt); blank answers and failed calls give none."""
    schema = "board_id long, article_count long, digest string, prompt_tokens long, completion_tokens long"

    def run(batches):
        for frame in batches:
            rows = []
            for board_id, n, (answer, error) in zip(frame["board_id"], frame["article_count"], bounded(completer, frame["prompt"], concurrency)):
                if error is None and answer[0].strip():
                    rows.append((board_id, n, answer[0].strip(), *answer[1:]))
            out = pd.DataFrame(rows, columns=["board_id", "article_count", "digest", "prompt_tokens", "completion_tokens"], dtype=object)
            yield out.astype({c: "int64" for c in out.columns if c != "digest"})

    made = prompts.select("board_id", "article_count", "prompt").mapInPandas(run, schema)
    return made.select(
        "board_id", F.lit(day).alias("day"), "digest", "article_count", F.lit(model).alias("model"), "prompt_tokens", "completion_tokens",
        F.lit(now).cast("long").alias("generated_at"),
    )
