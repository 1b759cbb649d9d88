"""Hooks for a user's model: prompts out, answers in.

The model itself stays outside. A hook is a plain function from one prompt to one answer; Spark
spreads the batches over the executors, so concurrency is the number of partitions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom import config
from echoloom.operators.order import with_chunk
from echoloom.schemas import CHUNK_RESPONSE, PREDICTION_ITEM

ITEMS = "{items}"
DEFAULT_PROMPT = "Give each review a theme, a sentiment and a confidence. Answer with a JSON array.\n\n" + ITEMS


def batch_reviews(
    reviews: DataFrame, size: int = config.SCORE_BATCH_SIZE, key: str = "review_id"
) -> DataFrame:
    """Add ``batch_id`` and ``ord``: consecutive batches in input order."""
    return with_chunk(reviews, size, (), "batch_id", identifier=key)


def build_prompts(
    batched: DataFrame, key: str = "review_id", template: str = DEFAULT_PROMPT, chars: int = config.SCORE_TEXT_CHARS
) -> DataFrame:
    """One prompt per batch: the template around a JSON array of identifiers and shortened texts."""
    item = F.struct(
        "ord",
        F.struct(F.col(key).cast("string").alias("review_id"), F.substring("clean_text", 1, chars).alias("text"))
        .alias("item"),
    )
    head, _, tail = template.partition(ITEMS)
    items = F.transform(F.sort_array(F.collect_list(item)), lambda entry: entry["item"])
    return batched.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_reviews"), items.alias("items")).select(
        "batch_id", "n_reviews", F.concat(F.lit(head), F.to_json("items"), F.lit(tail)).alias("prompt")
    )


def holds_json(opening: str, closing: str) -> Callable[[str], bool]:
    """Test for an answer whose text between two brackets parses as JSON; one nested too deeply to read does not."""

    def check(answer: str) -> bool:
        first, last = answer.find(opening), answer.rfind(closing)
        if first < 0 or last < first:
            return False
        try:
            json.loads(answer[first:last + 1])
        except (ValueError, RecursionError):
            return False
        return True

    return check


def ask(
    model: Callable[[str], str],
    prompt: str,
    accepts: Callable[[str], bool],
    max_retries: int = config.SCORE_MAX_RETRIES,
    sleep: Callable[[float], None] = time.sleep,
) -> str | None:
    """One answer, or None once the retries are used up.

    A timeout waits 1 s, 2 s, ... before the next try, an unreadable answer asks again at once;
    any other error is the caller's.
    """
    for attempt in range(max_retries + 1):
        try:
            answer = model(prompt)
        except TimeoutError:
            if attempt < max_retries:
                sleep(2.0 ** attempt)
            continue
        if accepts(answer):
            return answer
    return None


def score_batches(
    prompts: DataFrame,
    model: Callable[[str], str],
    accepts: Callable[[str], bool] | None = None,
    max_retries: int = config.SCORE_MAX_RETRIES,
    concurrency: int | None = None,
) -> DataFrame:
    """Add ``response``: the model's answer to each prompt, null where it failed for good.

    A lost executor repeats its batches, so the model must tolerate being asked again.
    """
    accept = accepts or holds_json("[", "]")
    work = prompts.repartition(concurrency, *prompts.columns[:1]) if concurrency else prompts

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [ask(model, prompt, accept, max_retries) for prompt in frame["prompt"]]
            yield frame.assign(response=pd.Series(answers, index=frame.index, dtype="object"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields)
    return work.mapInPandas(run, f"{fields}, response string")


def json_between(c: Column, opening: str, closing: str) -> Column:
    """The text from the first opening to the last closing bracket; empty if there is none."""
    return F.regexp_extract(c, f"(?s)\\{opening}.*\\{closing}", 0)


def parse_predictions(scored: DataFrame) -> DataFrame:
    """Prediction rows of all readable answers; an unreadable or empty answer gives none."""
    items = F.from_json(json_between(F.col("response"), "[", "]"), f"array<{PREDICTION_ITEM.simpleString()}>")
    return scored.select(F.explode(items).alias("item")).select("item.*").filter(F.col("review_id").isNotNull())


def parse_chunk_answers(scored: DataFrame) -> DataFrame:
    """Key points and quotes of all readable chunk answers; an unreadable one is left out."""
    answer = F.from_json(json_between(F.col("response"), "{", "}"), CHUNK_RESPONSE)
    carried = [c for c in scored.columns if c not in ("response", "prompt")]
    parsed = scored.select(*carried, answer.alias("answer")).filter(F.col("answer").isNotNull())
    empty = F.array().cast("array<string>")
    return parsed.select(
        *carried,
        F.coalesce("answer.key_points", empty).alias("key_points"),
        F.coalesce("answer.candidate_quotes", empty).alias("candidate_quotes"),
    )


def score_reviews(
    reviews: DataFrame,
    model: Callable[[str], str],
    template: str = DEFAULT_PROMPT,
    size: int = config.SCORE_BATCH_SIZE,
    concurrency: int | None = None,
) -> DataFrame:
    """Predictions for all reviews: batch, prompt, ask, parse."""
    prompts = build_prompts(batch_reviews(reviews, size), template=template)
    return parse_predictions(score_batches(prompts, model, concurrency=concurrency))
