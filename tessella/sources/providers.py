"""What the engine asks of the outside: pages, candidates, model answers.

A provider is any callable of the right shape; the defaults are offline and
deterministic.  Retries, delays and quarantine belong to providers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fetch = Callable[[str], tuple[int, str]]
Complete = Callable[[str], str]


class RateLimited(Exception):
    """A provider that asks to be left alone for a while."""


@dataclass
class ModelPool:
    """Models in turn; one that is rate-limited is left out for ``pause`` seconds."""

    models: list[str]
    pause: float = 300.0
    until: dict[str, float] = field(default_factory=dict)

    def choose(self, worker: int, now: float) -> str | None:
        free = [m for m in self.models if self.until.get(m, 0.0) <= now]
        return free[worker % len(free)] if free else None

    def quarantine(self, model: str, now: float) -> None:
        self.until[model] = now + self.pause


def answer_text(content) -> str:
    """An answer's content as a string: none, a string, or a list of blocks."""
    if content is None:
        return ""
    if isinstance(content, list):
        return "".join(b.get("text", "") if isinstance(b, dict) else str(b) for b in content)
    return str(content)


def ask(prompt: str, complete: Complete, acceptable: Callable[[str], bool], attempts: int = 3, retry: str = "\nThe answer could not be read; answer with the JSON array only.") -> str:
    """Up to ``attempts`` answers until one is acceptable; the last otherwise; empty on another error."""
    raw = ""
    for _ in range(attempts):
        try:
            raw = answer_text(complete(prompt))
        except RateLimited:
            continue
        except Exception:  # any provider's error ends the conversation
            return ""
        if acceptable(raw):
            return raw
        prompt += retry
    return raw


def completions(prompts: DataFrame, complete: Complete, acceptable: Callable[[str], bool] = bool, column: str = "prompt") -> DataFrame:
    """``prompts`` with ``raw``, an answer to each prompt; asked on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(raw=[ask(p, complete, acceptable) for p in part[column]])

    return prompts.mapInPandas(run, prompts.withColumn("raw", F.lit("")).schema)


def recorded_answers(prompts: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """The offline default: answers from a table, empty where it has none."""
    return prompts.join(recorded.select(*keys, "raw"), keys, "left").withColumn("raw", F.coalesce("raw", F.lit("")))


def fetched(urls: DataFrame, fetch: Fetch) -> DataFrame:
    """``(url, html)`` of the URLs that a fetcher answers with status 200."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for url in part["url"]:
                try:
                    status, body = fetch(url)
                except Exception:  # a page that can't be fetched is absent
                    continue
                if status == 200:
                    rows.append((url, body))
            yield pd.DataFrame(rows, columns=["url", "html"])

    return urls.select("url").mapInPandas(run, "url string, html string")


def cached_candidates(queue: DataFrame, cache: DataFrame, languages: tuple[str, ...] = ("fr", "en")) -> tuple[DataFrame, DataFrame]:
    """``cache(label, lang, found)``, empty results included -> what is known, and ``(label, lang)`` still to ask."""
    asked = queue.select(F.col("name").alias("label")).distinct().select("label", F.explode(F.array(*map(F.lit, languages))).alias("lang"))
    return cache.join(asked, ["label", "lang"], "left_semi"), asked.join(cache, ["label", "lang"], "left_anti")
