"""Interfaces to speech and language models, and table-backed stand-ins.

No model is reimplemented here. A provider maps a DataFrame to a DataFrame with an
`error` column; a recorded one joins answers that were kept, so rules can be
applied again without asking again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of providers and what they give for each row that they are asked about.
KINDS = {
    "speech_spans": "span_idx int, start double, end double",
    "transcriber": "idx int, word string, start double, end double, probability double",
    "speaker_segments": "seg_idx int, start double, end double, speaker string",
    "embedder": "win_idx int, time double, vec array<float>",
    "listener": "text string, confidence double, tokens_in long, tokens_out long",
    "text_editor": "text string, tokens_in long, tokens_out long",
}


class Provider(Protocol):
    def __call__(self, asked: DataFrame) -> DataFrame: ...


@dataclass
class Recorded:
    """Answers from a table; rows without one get an error."""

    answers: DataFrame
    on: tuple[str, ...] = ("call_id",)

    def __call__(self, asked: DataFrame) -> DataFrame:
        out = asked.join(self.answers.withColumn("_there", F.lit(True)), list(self.on), "left")
        return out.withColumn("error", F.when(F.col("_there").isNull(), "no recorded answer")).drop("_there")


class Exhausted(Exception):
    """A provider's quota is spent: asking it again is of no use."""


def waits_of(attempt: int, error: Exception) -> float:
    """Seconds before another attempt: what the error says in `retry_after`, up to 180, else 8 for each attempt made."""
    told = getattr(error, "retry_after", None)
    return min(float(told), 180.0) if told is not None else 8.0 * (attempt + 1)


@dataclass
class Called:
    """Answers from a function of a batch of rows, in Arrow batches; a failing batch yields its rows with the error.

    make is run once in each worker process, so a model or a client is held there.
    A transient error is waited out and tried again; a provider that is Exhausted
    or still fails is followed by the next of others, and an exhausted one isn't
    asked again by that worker. With all of them exhausted the rest gets the error
    at once.
    """

    make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
    schema: str
    attempts: int = 3
    transient: tuple[type[Exception], ...] = (TimeoutError, ConnectionError)
    others: tuple[Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], ...] = ()
    wait: Callable[[int, Exception], float] = waits_of

    def __call__(self, asked: DataFrame) -> DataFrame:
        makers, attempts, transient, wait = (self.make, *self.others), self.attempts, self.transient, self.wait
        names = [c.strip().split(" ")[0] for c in self.schema.split(",")]

        def unanswered(rows: pd.DataFrame, e: Exception) -> pd.DataFrame:
            held = {c: list(rows[c]) if c in rows else [None] * len(rows) for c in names}
            return pd.DataFrame(held, dtype=object).assign(error=str(e) or type(e).__name__)

        def ask(answer: Callable, rows: pd.DataFrame) -> tuple[pd.DataFrame | None, Exception | None]:
            for attempt in range(attempts):
                try:
                    return answer(rows).assign(error=None), None
                except transient as e:
                    error: Exception = e
                    if attempt + 1 < attempts:
                        time.sleep(wait(attempt, e))
                except Exception as e:  # noqa: BLE001  one bad batch never stops the job
                    return None, e
            return None, error

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, Callable] = {}
            spent: set[int] = set()
            for rows in batches:
                out, error = None, Exhausted("every provider is exhausted")
                for k, make in enumerate(makers):
                    if out is None and k not in spent:
                        if k not in held:
                            held[k] = make()
                        out, error = ask(held[k], rows)
                        if isinstance(error, Exhausted):
                            spent.add(k)
                out = unanswered(rows, error) if out is None else out
                yield out[[*names, "error"]]

        return asked.mapInPandas(run, f"{self.schema}, error string")


def with_carried_prompt(windows: DataFrame, make: Callable[[], Callable[[pd.Series, str | None], list[str]]], tail: int = 25, keys=("call_id",)) -> DataFrame:
    """(keys, window, prompt, text): each window of a call asked with the last `tail` words heard so far as its prompt, null for the first.

    The windows of a call follow each other by nature; calls are dealt over tasks.
    make gives a function of a window's row and the prompt that returns words.
    """
    schema = ", ".join(f"{c} {windows.schema[c].dataType.simpleString()}" for c in (*keys, "window")) + ", prompt string, text string"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        hear, heard, out = make(), [], []
        for _, row in group.sort_values("window").iterrows():
            prompt = " ".join(heard[-tail:]) or None
            said = list(hear(row, prompt))
            heard += said
            out.append((*(row[c] for c in (*keys, "window")), prompt, " ".join(said)))
        return pd.DataFrame(out, columns=[*keys, "window", "prompt", "text"])

    return windows.groupBy(*keys).applyInPandas(run, schema)


@dataclass
class Registry:
    """Providers and engines by name."""

    held: dict[str, Provider] = field(default_factory=dict)

    def add(self, name: str, provider: Provider) -> None:
        self.held[name] = provider

    def run_all(self, asked: DataFrame, names: list[str]) -> DataFrame:
        """The answers of several engines, one after the other with the column engine; an unknown engine yields error rows."""
        parts = []
        for name in names:
            if name in self.held:
                parts.append(self.held[name](asked).withColumn("engine", F.lit(name)))
            else:
                parts.append(asked.withColumn("error", F.lit(f"no engine {name}")).withColumn("engine", F.lit(name)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out


@dataclass(frozen=True)
class Options:
    """What a request may set; the defaults are the whole contract."""

    language: str = "he"
    tempo: float = 0.85
    expected_speakers: int | None = 2
    verify: bool = True
    rescue: bool = False
    max_regions: int = 80
    hesitation_cap: int = 60
    hesitation_prob: float = 0.78
    opening_scrutiny_sec: float = 30.0
    opening_hesitation_prob: float = 0.88
    arbitrate: str = "a"
    studio: bool = False
    engines: tuple[str, ...] = ("local",)
