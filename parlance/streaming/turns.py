"""Turns over a stream of words, with the rule of the batch operator.

State per call is the open turn alone. A turn is given out when the next word
closes it, or after a time without words if one is set.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "turn_id long, speaker string, start double, end double, text string, n_words long"
OUTPUT = f"call_id string, {STATE}"


def turns_from_word_stream(words: DataFrame, gap: float = 1.0, timeout_ms: int | None = None) -> DataFrame:
    """Turns of a stream of words (call_id, idx, word, start, end, speaker), appended as they close.

    Words of a call must arrive in order up to a micro-batch, within which they are
    sorted. timeout_ms: processing time without words after which a turn closes. A
    query with one runs batches without data for ever, so it suits only queries
    that don't end; without one a call's last turn stays open.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        now = state.getOption
        if state.hasTimedOut:
            if now is not None:
                done.append(now)
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["start", "idx"])
            for word, start, end, speaker in zip(rows["word"], rows["start"], rows["end"], rows["speaker"]):
                if now is None or now[1] != speaker or round(start - now[3], 9) > gap:
                    if now is not None:
                        done.append(now)
                    now = ((now[0] + 1) if now else 0, speaker, float(start), float(end), word, 1)
                else:
                    now = (now[0], speaker, now[2], float(end), f"{now[4]} {word}", now[5] + 1)
            state.update(now)
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(key[0], *t) for t in done], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return words.groupBy("call_id").applyInPandasWithState(update, OUTPUT, STATE, "append", timeout)


def word_counts(words: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Words by speaker in windows of event time `ts`, late words being dropped beyond the watermark."""
    from pyspark.sql import functions as F

    return words.withWatermark("ts", watermark).groupBy(F.window("ts", window), "speaker").agg(F.count("*").alias("words"), F.avg("probability").alias("confidence"))
