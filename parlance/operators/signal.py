"""Sound operators: levels, activity, damage, levelling, mastering, channel simulation.

Numbers of a call are windows and aggregates over frames. Work on samples is numpy
in Arrow batches, one recording at a time, filters being applied in the
frequency domain.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.levels import bimodality, clip, decibels, effective_bits, rms, spread
from .intervals import KEYS, sound_runs

TARGET_DB, MOST_GAIN_DB, MOST_CUT_DB, LEAST_SEGMENT, FADE = -20.0, 18.0, 12.0, 0.20, 0.030


def frames_of(recordings: DataFrame, rate: int, frame_sec: float = 0.02, keys=KEYS) -> DataFrame:
    """(keys, frame_idx, samples): whole frames of a samples array."""
    n = int(rate * frame_sec)
    whole = F.floor(F.size("samples") / n).cast("int")
    at = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
    rows = recordings.select(*keys, "samples", F.explode(at).alias("frame_idx"))
    return rows.select(*keys, "frame_idx", F.slice("samples", F.col("frame_idx") * n + 1, n).alias("samples"))


def frame_levels(frames: DataFrame) -> DataFrame:
    return frames.withColumn("rms", rms(F.col("samples"))).withColumn("db", decibels(F.col("rms")))


def energy_gate(levels: DataFrame, above: float = 6.0, silence: float = -80.0, keys=KEYS) -> DataFrame:
    """levels with voiced: louder by more than `above`, whatever the floating-point remainder, than the 20th percentile of the call's frames that aren't silent."""
    floor = levels.groupBy(*keys).agg(F.percentile(F.when(F.col("db") > silence, F.col("db")), F.lit(0.2)).alias("_floor"))
    return levels.join(floor, list(keys)).withColumn("voiced", F.coalesce(F.round(F.col("db") - F.col("_floor"), 6) > above, F.lit(False))).drop("_floor")


def activity(levels: DataFrame, frame_sec: float = 0.02, silence: float = -80.0, keys=KEYS) -> DataFrame:
    """Per call: speech share, runs, longest pause, signal-to-noise spread, digital silence in percent, bimodality."""
    gated = energy_gate(levels, keys=keys, silence=silence)
    runs = sound_runs(gated, F.col("voiced"), frame_sec, keys=keys)
    w = Window.partitionBy(*keys).orderBy("run")
    runs = runs.withColumn("_pause", F.col("start") - F.lag("end").over(w))
    speech = runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("speech_sec"), F.round(F.coalesce(F.max("_pause"), F.lit(0.0)), 3).alias("longest_gap"))
    medians = gated.groupBy(*keys).agg(F.percentile("db", F.lit(0.5)).alias("_median"))
    totals = gated.join(medians, list(keys)).groupBy(*keys).agg(
        (F.count("*") * frame_sec).alias("total_sec"),
        F.round(F.coalesce(spread(F.when(F.col("db") > silence, F.col("db"))), F.lit(0.0)), 3).alias("snr_db"),
        F.round(100 * F.avg((F.col("db") <= silence).cast("double")), 2).alias("digital_silence_pct"),
        F.round(bimodality(F.col("db"), F.col("_median")), 3).alias("bimodality"),
    )
    out = totals.join(speech, list(keys), "left").fillna(0)
    return out.withColumn("speech_ratio", F.round(F.col("speech_sec") / F.col("total_sec"), 4))


def clipped_runs(samples: DataFrame, level: float = 0.999, least: int = 3, keys=KEYS) -> DataFrame:
    """(keys, runs, clipped): runs of at least `least` neighbouring samples (keys, pos, x) at or over the level."""
    hits = samples.filter(F.abs("x") >= level).select(*keys, "pos")
    # Neighbours share the difference of their place and their rank.
    run = F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    runs = hits.withColumn("_run", run).groupBy(*keys, "_run").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.sum("n").alias("clipped"))


def level_counts(samples: DataFrame, keys=KEYS) -> DataFrame:
    """Distinct levels and the bits that they are worth, of samples (keys, x) at their own depth."""
    return samples.groupBy(*keys).agg(F.count_distinct("x").alias("levels"), F.round(effective_bits(F.col("x")), 3).alias("bits"))


def channel_relation(samples: DataFrame, keys=KEYS) -> DataFrame:
    """Correlation of two channels (keys, left, right): dual-mono over 0.98, else true-stereo."""
    out = samples.groupBy(*keys).agg(F.round(F.corr("left", "right"), 4).alias("correlation"))
    return out.withColumn("relation", F.when(F.col("correlation") > 0.98, "dual-mono").otherwise("true-stereo"))


def energy_bandwidth(bins: DataFrame, share: float = 0.99, keys=KEYS) -> DataFrame:
    """The first frequency up to which `share` of the energy (keys, hz, power) lies."""
    w = Window.partitionBy(*keys).orderBy("hz")
    upto = F.sum("power").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("power").over(Window.partitionBy(*keys))
    return bins.withColumn("_upto", F.round(upto, 12)).filter(F.col("_upto") >= share).groupBy(*keys).agg(F.min("hz").alias("bandwidth_hz"))


def narrowband(bandwidth: Column) -> Column:
    return bandwidth < 4200


def smooth(levels: DataFrame, column: str = "gain", keys=KEYS, idx: str = "frame_idx") -> DataFrame:
    """levels with column smoothed by 1/4, 1/2, 1/4; beyond the ends lies 0."""
    w = Window.partitionBy(*keys).orderBy(idx)
    x = F.col(column)
    return levels.withColumn(column, 0.25 * F.lag(x, 1, 0.0).over(w) + 0.5 * x + 0.25 * F.lead(x, 1, 0.0).over(w))


def profile_notes() -> Column:
    """Warnings on a profile row: codec, sample_rate, bit_rate, bandwidth_hz, peak_db, mean_db, channels, relation, clipped, bits."""
    rules = {
        "narrowband: the sound ends below 4.2 kHz": narrowband(F.col("bandwidth_hz")),
        "clipped samples": F.col("clipped") > 0,
        "quiet recording": F.col("mean_db") < -35,
        "peaks at full scale": F.col("peak_db") > -0.1,
        "low bit rate": F.col("bit_rate") < 24000,
        "low sample rate": F.col("sample_rate") < 16000,
        "two equal channels": F.col("relation") == "dual-mono",
        "few effective bits": F.col("bits") < 7,
    }
    return F.array_compact(F.array(*(F.when(rule, text) for text, rule in rules.items())))


def speaker_gains(segments: DataFrame, target: float = TARGET_DB, keys=KEYS) -> DataFrame:
    """(keys, speaker, median_db, gain_db) from levels of segments (keys, speaker, start, end, db); calls with one speaker get none.

    The gain takes a speaker's median to the target within -12 and +18 dB; segments
    under 0.2 seconds don't count.
    """
    long = segments.filter(F.round(F.col("end") - F.col("start"), 9) >= LEAST_SEGMENT)
    out = long.groupBy(*keys, "speaker").agg(F.percentile("db", F.lit(0.5)).alias("_m"))
    out = out.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n >= 2")
    return out.select(*keys, "speaker", F.round("_m", 4).alias("median_db"), F.round(clip(target - F.col("_m"), -MOST_CUT_DB, MOST_GAIN_DB), 4).alias("gain_db"))


def level_spread(gains: DataFrame, keys=KEYS) -> DataFrame:
    """Spread of the speakers' medians before and after their gains."""
    after = F.col("median_db") + F.col("gain_db")
    return gains.groupBy(*keys).agg(F.round(F.max("median_db") - F.min("median_db"), 3).alias("before_db"), F.round(F.max(after) - F.min(after), 3).alias("after_db"))


def peak_gain(peak_db: Column, target: float = -1.0, least: float = 0.5, most: float = 20.0) -> Column:
    """Gain that takes the peak to the target: none under `least`, `most` at most."""
    gain = target - peak_db
    return F.when(gain > least, F.least(gain, F.lit(most))).otherwise(0.0)


# ---- samples ---------------------------------------------------------------------------


def _db(x: np.ndarray) -> float:
    return float(20 * np.log10(np.sqrt(np.mean(np.square(x, dtype=np.float64))) + 1e-12)) if x.size else -120.0


def _filtered(x: np.ndarray, response) -> np.ndarray:
    """x through a filter given by its response at angular frequencies 0..pi, with room for its tail."""
    n = 1 << int(np.ceil(np.log2(2 * len(x) + 2)))
    return np.fft.irfft(np.fft.rfft(x, n) * response(np.linspace(0, np.pi, n // 2 + 1)), n)[: len(x)]


def _pass(x: np.ndarray, rate: int, hz: float, order: int, high: bool) -> np.ndarray:
    """Butterworth low- or high-pass by the bilinear transform."""

    def response(w: np.ndarray) -> np.ndarray:
        s = 1j * np.tan(np.minimum(w, np.pi * (1 - 1e-9)) / 2) / np.tan(np.pi * min(hz / rate, 0.475))
        s = 1 / np.where(s == 0, 1e-12, s) if high else s
        poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
        return 1 / np.prod([s - p for p in poles], axis=0)

    return _filtered(x, response)


def _resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    if rate == to or not len(x):
        return x
    n = round(len(x) * to / rate)
    spec = np.fft.rfft(x)
    out = np.zeros(n // 2 + 1, complex)
    keep = min(len(spec), len(out))
    out[:keep] = spec[:keep]
    return np.fft.irfft(out, n) * (n / len(x))


def _gained(x: np.ndarray, rate: int, parts: list[tuple[float, float, float]]) -> np.ndarray:
    """x with a gain in dB over each (start, end), ramped over 30 ms at both ends; scaled down if it would clip."""
    out = x.astype(np.float64)
    for start, end, gain_db in parts:
        a, b = max(0, int(start * rate)), min(len(x), int(end * rate))
        if b <= a or abs(gain_db) < 0.5:
            continue
        gain, edge = 10 ** (gain_db / 20), min(max(1, int(FADE * rate)), (b - a) // 2)
        shape = np.full(b - a, gain)
        if edge:
            shape[:edge] = np.linspace(1, gain, edge)
            shape[-edge:] = np.linspace(gain, 1, edge)
        out[a:b] *= shape
    peak = np.abs(out).max(initial=0.0)
    return out * (0.999 / peak) if peak > 0.999 else out


def level_by_speaker(x: np.ndarray, rate: int, turns: list[tuple[float, float, str]], target: float = TARGET_DB) -> np.ndarray:
    """One gain for each speaker, from the median level of his or her turns (start, end, speaker); as it is with fewer than two."""
    levels: dict[str, list[float]] = {}
    for start, end, who in turns:
        part = x[max(0, int(start * rate)) : int(end * rate)]
        if len(part) >= int(LEAST_SEGMENT * rate):
            levels.setdefault(who, []).append(_db(part))
    if len(levels) < 2:
        return x
    gain = {who: float(np.clip(target - np.median(v), -MOST_CUT_DB, MOST_GAIN_DB)) for who, v in levels.items()}
    return _gained(x, rate, [(s, e, gain.get(who, 0.0)) for s, e, who in turns])


def level_spans(x: np.ndarray, rate: int, spans: list[tuple[float, float]], target: float = TARGET_DB) -> np.ndarray:
    """A gain for each speech span of its own; silence between them stays."""
    parts = [(s, e, x[max(0, int(s * rate)) : int(e * rate)]) for s, e in spans]
    return _gained(x, rate, [(s, e, float(np.clip(target - _db(p), -MOST_CUT_DB, MOST_GAIN_DB))) for s, e, p in parts if len(p) >= int(LEAST_SEGMENT * rate)])


def subtract_floor(x: np.ndarray, floor_db: float = -53.0, alpha: float = 2.0, size: int = 512, hop: int = 128) -> np.ndarray:
    """Spectral subtraction of an even noise floor, a tenth of each bin staying at least."""
    padded = np.pad(x, (0, size + (-len(x)) % hop))
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    window = np.hanning(size)
    spec = np.fft.rfft(frames * window, axis=1)
    mag = np.abs(spec)
    floor = alpha * 10 ** (floor_db / 20) * np.sqrt(size)
    scale = np.maximum(mag - floor, 0.1 * mag) / np.maximum(mag, 1e-12)
    parts = np.fft.irfft(spec * scale, size, axis=1) * window
    out, weight = np.zeros(len(padded)), np.zeros(len(padded))
    for k in range(len(parts)):
        out[k * hop : k * hop + size] += parts[k]
        weight[k * hop : k * hop + size] += window**2
    return (out / np.maximum(weight, 1e-6))[: len(x)]


def syllable_gain(x: np.ndarray, rate: int, target: float = -20.0, frame_sec: float = 0.05, most: float = 24.0) -> np.ndarray:
    """Each 50 ms frame, and what is left over at the end, raised towards the target and never lowered; gains are smoothed over three frames."""
    starts = np.arange(0, len(x), max(1, int(rate * frame_sec)))
    if len(x) < max(1, int(rate * frame_sec)):
        return x
    sizes = np.diff(starts, append=len(x))
    power = np.add.reduceat(np.square(x), starts) / sizes
    raised = np.power(10.0, np.clip(target - 10 * np.log10(power + 1e-18), 0, most) / 20)
    beside = np.concatenate([raised[:1], raised, raised[-1:]])
    smooth = (beside[:-2] + 2 * raised + beside[2:]) / 4
    return _limited(x * np.repeat(smooth, sizes))


def _limited(x: np.ndarray, most: float = 0.999) -> np.ndarray:
    """x with its samples held within most."""
    return np.minimum(np.maximum(x, -most), most)


def _scaled_under(x: np.ndarray, most: float) -> np.ndarray:
    """x made quieter as a whole if its peak is over most."""
    return x / max(1.0, float(np.max(np.abs(x), initial=0.0)) / most)


def high_shelf(x: np.ndarray, rate: int, hz: float = 2000.0, gain_db: float = 9.0) -> np.ndarray:
    """Second-order shelf of slope 1: its response is that of the analogue (A s^2 + sqrt(2A) s + 1) form, scaled, at the warped frequency."""
    a = 10 ** (gain_db / 40)

    def response(w: np.ndarray) -> np.ndarray:
        s = 1j * np.tan(np.minimum(w, np.pi * (1 - 1e-9)) / 2) / np.tan(np.pi * hz / rate)
        q = np.sqrt(a) * np.sqrt(2)
        return a * (a * s**2 + q * s + 1) / (s**2 + q * s + a)

    return _filtered(x, response)


def excite(x: np.ndarray, rate: int, amount: float = 0.35) -> np.ndarray:
    """Adds the treble of the overdriven sound."""
    return np.clip(x + amount * _pass(np.tanh(4 * x), rate, 2000.0, 4, True), -0.999, 0.999)


#: The steps of mastering, in their order.
MASTERING = (lambda x, rate: subtract_floor(x), syllable_gain, high_shelf, excite)


def master(x: np.ndarray, rate: int) -> np.ndarray:
    """All steps of MASTERING, with peaks under 0.98."""
    for step in MASTERING:
        x = step(x, rate)
    return _scaled_under(x, 0.98)


@dataclass(frozen=True)
class Line:
    """A telephone line with its recorder. The defaults are fixed values.

    Rates; the passband and the orders of its filters; loudness (its median, spread
    and bounds, and how often and how much a line is quiet); how often a room
    sounds along and how long; noise and squelch in steps of 8 bits.
    """

    rate: int = 11025
    rate_out: int = 16000
    passband: tuple[float, float] = (120.0, 3700.0)
    orders: tuple[int, int] = (2, 6)
    loudness_db: tuple[float, float] = (-18.0, 6.5)
    bounds_db: tuple[float, float] = (-34.0, -12.0)
    quiet: tuple[float, float] = (0.25, -12.0)
    room_chance: float = 0.5
    room_sec: tuple[float, ...] = (0.25, 0.4, 0.8, 1.4)
    noise_steps: float = 0.84
    squelch_steps: float = 1.5
    squelch_sec: float = 0.006


OUT_RATE = Line().rate_out


@dataclass(frozen=True)
class Take:
    """What chance decides about one recording: loudness, reverberation (0: none), and the seeds of two noises."""

    loudness_db: float
    room_sec: float
    noises: tuple[int, int]


def take_of(seed: int, line: Line = Line()) -> Take:
    """The take of a seed. Each decision has its own stream, so one more decision leaves the others as they are."""
    loud, quiet, room, noise = (np.random.default_rng([seed, k]) for k in range(4))
    level = loud.normal(*line.loudness_db)
    if quiet.uniform() < line.quiet[0]:
        level += line.quiet[1]
    low, high = line.bounds_db
    heard = room.uniform() < line.room_chance
    return Take(min(max(level, low), high), float(line.room_sec[room.integers(len(line.room_sec))]) if heard else 0.0, tuple(noise.integers(2**31, size=2).tolist()))


def in_room(x: np.ndarray, rate: int, decay_sec: float, seed: int) -> np.ndarray:
    """x as heard in a room whose echo falls by 60 dB in decay_sec."""
    if not decay_sec or not len(x):
        return x
    late = np.random.default_rng(seed).normal(size=max(1, int(rate * decay_sec))) * np.logspace(0, -3, max(1, int(rate * decay_sec)))
    late[0] = 0.0
    size = len(x) + len(late)
    echo = np.fft.irfft(np.fft.rfft(late, size) * np.fft.rfft(x, size), size)[: len(x)]
    strength = np.sqrt(np.mean(x**2) / max(np.mean(echo**2), 1e-24))
    return x + 0.5 * strength * echo


def recorded_8_bit(x: np.ndarray, rate: int, seed: int, line: Line = Line()) -> np.ndarray:
    """x with the line's noise, in 256 steps, and silent wherever a short stretch is under the squelch."""
    half = 128
    steps = np.floor(half * _limited(x, 1.0) + np.random.default_rng(seed).normal(scale=line.noise_steps / 3, size=len(x)) + 0.5)
    steps = np.clip(steps, -half, half - 1)
    starts = np.arange(0, len(x), max(1, int(rate * line.squelch_sec)))
    if len(x):
        sizes = np.diff(starts, append=len(x))
        loud = np.add.reduceat(steps**2, starts) >= sizes * line.squelch_steps**2
        steps = np.where(np.repeat(loud, sizes), steps, 0.0)
    return steps / half


def degrade(x: np.ndarray, rate: int, seed: int = 0, line: Line = Line()) -> np.ndarray:
    """Clean sound as a telephone recorder of 8 bits would have it, at the line's outer rate; equal seeds give equal results."""
    take = take_of(seed, line)
    x = in_room(_resample(np.asarray(x, np.float64), rate, line.rate), line.rate, take.room_sec, take.noises[0])
    for hz, order, high in zip(line.passband, line.orders, (True, False)):
        x = _pass(x, line.rate, hz, order, high)
    if len(x):
        x = x * 10 ** ((take.loudness_db - _db(x)) / 20)
    return _scaled_under(_resample(recorded_8_bit(x, line.rate, take.noises[1], line), line.rate, line.rate_out), 0.999)


def bandwidth(x: np.ndarray, rate: int, share: float = 0.99, size: int = 32768) -> float:
    """Hz below which `share` of the energy lies, over four windows spread through the recording."""
    n = min(size, len(x))
    if n < 2:
        return 0.0
    window = np.hanning(n)
    power = np.zeros(n // 2 + 1)
    for at in (0.15, 0.35, 0.55, 0.75):
        start = min(int(len(x) * at), len(x) - n)
        power += np.abs(np.fft.rfft(x[start : start + n] * window)) ** 2
    upto = np.cumsum(power)
    return float(np.searchsorted(upto, share * upto[-1]) * rate / n) if upto[-1] > 0 else 0.0


def cut_silence(x: np.ndarray, rate: int, spans: list[tuple[float, float]]) -> np.ndarray:
    return np.concatenate([x[int(s * rate) : int(e * rate)] for s, e in spans]) if spans else x[:0]


#: Treatments by name, of samples, rate and a seed that differs by recording.
TREATMENTS = {
    "none": lambda x, rate, seed: x,
    "peak": lambda x, rate, seed: peak_normalised(x),
    "floor": lambda x, rate, seed: subtract_floor(x),
    "syllables": lambda x, rate, seed: syllable_gain(x, rate),
    "shelf": lambda x, rate, seed: high_shelf(x, rate),
    "exciter": lambda x, rate, seed: excite(x, rate),
    "narrowband": lambda x, rate, seed: _pass(_pass(x, rate, 300.0, 2, True), rate, 3400.0, 6, False),
    "clipped": lambda x, rate, seed: _limited(4 * x),
    "quiet": lambda x, rate, seed: x * 10 ** (Line().quiet[1] / 20),
    "eight_bits": lambda x, rate, seed: recorded_8_bit(x, rate, seed),
    "room": lambda x, rate, seed: in_room(x, rate, 0.4, seed),
    "slower": lambda x, rate, seed: at_tempo(x, rate, 0.85),
    "faster": lambda x, rate, seed: at_tempo(x, rate, 1.15),
    "master": lambda x, rate, seed: master(x, rate),
    "master_peak": lambda x, rate, seed: peak_normalised(master(x, rate)),
    "degrade": lambda x, rate, seed: degrade(x, rate, seed),
    "degrade_master": lambda x, rate, seed: master(degrade(x, rate, seed), OUT_RATE),
}


def peak_normalised(x: np.ndarray, peak: float = 0.95) -> np.ndarray:
    """x scaled so that its largest sample is at peak; silence stays."""
    top = float(np.max(np.abs(x), initial=0.0))
    return x * (peak / top) if top > 0 else x


def at_tempo(x: np.ndarray, rate: int, tempo: float, frame_sec: float = 0.04) -> np.ndarray:
    """x played at another tempo with its pitch kept: windowed frames are laid down at even steps, each taken where it fits the last one best."""
    size = max(4, int(rate * frame_sec)) // 2 * 2
    hop = size // 2
    if len(x) < 2 * size or tempo <= 0:
        return x
    n = max(1, int((len(x) - size) / (hop * tempo)))
    window, seek = np.hanning(size + 1)[:size], hop // 2
    out, weight = np.zeros((n + 1) * hop + size), np.zeros((n + 1) * hop + size)
    wanted = x[:size]
    for k in range(n):
        near = int(k * hop * tempo)
        low, high = max(0, near - seek), min(len(x) - size, near + seek)
        places = np.lib.stride_tricks.sliding_window_view(x[low : high + size], size)
        at = low + int(np.argmax(places @ wanted)) if k and high > low else min(near, len(x) - size)
        out[k * hop : k * hop + size] += window * x[at : at + size]
        weight[k * hop : k * hop + size] += window
        wanted = np.pad(x[at + hop : at + hop + size], (0, max(0, at + hop + size - len(x))))
    return (out / np.maximum(weight, 1e-3))[: int(len(x) / tempo)]


def seed_of(key: tuple) -> int:
    """A recording's own seed, from its key."""
    return zlib.crc32("\x1f".join(map(str, key)).encode())


def treat(recordings: DataFrame, treatments: DataFrame, keys=KEYS) -> DataFrame:
    """Every recording (keys, rate, samples) by every treatment (name, one of TREATMENTS) of a parameter table: keys, name, samples, db, bandwidth_hz."""
    kinds = ", ".join(f"{c} {recordings.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches):
        for rows in batches:
            seeds = [seed_of(key) for key in zip(*(rows[c] for c in keys))]
            out = [TREATMENTS[n](np.asarray(x, float), int(r), s) for x, r, n, s in zip(rows["samples"], rows["rate"], rows["name"], seeds)]
            yield rows[[*keys, "name"]].assign(
                samples=[o.astype("float32") for o in out], db=[_db(o) for o in out], bandwidth_hz=[bandwidth(o, OUT_RATE if n.startswith("degrade") else int(r)) for o, r, n in zip(out, rows["rate"], rows["name"])]
            )

    rows = recordings.select(*keys, "rate", "samples").crossJoin(F.broadcast(treatments.select("name")))
    return rows.mapInPandas(run, f"{kinds}, name string, samples array<float>, db double, bandwidth_hz double")


def level_recordings(recordings: DataFrame, turns: DataFrame, keys=KEYS) -> DataFrame:
    """recordings with samples levelled by speaker; turns: keys, start, end, speaker."""
    grouped = turns.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", "speaker"))).alias("_turns"))
    rows = recordings.join(grouped, list(keys), "left")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def levelled(samples: pd.Series, rate: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series(
            [level_by_speaker(np.asarray(x, float), int(r), [(t["start"], t["end"], t["speaker"]) for t in p] if p is not None else []).astype("float32") for x, r, p in zip(samples, rate, parts)]
        )

    return rows.withColumn("samples", levelled("samples", "rate", "_turns")).select(*recordings.columns)
