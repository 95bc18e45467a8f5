import json

import numpy as np
from pyspark.sql import functions as F

from parlance import providers
from parlance.operators import embeddings as V
from parlance.operators import signal as S
from parlance.sources import readers, sinks

RATE = 16000


def tone(seconds=1.0, hz=440.0, level=0.5):
    return (level * np.sin(2 * np.pi * hz * np.arange(int(seconds * RATE)) / RATE)).astype(np.float32)


def test_wav_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", tone().tolist(), RATE)], "call_id string, samples array<float>, rate int")
    data = rows.select(sinks.wav_bytes("samples", "rate").alias("content")).first().content
    (tmp_path / "b.wav").write_bytes(bytes(data))
    (tmp_path / "a.WAV").write_bytes(b"broken")
    (tmp_path / "a.16k.wav").write_bytes(bytes(data))
    (tmp_path / "notes.txt").write_text("x")
    files = readers.recordings(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in files.orderBy("path").collect()] == ["a.WAV", "b.wav"]
    profiled = files.withColumn("profile", readers.wav_profile("content"))
    good, bad = readers.preflight(profiled)
    row = good.select("profile.*").first()
    assert (row.sample_rate, row.channels, row.bits, round(row.duration_sec, 3)) == (RATE, 1, 16, 1.0) and bad.count() == 1
    heard = files.select("path", readers.mono_16k("content").alias("m")).orderBy("path").collect()
    assert heard[0].m.samples is None and np.allclose(heard[1].m.samples, tone(), atol=1e-3)
    assert len(set(files.filter("path like '%b.wav'").select(readers.raw_samples("content").alias("x")).first().x)) > 100


def test_worker_response(spark):
    word = {"word": " hi ", "start": 0, "end": 1, "speaker": "B", "probability": 0.9}
    events = [{"type": "segments", "data": [{"text": "hi there", "start": 0, "end": 2, "speakers": ["A"], "words": [word, {"word": "there", "start": 1, "end": 2}]}]}, {"type": "progress", "data": 3}]
    more = [{"type": "segments", "data": {"text": " ", "start": 2, "end": 3, "speakers": [], "words": []}}, {"type": "segments", "data": {"text": "no", "start": 3, "end": 4, "speakers": ["C"], "words": []}}]
    rows = spark.createDataFrame([("a", json.dumps({"result": [events, more]})), ("b", json.dumps([{"result": [events]}]))], "call_id string, output string")
    segments = readers.segment_speakers(readers.response_segments(rows))
    assert {(r.call_id, r.seg_idx, r.text, r.speaker) for r in segments.collect()} == {("a", 0, "hi there", "B"), ("a", 1, "no", "C"), ("b", 0, "hi there", "B")}
    heard = readers.segment_words(readers.response_segments(rows)).filter("call_id = 'a'").orderBy("idx").collect()
    assert [(r.word, r.speaker, r.probability) for r in heard] == [("hi", "B", 0.9), ("there", None, None)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "x.rttm").write_text("SPEAKER f 1 2.5 1.0 <NA> <NA> S1 <NA> <NA>\n;; note\nSPEAKER f 1 0.5 1.0 <NA> <NA> S0\nSPEAKER short\n")
    assert [(r.seg_idx, r.start, r.end, r.speaker) for r in readers.rttm(spark, str(tmp_path / "x.rttm")).orderBy("seg_idx").collect()] == [(0, 0.5, 1.5, "S0"), (1, 2.5, 3.5, "S1")]
    spans = spark.createDataFrame([("c", 1, 3.0, 4.12345), ("c", 0, 1.0, 2.0)], "call_id string, span_idx int, start double, end double")
    value = sinks.timeline_json(spans).first().value
    assert json.loads(value) == {"spans": [{"start": 1.0, "end": 2.0}, {"start": 3.0, "end": 4.123}]}
    (tmp_path / "t.json").write_text(value)
    assert readers.timeline(spark, str(tmp_path / "t.json")).count() == 2
    assert readers.settings("# c\nexport A='1'\nA=2\nB = x=y\n") == {"A": "1", "B": "x=y"}
    calls = spark.createDataFrame([("c",), ("d",)], "call_id string")
    assert readers.todo(spark, calls, str(tmp_path / "none")).count() == 2
    sinks.archive(calls.limit(1), str(tmp_path / "done"))
    assert readers.todo(spark, calls, str(tmp_path / "done")).count() == 1


def test_transcripts(spark):
    rows = [("c", 1, "B", 61.0, 62.5, "a < b", [("a", 0.9), ("<", 0.9), ("b", 0.5)]), ("c", 0, "A", 0.0, 2.0, "hello you", [("hello", 0.5)])]
    turns = spark.createDataFrame(rows, "call_id string, turn_id int, speaker string, start double, end double, text string, words array<struct<word:string,probability:double>>")
    text = sinks.transcript_text(turns, {"A": "Ann"}).first().value
    assert text == "2 turns, 2 speakers, 1:02\n\n[0:00] Ann:\nhello you\n\n[1:01] B:\na < b\n"
    assert sinks.subtitles(turns).first().value == "1\n00:00:00,000 --> 00:00:02,000\nA: hello you\n\n2\n00:01:01,000 --> 00:01:02,500\nB: a < b\n"
    page = sinks.chat_page(turns).first().value
    assert 'dir="rtl"' in page and "a &lt; <u>b</u>" in page and "<u>hello" not in page and page.index("right") < page.index("left")
    body = json.loads(sinks.transcript_json(turns.drop("words")).first().value)
    assert [t["speaker"] for t in body["turns"]] == ["A", "B"]
    words = spark.createDataFrame([("c", 0, "a", 0.0, 1.0), ("c", 1, "b", 1.5, 2.0), ("c", 2, "c", 4.0, 5.0)], "call_id string, idx int, word string, start double, end double")
    assert sinks.timed_lines(words).first().value == "[0:00] a b\n[0:04] c"


def test_providers(spark):
    asked = spark.createDataFrame([("a", 1), ("b", 2)], "call_id string, n int")
    recorded = providers.Recorded(spark.createDataFrame([("a", "hi")], "call_id string, text string"))
    assert {(r.call_id, r.text, r.error) for r in recorded(asked).collect()} == {("a", "hi", None), ("b", None, "no recorded answer")}

    def make():
        def answer(rows):
            if (rows["n"] > 1).any():
                raise TimeoutError("late")
            return rows.assign(text="ok")

        return answer

    called = providers.Called(make, "call_id string, text string")
    assert {r.error for r in called(asked.filter("n = 1")).collect()} == {None} and {r.error for r in called(asked.filter("n = 2")).collect()} == {"late"}
    registry = providers.Registry({"x": recorded})
    assert {(r.engine, r.error) for r in registry.run_all(asked, ["x", "y"]).collect()} == {("x", None), ("x", "no recorded answer"), ("y", "no engine y")}


def test_levels(spark):
    x = np.concatenate([tone(1, level=0.5), tone(1, level=0.0005), tone(1, level=0.05), np.zeros(RATE, np.float32)])
    rows = spark.createDataFrame([("c", x.tolist(), RATE)], "call_id string, samples array<float>, rate int")
    levels = S.frame_levels(S.frames_of(rows, RATE))
    out = S.activity(levels).first()
    assert out.runs == 2 and abs(out.longest_gap - 1.0) < 0.05 and abs(out.digital_silence_pct - 25) < 1
    turns = spark.createDataFrame([("c", 0.0, 1.0, "A"), ("c", 2.0, 3.0, "B")], "call_id string, start double, end double, speaker string")
    y = np.array(S.level_recordings(rows, turns).first().samples)
    loud = lambda v: 20 * np.log10(np.sqrt(np.mean(v**2)))
    assert abs(loud(y[2000:14000]) - loud(y[34000:46000])) < 0.2 and np.abs(y[RATE + 10 : 2 * RATE - 10]).max() < 0.001
    gains = S.speaker_gains(turns.withColumn("db", F.when(F.col("speaker") == "A", -9.0).otherwise(-29.0)))
    assert {(r.speaker, r.gain_db) for r in gains.collect()} == {("A", -11.0), ("B", 9.0)} and S.level_spread(gains).first().after_db == 0


def test_filters_and_channel():
    low, high = tone(hz=300), tone(hz=6000)
    rms = lambda v: float(np.sqrt(np.mean(v[2000:-2000] ** 2)))
    assert rms(S._pass(low, RATE, 3000, 4, False)) > 0.34 and rms(S._pass(high, RATE, 3000, 4, False)) < 0.03
    assert rms(S._pass(low, RATE, 3000, 4, True)) < 0.01 and abs(rms(S.high_shelf(high, RATE)) / rms(high) - 10 ** (9 / 20)) < 0.1
    assert abs(rms(S.high_shelf(tone(hz=50), RATE)) / rms(tone(hz=50)) - 1) < 0.02
    assert np.array_equal(S.degrade(low, RATE, 3), S.degrade(low, RATE, 3)) and len(S.degrade(low, RATE, 3)) == RATE
    assert abs(S.bandwidth(low, RATE) - 300) < 20 and np.abs(S.master(low, RATE)).max() <= 0.98 + 1e-9
    assert len(S.cut_silence(low, RATE, [(0, 0.25), (0.5, 0.75)])) == RATE // 2


def test_treatments(spark):
    rows = spark.createDataFrame([("c", tone(0.5).tolist(), RATE)], "call_id string, samples array<float>, rate int")
    names = spark.createDataFrame([(n,) for n in S.TREATMENTS], "name string")
    out = S.treat(rows, names).collect()
    assert {r.name for r in out} == set(S.TREATMENTS) and all(np.isfinite(r.db) for r in out)


def test_clustering(spark):
    rng = np.random.default_rng(0)
    centre = np.eye(3)
    rows = [("c", i, (centre[i % 3] + 0.05 * rng.normal(size=3)).tolist()) for i in range(30)] + [("d", 0, [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "call_id string, win_idx int, vec array<double>")
    out = V.cluster(vectors).filter("call_id = 'c'").collect()
    assert len({(r.win_idx % 3, r.cluster) for r in out}) == 3 and out[0].separation > 0.9
    assert {r.separation for r in V.cluster(vectors).filter("call_id = 'd'").collect()} == {0.0}


def test_word_stream(spark, tmp_path):
    from parlance.streaming.turns import turns_from_word_stream

    source, schema = tmp_path / "in", "call_id string, idx int, word string, start double, end double, speaker string"
    rows = [("a", 0, "hi", 0.0, 1.0, "A"), ("a", 1, "you", 1.2, 2.0, "A"), ("a", 2, "yes", 3.5, 4.0, "A"), ("a", 3, "no", 4.0, 5.0, "B"), ("a", 4, "so", 5.0, 6.0, "A")]
    spark.createDataFrame(rows[:3], schema).coalesce(1).write.parquet(str(source))
    turns = turns_from_word_stream(spark.readStream.schema(schema).parquet(str(source)))

    def drain():
        """Everything there is by now, then stop; state stays in the checkpoint."""
        sink = turns.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
        q = sink.trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(90)
        finally:
            q.stop()

    drain()
    spark.createDataFrame(rows[3:], schema).coalesce(1).write.mode("append").parquet(str(source))
    drain()
    got = sorted((r.turn_id, r.speaker, r.start, r.end, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "A", 0.0, 2.0, "hi you"), (1, "A", 3.5, 4.0, "yes"), (2, "B", 4.0, 5.0, "no")]


def test_seeds_differ_by_recording(spark):
    sound = (0.3 * np.random.default_rng(1).standard_normal(RATE)).tolist()
    rows = spark.createDataFrame([("a", RATE, sound), ("b", RATE, sound)], "call_id string, rate int, samples array<float>")
    names = spark.createDataFrame([("degrade",)], "name string")
    one, two = [{r.call_id: r.samples for r in S.treat(x, names).collect()} for x in (rows, rows.orderBy("call_id", ascending=False))]
    assert one == two and one["a"] != one["b"]
    takes = {S.take_of(k) for k in range(200)}
    assert len(takes) == 200 and 60 < sum(t.room_sec > 0 for t in takes) < 140 and all(-34 <= t.loudness_db <= -12 for t in takes)
    steps = S.recorded_8_bit(0.3 * np.sin(np.arange(RATE)), RATE, 1) * 128
    assert np.array_equal(steps, np.round(steps)) and not S.recorded_8_bit(np.full(RATE, 1e-3), RATE, 1).any()


def test_tempo_keeps_pitch():
    x = tone(2.0).astype(float)
    slow = S.at_tempo(x, RATE, 0.8)
    assert abs(len(slow) / len(x) - 1.25) < 0.05
    peak = lambda y: np.argmax(np.abs(np.fft.rfft(y))) * RATE / len(y)
    assert abs(peak(slow) - 440) < 5 and len(S.at_tempo(x[:10], RATE, 0.8)) == 10


def wav(values, width, channels=1):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(RATE)
        w.writeframes(b"".join(int(v).to_bytes(width, "little", signed=width > 1) for v in values))
    return out.getvalue()


def test_raw_samples_of_every_depth(spark):
    held = {1: [0, 128, 255], 2: [-32768, 5, 32767], 3: [-(1 << 23), -1, (1 << 23) - 1], 4: [-(1 << 31), 7, (1 << 31) - 1]}
    rows = [(k, wav(v, k)) for k, v in held.items()] + [(5, b"broken"), (6, None), (7, wav([1, 2], 2)[:-1])]
    got = {r.k: r.x for r in spark.createDataFrame(rows, "k int, content binary").select("k", readers.raw_samples("content").alias("x")).collect()}
    assert {k: got[k] for k in held} == held and got[5] is None and got[6] is None and got[7] == [1]


def test_failover_and_waits(spark):
    asked = spark.createDataFrame([(f"c{k}", k) for k in range(6)], "call_id string, n int").coalesce(1)

    def spent():
        def answer(rows):
            raise providers.Exhausted("quota")

        return answer

    def late():
        state = []

        def answer(rows):
            state.append(1)
            if len(state) < 3:
                raise TimeoutError("later")
            return rows[["call_id"]].assign(text="late")

        return answer

    quick = lambda attempt, error: 0.0
    called = providers.Called(spent, "call_id string, text string", others=(late,), wait=quick)
    assert {(r.text, r.error) for r in called(asked).collect()} == {("late", None)}
    called = providers.Called(spent, "call_id string, text string", others=(spent,), wait=quick)
    assert {(r.call_id, r.text) for r in called(asked).collect()} == {(f"c{k}", None) for k in range(6)}
    error = TimeoutError()
    error.retry_after = 900
    assert providers.waits_of(1, TimeoutError()) == 16.0 and providers.waits_of(0, error) == 180.0


def test_carried_prompt(spark):
    windows = spark.createDataFrame([(c, k, 3) for c in "ab" for k in (2, 0, 1)], "call_id string, window int, n int")
    make = lambda: lambda row, prompt: [f"{row['call_id']}{row['window']}{i}" for i in range(row["n"])]
    got = {(r.call_id, r.window): r.prompt for r in providers.with_carried_prompt(windows, make, tail=4).collect()}
    assert got["a", 0] is None and got["b", 1] == "b00 b01 b02" and got["a", 2] == "a02 a10 a11 a12"


def test_unsure_answers_change_nothing(spark):
    from parlance.operators import consensus as C

    words = spark.createDataFrame([("c", k, w, float(k), k + 1.0, 0.9) for k, w in enumerate("one two three".split())], "call_id string, idx int, word string, start double, end double, probability double")
    answers = spark.createDataFrame([("c", 0, [1], "TWO", 0.49), ("c", 1, [2], "THREE", 0.5), ("c", 2, [0], "ONE", None)], "call_id string, d_idx int, out_word_ids array<int>, text string, confidence double")
    assert [r.word for r in C.splice(words, answers).orderBy("start").collect()] == ["one", "two", "THREE"]
