"""The composed call: responses in, transcripts, verdicts and a batch report out."""

import json

from parlance import calls


def response(*segments):
    """Segments of (speaker, words); words last half a second each, a second lies between segments."""
    out, at = [], 0.0
    for speaker, said in segments:
        words = []
        for w in said.split():
            words.append({"word": w, "start": at, "end": at + 0.5, "speaker": speaker, "probability": 0.9})
            at += 0.5
        out.append({"text": said, "start": words[0]["start"], "end": at, "speakers": [speaker], "words": words})
        at += 1.0
    return json.dumps({"result": [[{"type": "segments", "data": out}]]})


TALK = (("b", "hello there my friend."), ("a", "how are you today? fine thanks and you sir."), ("b", "good to hear that."))


def made(spark, **more):
    rows = [("x", response(*TALK), None), ("y", json.dumps({"result": []}), None), ("z", None, "timed out"), ("w", response(("a", "one two three four five six.")), None)]
    return calls.transcribe_report(spark.createDataFrame(rows, "call_id string, output string, error string"), **more)


def test_responses_to_transcripts(spark):
    done = made(spark)
    turns = done.turns.filter("call_id = 'x'").orderBy("start").collect()
    assert [(r.speaker, r.text, r.n_words) for r in turns] == [("SPEAKER_00", TALK[0][1], 4), ("SPEAKER_01", TALK[1][1], 9), ("SPEAKER_00", TALK[2][1], 4)]
    files = {r.file: r for r in done.files.collect()}
    assert {k: r.status for k, r in files.items()} == {"w": "ok", "x": "ok", "y": "failed", "z": "failed"}
    assert files["y"].error == "no words in the response" and files["z"].error == "timed out"
    assert (files["x"].buried, files["x"].candidate, files["w"].verdict) == (1, "worker", "one-sided")
    page = done.markdown().first().value
    assert page.startswith("2 files read, 0 clean, 1 flagged, 2 failed") and "- z: timed out" in page and "### x" in page
    assert done.texts({"SPEAKER_00": "Ann"}).filter("call_id = 'x'").first().value.count("Ann:") == 2
    assert "SPEAKER_01: how are you" in done.subtitles().filter("call_id = 'x'").first().value


def test_the_better_labelling_is_chosen(spark):
    """The second diarizer's candidate hands the buried answer over, so it has no buried one and wins."""
    spoken = [("x", 0, 0.0, 2.6, "p"), ("x", 1, 3.0, 7.6, "q"), ("x", 2, 8.0, 11.0, "p")]
    done = made(spark, segments=spark.createDataFrame(spoken, "call_id string, seg_idx int, start double, end double, speaker string"))
    assert {(r.call_id, r.candidate) for r in done.candidates.collect()} == {("x", "worker"), ("x", "segments"), ("w", "worker")}
    files = {r.file: r for r in done.files.collect()}
    assert (files["x"].candidate, files["x"].buried, files["w"].candidate) == ("segments", 0, "worker")
    texts = [r.text for r in done.turns.filter("call_id = 'x'").orderBy("start").collect()]
    assert texts == ["hello there my friend.", "how are you today?", "fine thanks and you sir. good to hear that."]


def test_times_return_to_the_full_clock(spark):
    spans = spark.createDataFrame([("x", 0, 10.0, 12.5), ("x", 1, 20.0, 40.0), ("w", 0, 5.0, 30.0)], "call_id string, span_idx int, start double, end double")
    starts = [r.start for r in made(spark, spans=spans).turns.filter("call_id = 'x'").orderBy("start").collect()]
    assert starts == [10.0, 20.5, 26.0]


def test_surplus_speakers_are_folded_with_their_words(spark):
    said = (("a", " ".join(["word"] * 30) + "."), ("c", "oh."), ("b", " ".join(["other"] * 30) + "."))
    done = calls.transcribe_report(spark.createDataFrame([("k", response(*said))], "call_id string, output string"))
    rows = done.turns.orderBy("start").collect()
    assert {r.speaker for r in rows} == {"SPEAKER_00", "SPEAKER_01"} and sum(r.n_words for r in rows) == 61 and any("oh." in r.text for r in rows)


def test_no_responses(spark):
    done = calls.transcribe_report(spark.createDataFrame([], "call_id string, output string"))
    assert done.turns.count() == 0 and done.files.count() == 0
