"""Schemas of the interval tables. Times are seconds as DOUBLE; (call_id, idx) orders every table."""

WORDS = "call_id string, idx int, word string, start double, end double, speaker string, probability double"
TURNS = "call_id string, turn_id int, speaker string, start double, end double, text string"
SEGMENTS = "call_id string, seg_idx int, start double, end double, speaker string"
SPANS = "call_id string, span_idx int, start double, end double"
VECTORS = "call_id string, win_idx int, time double, vec array<float>, label int"
TRACKS = "call_id string, frame_idx int, probs array<double>"
FRAMES = "call_id string, frame_idx int, samples array<float>"
EDITS = "call_id string, i int, speaker string, split array<struct<text:string,speaker:string>>"
DISAGREEMENTS = (
    "call_id string, d_idx int, start double, end double, label_a string, text_a string, label_b string, text_b string,"
    " kept string, prob_a double, prob_b double, hesitation boolean, resolved string, out_word_ids array<int>"
)
UNKNOWN_SPEAKER = "UNKNOWN"
