"""Who speaks when: turns from words, votes, folding of minor labels, tails of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import UNKNOWN_SPEAKER
from .intervals import KEYS, along, islands, merge_runs, nearest_segment, to_original


def ordered_text(text: str, *order: str, sep: str = " ") -> Column:
    """An aggregate: texts joined in the order given."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return F.array_join(F.transform(rows, lambda r: r["_text"]), sep)


def turns_from_words(words: DataFrame, gap: float = 1.0, keys=KEYS) -> DataFrame:
    """(keys, turn_id, speaker, start, end, text, n_words): a turn ends where the speaker changes or a pause is over gap seconds.

    The pause is measured from the end of the word before, and a turn ends with its last word.
    """
    w = along(keys)
    begins = ~F.lag("speaker").over(w).eqNullSafe(F.col("speaker")) | (F.round(F.col("start") - F.lag("end").over(w), 9) > gap)
    rows = islands(words, begins, keys, name="turn_id")
    return rows.groupBy(*keys, "turn_id").agg(
        F.min_by("speaker", F.struct("start", "idx")).alias("speaker"),
        F.min("start").alias("start"),
        F.max_by("end", F.struct("start", "idx")).alias("end"),
        ordered_text("word", "start", "idx").alias("text"),
        F.count("*").alias("n_words"),
    )


def segment_speaker(members: DataFrame, keys, label: str = "speaker", idx: str = "idx") -> DataFrame:
    """(keys, label): the most frequent non-null label of each group, the first seen on a tie."""
    counts = members.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"), F.min(idx).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct("_n", -F.col("_first"))).alias(label))


def build_turns(segments: DataFrame, keys=KEYS) -> DataFrame:
    """Neighbouring segments of one speaker as one turn, whatever the pause; a turn ends with its latest segment."""
    named = segments.withColumn("speaker", F.coalesce("speaker", F.lit(UNKNOWN_SPEAKER)))
    return merge_runs(named, None, keys, idx="seg_idx")


def rename_first_seen(rows: DataFrame, keys=KEYS, label: str = "speaker", idx: str = "idx", to: str = "renamed", form: str = "SPEAKER_%02d") -> DataFrame:
    """Adds the label's name by its order of appearance in the call; null stays null."""
    first = rows.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.min(idx).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_first", label)) - 1
    names = first.select(*keys, label, F.format_string(form, rank).alias(to))
    return rows.join(names, [*keys, label], "left")


def vote_by_sentence(words: DataFrame, keys=KEYS, ends: Column | None = None, least: int = 3) -> DataFrame:
    """words with voted: in a sentence with several labels a strict majority relabels all of it.

    A sentence ends with a word that ends so (by default in . ? or !). Calls of under
    least words stay as they are. Sentences of any length are voted on whole.
    """
    w = along(keys)
    ends = F.col("word").rlike(r"[.?!]\s*$") if ends is None else ends
    rows = islands(words.withColumn("_ends", ends), F.lag("_ends").over(w), keys, name="_sentence")
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    counts = rows.groupBy(*keys, "_sentence", "speaker").agg(F.count("*").alias("_c"))
    best = counts.groupBy(*keys, "_sentence").agg(F.max_by("speaker", "_c").alias("_best"), F.max("_c").alias("_most"), F.sum("_c").alias("_all"))
    rows = rows.join(best, [*keys, "_sentence"])
    voted = F.when((2 * F.col("_most") > F.col("_all")) & (F.col("_n") >= least), F.col("_best")).otherwise(F.col("speaker"))
    return rows.select(*words.columns, voted.alias("voted"))


def fold_speakers(turns: DataFrame, expected: int = 2, most_share: float = 0.15, keys=KEYS) -> DataFrame:
    """turns with the labels beyond the expected ones folded into those that talk most, and applied.

    A call is left as it is if it has no surplus label or one of these holds over
    most_share of the talk. A surplus turn takes the label of the kept turn nearest
    by its middle, the first on a tie.
    """
    talk = turns.groupBy(*keys, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("_sec"), F.min("turn_id").alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("_sec", 6).desc(), "_first"))
    share = F.col("_sec") / F.sum("_sec").over(Window.partitionBy(*keys))
    talk = talk.withColumn("_kept", rank <= expected).withColumn("_big", (rank > expected) & (share > most_share))
    calls = talk.groupBy(*keys).agg((~F.bool_or("_big") & F.bool_or(~F.col("_kept"))).alias("applied"))
    rows = turns.join(talk.select(*keys, "speaker", "_kept"), [*keys, "speaker"]).join(calls, list(keys))
    kept, extra = rows.filter("_kept or not applied"), rows.filter("not _kept and applied")
    middle = (F.col("start") + F.col("end")) / 2
    spans = kept.select(*keys, F.col("turn_id").alias("r_idx"), middle.alias("r_start"), middle.alias("r_end"), F.col("speaker").alias("r_speaker"))
    near = nearest_segment(extra.withColumnRenamed("turn_id", "idx"), spans, keys).select(*keys, F.col("idx").alias("turn_id"), "near_speaker")
    folded = extra.join(near, [*keys, "turn_id"]).withColumn("speaker", F.col("near_speaker")).drop("near_speaker")
    return kept.unionByName(folded).select(*turns.columns, "applied")


def collapse_speakers(turns: DataFrame, expected: int = 2, most_share: float = 0.15, gap: float = 1.0, keys=KEYS, text: str | None = None) -> DataFrame:
    """Turns with surplus labels folded as by fold_speakers, and rejoined in the calls where that was done.

    Returns keys, run, speaker, start, end, n, applied and, given its column, the text.
    """
    moved = fold_speakers(turns, expected, most_share, keys)
    joined = merge_runs(moved.filter("applied"), gap, keys, idx="turn_id", text=text)
    more = [] if text is None else [text]
    same = moved.filter("not applied").select(*keys, F.col("turn_id").cast("long").alias("run"), "speaker", "start", "end", F.lit(1).cast("long").alias("n"), *more)
    return joined.withColumn("applied", F.lit(True)).unionByName(same.withColumn("applied", F.lit(False)))


def collapse_report(turns: DataFrame, collapsed_from: DataFrame, keys=KEYS) -> DataFrame:
    """Seconds by (from, to) label: turns before and after share keys and turn_id."""
    after = collapsed_from.select(*keys, "turn_id", F.col("speaker").alias("to_speaker"))
    both = turns.join(after, [*keys, "turn_id"]).filter("speaker <> to_speaker")
    return both.groupBy(*keys, F.col("speaker").alias("from_speaker"), "to_speaker").agg(F.round(F.sum(F.col("end") - F.col("start")), 3).alias("seconds"))


def remap_words(words: DataFrame, spans: DataFrame, tolerance: float = 0.15, keys=KEYS) -> DataFrame:
    """Words from the trimmed clock to the full one; an end never comes before its start."""
    rows = to_original(words, spans, "start", tolerance, keys, "_start")
    rows = to_original(rows, spans, "end", tolerance, keys, "_end")
    start, end = F.round("_start", 3), F.round(F.greatest("_start", "_end"), 3)
    return rows.withColumn("start", start).withColumn("end", end).drop("_start", "_end")


def remap_turns(words: DataFrame, spans: DataFrame, split_gap: float = 2.0, keys=KEYS) -> DataFrame:
    """Turns on the full clock from words (turn_id, speaker) on the trimmed one: a turn is cut at pauses over split_gap, then neighbours of one speaker within it are joined."""
    rows = remap_words(words, spans, keys=keys)
    w = along((*keys, "turn_id"))
    parts = islands(rows, F.col("start") - F.lag("end").over(w) > split_gap, (*keys, "turn_id"), name="_part")
    pieces = parts.groupBy(*keys, "turn_id", "_part").agg(F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("idx").alias("idx"))
    return merge_runs(pieces, split_gap, keys)


def absorb_flicker(turns: DataFrame, least: float = 0.6, keys=KEYS, idx: str = "idx") -> DataFrame:
    """Turns under least seconds lengthen the kept one before them, the first turn being kept always; then neighbours of one speaker are joined."""
    rows = islands(turns, F.col("end") - F.col("start") >= least, keys, ("start", idx), "_own")
    first = F.struct("start", idx)
    rows = rows.groupBy(*keys, "_own").agg(F.min_by("speaker", first).alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"), F.min(idx).alias("idx"))
    return merge_runs(rows, None, keys)


def turns_from_windows(windows: DataFrame, hop: float = 0.25, keys=KEYS, gap: float | None = None) -> DataFrame:
    """Turns from labelled windows (win_idx, time, label): a boundary lies midway between windows, the last turn ends a hop after its window.

    gap: a pause between windows from which a turn is also cut; none by default.
    """
    w = Window.partitionBy(*keys).orderBy("win_idx")
    changed = ~F.lag("label").over(w).eqNullSafe(F.col("label"))
    if gap is not None:
        changed = changed | (F.col("time") - F.lag("time").over(w) > gap)
    rows = windows.withColumn("_before", F.lag("time").over(w)).withColumn("_after", F.lead("time").over(w))
    rows = islands(rows, changed, keys, ("win_idx",), "turn_id")
    out = rows.groupBy(*keys, "turn_id").agg(
        F.first("label").alias("label"),
        F.min_by(F.coalesce((F.col("_before") + F.col("time")) / 2, F.col("time")), "win_idx").alias("start"),
        F.max_by(F.coalesce((F.col("_after") + F.col("time")) / 2, F.col("time") + hop), "win_idx").alias("end"),
    )
    return out.withColumn("speaker", F.format_string("SPEAKER_%02d", F.col("label").cast("int")))


def track_turns(tracks: DataFrame, speakers: int | None = None, frame: float = 0.08, threshold: float = 0.5, least_track: float = 2.0, least_turn: float = 0.2, keys=KEYS) -> DataFrame:
    """Turns from frame probabilities: tracks with under least_track active seconds go (the most active stays if all would), each frame goes to its likeliest track.

    speakers: keep so many of the most active tracks.
    """
    tall = tracks.select(*keys, "frame_idx", F.posexplode("probs").alias("track", "prob"))
    active = tall.groupBy(*keys, "track").agg((F.count_if(F.col("prob") >= threshold) * frame).alias("_sec"), F.min(F.when(F.col("prob") >= threshold, F.col("frame_idx"))).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_sec").desc(), "track"))
    kept = active.withColumn("_rank", rank).filter((F.col("_sec") >= least_track) | (F.col("_rank") == 1))
    if speakers is not None:
        kept = kept.filter(F.col("_rank") <= speakers)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_first", "track")) - 1
    kept = kept.select(*keys, "track", F.format_string("SPEAKER_%02d", place).alias("speaker"))
    best = tall.join(kept, [*keys, "track"]).filter(F.col("prob") >= threshold).groupBy(*keys, "frame_idx").agg(F.max_by("speaker", F.struct("prob", -F.col("track"))).alias("speaker"))
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    changed = ~F.lag("speaker").over(w).eqNullSafe(F.col("speaker")) | (F.col("frame_idx") - F.lag("frame_idx").over(w) > 1)
    runs = islands(best, changed, keys, ("frame_idx",), "turn_id")
    out = runs.groupBy(*keys, "turn_id").agg(F.first("speaker").alias("speaker"), F.round(F.min("frame_idx") * frame, 3).alias("start"), F.round((F.max("frame_idx") + 1) * frame, 3).alias("end"))
    return out.filter(F.col("end") - F.col("start") >= least_turn - 1e-9)


def surplus_labels(segments: DataFrame, expected: int, keys=KEYS) -> DataFrame:
    """(keys, speaker, seconds, surplus): labels beyond the expected ones by seconds held."""
    held = segments.groupBy(*keys, "speaker").agg(F.round(F.sum(F.col("end") - F.col("start")), 3).alias("seconds"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("seconds").desc(), "speaker"))
    return held.withColumn("surplus", rank > expected)


def split_tails(words: DataFrame, evidence: DataFrame | None = None, keys=KEYS, weak: bool = False, margin: float = 0.06, gap_db: float = 6.0, weak_gap_db: float = 3.0) -> DataFrame:
    """words with handed: within a turn, what follows a question goes to the other of two speakers.

    words: keys, turn_id, idx, word, speaker. A tail runs from the word after one that
    ends in ? up to the next such word, which it includes. evidence: keys, turn_id,
    tail, own_sim, other_sim, level_gap from a provider; a tail whose voice is the
    asker's by over margin stays, unless the level differs by gap_db. With weak,
    voices don't count and a tail goes only if levels differ by weak_gap_db.
    Calls with other than two speakers stay as they are.
    """
    w = Window.partitionBy(*keys, "turn_id").orderBy("idx")
    asks = F.col("word").rlike(r"\?\s*$") & F.lead("idx").over(w).isNotNull()
    rows = words.withColumn("_asks", asks)
    rows = rows.withColumn("tail", F.coalesce(F.sum(F.col("_asks").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    names = words.groupBy(*keys).agg(F.sort_array(F.collect_set("speaker")).alias("_names"))
    rows = rows.join(names, list(keys))
    other = F.filter("_names", lambda x: x != F.col("speaker"))[0]
    moves = (F.col("tail") > 0) & (F.size("_names") == 2)
    if evidence is not None:
        rows = rows.join(evidence, [*keys, "turn_id", "tail"], "left")
        level = F.coalesce("level_gap", F.lit(0.0))
        if weak:
            moves = moves & (level >= weak_gap_db)
        else:
            moves = moves & ~((F.coalesce(F.col("own_sim") - F.col("other_sim"), F.lit(0.0)) > margin) & (level < gap_db))
    return rows.select(*words.columns, "tail", F.when(moves, other).otherwise(F.col("speaker")).alias("handed"))


def apply_edits(turns: DataFrame, edits: DataFrame, keys=KEYS) -> DataFrame:
    """Turns with an editor's changes: the last edit of a turn counts, guarded.

    edits: keys, i (the turn), pos, speaker, split. A split stands only if its parts
    joined are the turn's text up to white space, its labels are known in the call
    and none is empty; otherwise the speaker alone is tried. Turns without edit stay.
    Returns keys, turn_id, part, speaker, text, edit (none, label, split, refused).
    """
    last = edits.groupBy(*keys, F.col("i").alias("turn_id")).agg(F.max_by(F.struct("speaker", "split"), "pos").alias("e"))
    known = turns.groupBy(*keys).agg(F.collect_set("speaker").alias("_known"))
    rows = turns.join(last, [*keys, "turn_id"], "left").join(known, list(keys))
    plain = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    split = F.col("e.split")
    whole = plain(F.array_join(F.transform(split, lambda p: p["text"]), " ")) == plain(F.col("text"))
    fits = whole & (F.size(F.array_except(F.transform(split, lambda p: p["speaker"]), F.col("_known"))) == 0) & ~F.exists(split, lambda p: plain(p["text"]) == "")
    good = split.isNotNull() & (F.size(split) > 0) & F.coalesce(fits, F.lit(False))
    label = F.array_contains("_known", F.col("e.speaker"))
    parts = F.when(good, split).otherwise(F.array(F.struct("text", F.when(F.coalesce(label, F.lit(False)), F.col("e.speaker")).otherwise(F.col("speaker")).alias("speaker"))))
    kind = F.when(F.col("e").isNull(), "none").when(good, "split").when(F.coalesce(label, F.lit(False)), "label").otherwise("refused")
    out = rows.select(*keys, "turn_id", kind.alias("edit"), F.posexplode(parts).alias("part", "p"))
    return out.select(*keys, "turn_id", "part", F.col("p.speaker").alias("speaker"), F.col("p.text").alias("text"), "edit")


def share_words(turn_words: DataFrame, parts: DataFrame, keys=KEYS) -> DataFrame:
    """Start and end of each part of a split turn: its words are taken in order by their number.

    turn_words: keys, turn_id, idx, start, end; parts: as from apply_edits.
    """
    w = Window.partitionBy(*keys, "turn_id").orderBy("part")
    n = F.size(F.split(F.trim("text"), r"\s+"))
    upto = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    bounds = parts.withColumn("_to", upto).withColumn("_from", F.col("_to") - n)
    rank = F.row_number().over(Window.partitionBy(*keys, "turn_id").orderBy("idx")) - 1
    placed = turn_words.select(*keys, "turn_id", "start", "end", rank.alias("_at"))
    hit = (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))
    return bounds.join(placed, [*keys, "turn_id"]).filter(hit).groupBy(*keys, "turn_id", "part", "speaker", "text").agg(F.min("start").alias("start"), F.max("end").alias("end"))
