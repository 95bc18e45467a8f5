"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Direction marks and the byte order mark.
MARKS = r"[\x{200e}\x{200f}\x{061c}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}]"
#: Hebrew interrogatives that open a question, conjunctions that may come before them, first-person pronouns, and adverbs between these and a verb.
OPENERS = ["האם", "למה", "מדוע", "כיצד", "מתי", "איפה", "לאן", "מאיפה", "מניין", "היכן", "וכי"]
CONJUNCTIONS = ["אז", "אבל", "ו"]
FIRST_PERSON = ["אני", "ואני", "שאני", "כשאני"]
ADVERBS = ["לא", "ממש", "מאוד", "כבר", "עדיין", "קצת", "רק", "גם", "פשוט"]
AND_PREFIX, FEMININE, PLURAL, INFINITIVE = "ו", "ת", "ות", "ל"


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), MARKS, "")


def normalise(text: Column, spaces: bool = True) -> Column:
    """Lower case without anything but letters, digits, underscores and, if wanted, spaces."""
    keep = r"(?U)[^\w\x{0590}-\x{05ff} ]+" if spaces else r"(?U)[^\w\x{0590}-\x{05ff}]+"
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), keep, "")))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def words_of(text: Column) -> Column:
    return F.filter(F.split(squeeze(text), " "), lambda t: t != "")


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def srt_clock(seconds: Column) -> Column:
    """HH:MM:SS,mmm with milliseconds cut off."""
    ms = F.floor(F.round(seconds * 1000, 6)).cast("long")
    part = lambda size, mod: F.floor(ms / size).cast("long") % mod if mod else F.floor(ms / size).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", part(3600000, 0), part(60000, 60), part(1000, 60), ms % 1000)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def ends_sentence(word: Column) -> Column:
    return F.coalesce(F.right(F.trim(word), F.lit(1)).isin(".", "?", "!"), F.lit(False))


def opens_question(sentence: Column) -> Column:
    """Its first word, or the second after a conjunction, is an interrogative, which may carry the prefix for 'and'."""
    found = words_of(sentence)
    head = F.when(F.get(found, 0).isin(CONJUNCTIONS), F.get(found, 1)).otherwise(F.get(found, 0))
    bare = F.when(head.startswith(AND_PREFIX), F.substr(head, F.lit(2)))
    return F.coalesce(head.isin(OPENERS) | F.coalesce(bare.isin(OPENERS), F.lit(False)), F.lit(False))


def question_marks(text: Column) -> Column:
    """The text with sentences that open as questions ending in a question mark."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?]+[.!?]*\s*"), F.lit(0))
    lead = F.regexp_extract(F.coalesce(text, F.lit("")), r"^[.!?]+\s*", 0)

    def fixed(p: Column) -> Column:
        body, stop = F.regexp_extract(p, r"^([^.!?]*)", 1), F.regexp_extract(p, r"^[^.!?]*([.!?]*\s*)$", 1)
        ask = opens_question(body) & ~stop.contains("?")
        ended = F.concat(F.rtrim(body), F.lit("? "))
        return F.when(ask & (F.trim(stop) != ""), F.concat(body, F.lit("?"), F.regexp_replace(stop, r"^[.!]+", ""))).when(ask, ended).otherwise(p)

    return F.rtrim(F.concat(lead, F.array_join(F.transform(pieces, fixed), "")))


def feminine_self_marker(text: Column) -> Column:
    """The first verb or adjective in the feminine that a speaker uses of herself, or null.

    After a first-person pronoun up to two adverbs may come; the next word counts if
    it has four letters, the feminine ending, and is neither plural nor infinitive.
    """
    found = words_of(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w\x{0590}-\x{05ff} ]+", " "))
    at = F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0)))

    def marker(i: Column) -> Column:
        following = F.filter(F.slice(found, i + 2, 3), lambda t: ~t.isin(ADVERBS))
        word = F.get(following, 0)
        good = (F.length(word) >= 4) & word.endswith(FEMININE) & ~word.endswith(PLURAL) & ~word.startswith(INFINITIVE)
        return F.when(F.get(found, i).isin(FIRST_PERSON) & good, word)

    return F.get(F.array_compact(F.transform(at, marker)), 0)


def digits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\d"))


def solid_length(text: Column) -> Column:
    return F.length(F.replace(text, F.lit(" "), F.lit("")))


def json_block(text: Column, opening: str = "{") -> Column:
    """From the first opening brace or bracket to the last closing one; null without."""
    pattern = r"(?s)\{.*\}" if opening == "{" else r"(?s)\[.*\]"
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def shave_preamble(text: Column) -> Column:
    """Lines from the first that starts with a clock on; all if none does."""
    lines = F.split(text, "\n")
    first = F.array_position(F.transform(lines, lambda x: x.rlike(r"^\d{1,2}:\d{2}")), True)
    return F.when(first > 0, F.array_join(F.slice(lines, first.cast("int"), F.size(lines)), "\n")).otherwise(text)


def retry_wait(header: Column, body: Column, attempt: Column) -> Column:
    """Seconds to wait: the header's, else the body's retryDelay up to 180, else 8 for each attempt made."""
    told = F.try_to_number(F.nullif(F.regexp_extract(body, r"retryDelay\"?\s*:\s*\"?(\d+)", 1), F.lit("")), F.lit("999999999")).cast("double")
    return F.coalesce(header.try_cast("double"), F.when(told.isNotNull(), F.least(told, F.lit(180.0))), 8.0 * (attempt + 1))


def payload_size(data: Column) -> Column:
    """Characters of the data in base64, without line breaks."""
    return (4 * F.ceil(F.octet_length(data) / 3)).cast("int")


def error_kind(code: Column, body: Column) -> Column:
    """exhausted, retry or fatal for a provider's HTTP answer; null for success."""
    spent = body.rlike("(?i)per ?day|prepay|credit")
    return (
        F.when(code < 400, None)
        .when(code.isin(402, 404) | ((code == 429) & F.coalesce(spent, F.lit(False))), "exhausted")
        .when(code == 429, "retry")
        .otherwise("fatal")
    )


def anchor_trim(answer: Column, before: Column, after: Column, norm=normalise) -> Column:
    """The answer without its longest start that ends `before`, and its longest end that starts `after`."""
    clean = lambda tokens: F.transform(tokens, lambda t: norm(t))

    def longest(own: Column, its: Column, at_start: bool) -> Column:
        most = F.least(F.size(own), F.size(its))
        sizes = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
        if at_start:
            fits = F.filter(sizes, lambda k: F.slice(own, 1, k) == F.slice(its, F.size(its) - k + 1, k))
        else:
            fits = F.filter(sizes, lambda k: F.slice(own, F.size(own) - k + 1, k) == F.slice(its, 1, k))
        return F.coalesce(F.array_max(fits), F.lit(0))

    def cut_start(tokens: Column) -> Column:
        both = F.struct(clean(tokens).alias("own"), clean(words_of(before)).alias("its"))
        return let(both, lambda b: F.slice(tokens, longest(b["own"], b["its"], True) + 1, F.size(tokens)))

    def cut_end(tokens: Column) -> Column:
        both = F.struct(clean(tokens).alias("own"), clean(words_of(after)).alias("its"))
        return let(both, lambda b: F.slice(tokens, 1, F.size(tokens) - longest(b["own"], b["its"], False)))

    return F.array_join(let(let(words_of(answer), cut_start), cut_end), " ")


def repeats(tokens: Column, run: int = 5) -> Column:
    """A token occurs run times in a row."""
    at = F.when(F.size(tokens) >= run, F.sequence(F.lit(1), F.size(tokens) - run + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(at, lambda i: F.size(F.array_distinct(F.slice(tokens, i, run))) == 1)


def is_plausible(text: Column, hyp_a: Column, hyp_b: Column, script: str = r"[\x{0590}-\x{05ff}]") -> Column:
    """An answer that has the script, 0.3 to 3 times the letters of the longer hypothesis and no token five times in a row."""
    length = lambda x: solid_length(normalise(x))
    ratio = length(text) / F.greatest(length(hyp_a), length(hyp_b), F.lit(1))
    return let(words_of(normalise(text)), lambda own: (F.size(own) > 0) & text.rlike(script) & ratio.between(0.3, 3.0) & ~repeats(own))


def rewrite_ok(before: Column, after: Column) -> Column:
    """A rewritten line: of 8 characters or more, it may differ in length by 4, or a third if that is more."""
    n = F.length(before)
    return ~((n >= 8) & (F.abs(F.length(after) - n) > F.greatest(F.lit(4), F.floor(n / 3))))


def polish_ok(before: Column, after: Column, script: str = r"[\x{0590}-\x{05ff}]") -> Column:
    """A polished turn has 0.45 to 2 times the letters and the script."""
    ratio = solid_length(after) / F.greatest(solid_length(before), F.lit(1))
    return ratio.between(0.45, 2.0) & after.rlike(script)
