"""Scalar text functions as Column expressions. All of them return null for null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of answers, tried in this order, and of questions and answers, each tried once in this order.
ANSWER_PREFIXES = ("Answer:", "answer:", "> Answer:", "> answer:", "A:", "a:")
QA_PREFIXES = ("Q:", "A:", "question:", "answer:", "Question:", "Answer:", "- ", "* ")
#: Where a judge's verdict and a chosen response are named.
GRADE_PATTERN = r"(?i)GRADE:(?U:\s)*(CORRECT|INCORRECT)"
CHOICE_PATTERN = r"The most consistent response is Response (\d+)"
ANY_CHOICE_PATTERN = r"(?i)response(?U:\s)+(\d+)"
#: ASCII punctuation, as stripped from a verdict's first and last word.
PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Unicode's white space, as ``\s`` of a Unicode pattern has it.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column | str) -> Column:
    """Without white space (Unicode's) at either end. It looks no further than the first other character from each end."""
    return F.trim(_col(c), F.lit(WHITE_SPACE))


def has_sentence_end(c: Column | str) -> Column:
    """Ends, but for white space, with ``. ? !`` and perhaps a closing parenthesis."""
    return _col(c).rlike(r"(?U)[.?!]\)?\s*\z")


def clean_question(c: Column | str) -> Column:
    """White space collapsed to single blanks and stripped."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def parse_questions(c: Column | str) -> Column:
    """The questions of numbered lines (``Q1: ``, ``2. ``, repeated numbers too), cleaned; other lines are dropped.

    A number must begin the line. A number with nothing behind it is an empty question.
    """
    number = r"(?U)^(Q?\d+[.:]\s+)+"
    lines = F.split(_col(c), "\n")
    return F.transform(F.filter(lines, lambda x: x.rlike(number)), lambda x: clean_question(F.regexp_replace(x, number, "")))


def strip_qa_prefix(c: Column | str) -> Column:
    """Without the prefixes of questions and answers, in their fixed order, then without ``12.`` if something follows it.

    The text runs through the prefixes as the state of a fold, so each is tested at its beginning alone.
    """
    bare = lambda x: F.ltrim(x, F.lit(WHITE_SPACE))

    def without(text: Column, prefix: Column) -> Column:
        return F.when(F.startswith(text, prefix), bare(F.substring(text, F.length(prefix) + 1, F.length(text)))).otherwise(text)

    def finish(text: Column) -> Column:
        return F.when(F.substring(text, 1, 1).between("0", "9"), F.regexp_replace(text, r"(?sU)^[0-9]+\.(?=.)\s*", "")).otherwise(text)

    return F.aggregate(F.array(*map(F.lit, QA_PREFIXES)), strip(c), without, finish)


def remove_answer_prefix(c: Column | str) -> Column:
    """Without the first of ``ANSWER_PREFIXES`` that it starts with, then stripped; unchanged if there is none."""
    c, out = _col(c), None
    for p in ANSWER_PREFIXES:
        cut = strip(F.substring(c, len(p) + 1, 1 << 30))
        out = F.when(c.startswith(p), cut) if out is None else out.when(c.startswith(p), cut)
    return out.otherwise(c)


def truncate_at_stops(c: Column | str, stops: Sequence[str]) -> Column:
    """Cut before the first occurrence of each stop, one after the other."""
    c = _col(c)
    for stop in stops:
        c = F.substring_index(c, stop, 1)
    return c


def combine(parts: Column | str, separator: str = "\n\n", template: str = "{}") -> Column:
    """Parts in the template, joined; empty for no parts."""
    before, after = template.split("{}", 1)
    return F.array_join(F.transform(_col(parts), lambda x: F.concat(F.lit(before), x, F.lit(after))), separator)


def numbered(parts: Column | str, prefix: str, first: int = 1, separator: str = "\n") -> Column:
    """``<prefix> <i>: <part>`` for each part."""
    line = lambda x, i: F.concat(F.lit(prefix + " "), (i + first).cast("string"), F.lit(": "), x)
    return F.array_join(F.transform(_col(parts), line), separator)


def format_answers(answers: Column | str, prefix: str = "Answer") -> Column:
    return numbered(answers, prefix)


def format_responses(responses: Column | str) -> Column:
    return numbered(responses, "Response", first=0, separator="\n\n")


def chosen_index(c: Column | str, pattern: str = CHOICE_PATTERN) -> Column:
    """The number behind the marker, null if there is none. On the first line that has markers, the last counts."""
    c = _col(c)
    line = F.get(F.filter(F.split(c, "\n"), lambda x: x.rlike(pattern)), F.lit(0)) if pattern == CHOICE_PATTERN else c
    found = F.regexp_extract(line, (r"(?d).*" if pattern == CHOICE_PATTERN else "") + pattern, 1)
    return F.when(found != "", found.try_cast("int"))


def choose(responses: Column | str, index: Column) -> Column:
    """The response of that index; the first where the index is missing or out of range."""
    responses = _col(responses)
    return F.coalesce(F.get(responses, index), F.get(responses, F.lit(0)))


def grade(c: Column | str) -> Column:
    """A judge's text as struct(score, value, reasoning); null without a verdict.

    The marker is sought from the third character of the stripped text on, and the reasoning is the
    unstripped text up to the marker's place in the stripped one. Without a marker the first and last
    word decide, CORRECT before INCORRECT, and the whole text is the reasoning.
    """
    text = _col(c)
    tail = F.substring(strip(text), 3, 1 << 30)
    value = F.upper(F.regexp_extract(tail, GRADE_PATTERN, 1))
    before = F.regexp_extract(tail, r"(?is)^(.*?)GRADE:(?U:\s)*(?:CORRECT|INCORRECT)", 1)
    marked = F.struct(F.when(value == "CORRECT", 1).otherwise(0).alias("score"), value.alias("value"), strip(F.substring(text, F.lit(1), F.length(before) + 2)).alias("reasoning"))
    words = F.split(F.upper(strip(text)), r"(?U)\s+")
    ends = [F.regexp_replace(F.try_element_at(words, F.lit(i)), f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", "") for i in (1, -1)]
    verdict = F.when((ends[0] == "CORRECT") | (ends[1] == "CORRECT"), "CORRECT").when((ends[0] == "INCORRECT") | (ends[1] == "INCORRECT"), "INCORRECT")
    plain = F.struct(F.when(verdict == "CORRECT", 1).otherwise(0).alias("score"), verdict.alias("value"), text.alias("reasoning"))
    return F.when(value != "", marked).when(verdict.isNotNull(), plain)


def whitespace_tokens(c: Column | str) -> Column:
    """Words between white space; none for empty text."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda x: x != "")


def get_or(values: Column | str, key: str, default: Column) -> Column:
    """A map's value of a key; the default only where the key is missing, not where its value is null."""
    return F.when(F.map_contains_key(_col(values), key), F.try_element_at(_col(values), F.lit(key))).otherwise(default)


def join_pieces(position: Column | str, piece: Column | str) -> Column:
    """Streamed pieces of a text, put together in their order: an aggregate over the rows of a text; null pieces count for nothing."""
    ordered = F.array_sort(F.collect_list(F.struct(_col(position).alias("p"), _col(piece).alias("t"))))
    return F.array_join(F.transform(ordered, lambda x: x["t"]), "")
