"""Text expressions: answer extraction, normalisation and structural features.

Character classes are explicit, because engines disagree on what ``\\w``, ``\\d`` and ``\\b`` mean
outside ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The answer marker, the number pattern, the option letters, the symbols and the
# name rule that results depend on.
MARKER = "Final Answer:"
NUMBER = r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?"
LETTERS = ("A", "B", "C", "D")
MATH_SYMBOLS = "+-*/=<>^%$"
ANSWER_SEPARATOR = "####"

# What counts as white space: Unicode separators and the controls that separate, as Python has it.
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"


def strip(value: Column | str) -> Column:
    """Remove all surrounding white space; ``trim`` would remove spaces only."""
    value = F.col(value) if isinstance(value, str) else value
    return F.regexp_replace(value, f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalised(value: Column | str) -> Column:
    return F.lower(strip(value))


def answer_body(answer: str) -> Column:
    """Text after the marker, on its line; the whole answer without a marker."""
    after = F.regexp_extract(F.col(answer), rf"(?i){MARKER}[{SPACE}]*([^\n]*)", 1)
    return F.when(F.lower(answer).contains(MARKER.lower()), after).otherwise(F.col(answer))


def first_number(body: str) -> Column:
    return F.regexp_extract(F.col(body), NUMBER, 0)


def numeric_prediction(body: str, number: str) -> Column:
    """The first number of the body without thousands separators, else the body as text."""
    return F.when(F.col(number) != "", F.replace(F.col(number), F.lit(","), F.lit(""))).otherwise(strip(body))


def decimal_of(value: Column, shown: Column) -> Column:
    """The value as a decimal, NULL if it is none. ``shown`` has the same digits: without a digit nothing is
    parsed, as each failure to parse costs an exception."""
    return F.when(shown.rlike(r"\p{Nd}"), value).try_cast("decimal(38,18)")


def numeric_correct(prediction: str, truth: str) -> Column:
    """Exact decimal equality; text equality without case when a side is not a number.

    The prediction has no surrounding white space, as ``numeric_prediction`` gives it.
    """
    left = decimal_of(F.col(prediction), F.col(prediction))
    right = decimal_of(F.replace(F.col(truth), F.lit(","), F.lit("")), F.col(truth))
    return F.coalesce(left == right, F.lower(prediction) == normalised(truth)).cast("int")


def letter_prediction(answer: str) -> Column:
    """Option letter after the marker, else the answer itself when it is a single letter, else ''.

    One pattern for both: an answer that is a single letter holds no marker.
    """
    options = "".join(LETTERS)
    found = rf"(?i)(?:{MARKER}[{SPACE}]*|\A[{SPACE}]*(?=[{options}][{SPACE}]*\z))([{options}])(?![A-Za-z0-9_])"
    return F.coalesce(F.upper(F.regexp_extract(F.col(answer), found, 1)), F.lit(""))


def letter_correct(prediction: str, truth: str) -> Column:
    """Equality without case; the prediction is an upper-case letter or '', as ``letter_prediction`` gives it."""
    return (F.col(prediction) == F.upper(strip(truth))).cast("int")


def final_answer(answer: str) -> Column:
    """Answer text after the last separator."""
    return strip(F.element_at(F.split(F.col(answer), ANSWER_SEPARATOR, -1), -1))


def lettered_question(stem: str, choices: str) -> Column:
    lines = [F.concat(F.lit(f"{letter}. "), F.coalesce(F.get(F.col(choices), F.lit(i)), F.lit(""))) for i, letter in enumerate(LETTERS)]
    return F.concat(F.col(stem), F.lit("\n\n"), F.concat_ws("\n", *lines))


def letter_of(index: str) -> Column:
    return F.get(F.array(*[F.lit(letter) for letter in LETTERS]), F.col(index))


WORD_MARK = "x"  # a letter: text outside words holds none, so a mark is always a word


def words_marked(text: str) -> Column:
    """The text with every word replaced by one mark; the only pass of the word pattern."""
    return F.regexp_replace(F.col(text), WORD, WORD_MARK)


def structural_features(text: str, marked: str) -> dict[str, Column]:
    """Features known before any candidate answers, by name.

    ``marked`` names a column with the marked text, which several features share: each pattern
    runs once over a text, and counts look for the rarer characters.
    """
    col = F.col(text)
    outside = F.replace(F.col(marked), F.lit(WORD_MARK), F.lit(""))
    n = F.length(marked) - F.length(outside)
    symbols = "".join("\\" + c for c in MATH_SYMBOLS)
    body = F.regexp_replace(col, rf"({LINE_END})\z", "")
    options = F.regexp_count(col, F.lit(rf"(?md)^[ABCD]\.[{SPACE}]"))
    return {
        "char_count": F.length(col),
        "word_count": n,
        # Words, and every other character that is not white space.
        "approx_token_count": n + F.regexp_count(outside, F.lit(f"[^{SPACE}]")),
        "line_count": F.regexp_count(body, F.lit(LINE_END)) + 1,
        "sentence_count": F.greatest(F.lit(1), F.regexp_count(col, F.lit("[.!?]+"))),
        "number_count": F.regexp_count(col, F.lit(NUMBER)),
        "math_symbol_count": F.regexp_count(col, F.lit(f"[{symbols}]")),
        "question_mark_count": F.length(col) - F.length(F.replace(col, F.lit("?"), F.lit(""))),
        "option_count": options,
        "is_multiple_choice": (options >= len(LETTERS)).cast("int"),
        "avg_word_length": F.when(n > 0, F.round((F.length(col) - F.length(outside)) / n, 6)).otherwise(F.lit(0.0)),
    }


def column_name(value: str) -> str:
    """Lower-case name with every run of other characters than a-z, 0-9 as one underscore."""
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in value.strip().lower())
    return "_".join(out.split())
