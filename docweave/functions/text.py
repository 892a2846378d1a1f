"""Text columns: whitespace, cleaning, descriptions, tokens, answer clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space.
SPACES = r"\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Printable ASCII is ruled out first: most characters then take one comparison.
WHITESPACE = rf"[[^!-~]&&[{SPACES}]]"
# Characters kept in a title besides white space.
TITLE_KEPT = r"\p{L}\p{N}_\-.,!?;:()\[\]{}\"'"
# The ASCII ranges add nothing; they settle most characters in one comparison.
TOKEN_BREAK = r"[^a-z0-9\p{L}\p{M}\p{N}]+"
SENTENCE_BREAK = "[.!?]+"
TOKENS_PER_WORD = 1.3

# Stock answers and prompt markers.
NO_TEXT_ANSWER = "I don't have enough information to answer this question."
NO_HIT_ANSWER = "I don't have any relevant information to answer this question."
EMPTY_ANSWER = "I couldn't generate an answer to your question."
PROMPT_MARKERS = ("Context:", "Question:", "Answer:", "Based on the following")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, WHITESPACE + "+", " "))


def clean_title(text: Column) -> Column:
    """Collapsed text without characters outside words, white space and basic punctuation."""
    kept = F.regexp_replace(collapse(text), rf"[^\s{TITLE_KEPT}]", "")
    return F.coalesce(kept, F.lit(""))


def short_description(content: Column, limit: int = 200) -> Column:
    """First sentence, cut with an ellipsis when long, else closed with a full stop."""
    first = F.trim(F.regexp_extract(content, "^([^.!?]*)", 1))
    return F.when(
        F.length(first) > limit, F.concat(F.substring(first, 1, limit), F.lit("..."))
    ).otherwise(F.concat(first, F.lit(".")))


def clip(text: Column, limit: int) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def words(text: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def llm_token_estimate(text: Column) -> Column:
    """Words times a fixed factor, rounded to a whole number."""
    return F.round(word_count(text) * F.lit(TOKENS_PER_WORD)).cast("int")


def search_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: t != "")


def count_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms occur in the text, each counted once."""
    if not terms:
        return F.lit(0)
    hits = [F.when(F.contains(text, F.lit(term)), 1).otherwise(0) for term in terms]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return total


def any_term(text: Column, terms: tuple[str, ...]) -> Column:
    if not terms:
        return F.lit(False)
    found = F.contains(text, F.lit(terms[0]))
    for term in terms[1:]:
        found = found | F.contains(text, F.lit(term))
    return found


def tidy_answer(answer: Column) -> Column:
    """Stock text for blanks; drop anything up to the last prompt marker; close the sentence."""
    text = strip(answer)
    for marker in PROMPT_MARKERS:
        # the whole text when the marker is absent, nothing when it comes last
        text = strip(F.substring_index(text, marker, -1))
    closed = F.regexp_replace(text, r"([^.!?])\z", "$1.")
    blank = answer.isNull() | ~answer.rlike(rf"[^{SPACES}]")
    return F.when(blank, F.lit(EMPTY_ANSWER)).otherwise(closed)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITESPACE}+|{WHITESPACE}+$", "")

