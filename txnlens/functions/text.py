"""Column functions for text: cleaning, heading tests, sentences, snippets, keyword tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters of Unicode (NBSP among them) and the four ASCII
# separators, as the inside of a character class and as a string.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Looking ahead for common visible characters first spares most positions the long class.
_MAYBE_SPACE = r"(?=[^!-~\u00a1-\u024f])"
_MAYBE_ODD = r"(?=[^ -~\u00a1-\u024f])"
# A run that is not just one plain blank; single blanks, the usual case, need no replacement.
UNTIDY = rf" {_MAYBE_SPACE}[{SPACE}]+|{_MAYBE_ODD}[{SPACE}]+"
SENTENCE_BREAK = rf"(?<=[.!?]){_MAYBE_SPACE}[{SPACE}]+"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def clean_text(text: Column) -> Column:
    """White space runs become one blank, ends trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), UNTIDY, " "))


def is_all_caps(text: Column) -> Column:
    """More than three ASCII letters, none of them lower case."""
    return ~text.rlike("[a-z]") & text.rlike("(?:[A-Z][^A-Z]*){4}")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(clean_text(text), " "), ""))


def heading_level(style: Column) -> Column:
    """Number at the end of a heading style name, 1 where there is none."""
    last_word = F.element_at(F.split(clean_text(style), " "), -1)
    return F.coalesce(last_word.try_cast("int"), F.lit(1))


def sentences(text: Column) -> Column:
    """Sentences as an array: cut after ``.``, ``!`` or ``?`` followed by white space."""
    return F.filter(F.split(strip(text), SENTENCE_BREAK), lambda s: s != "")


def snippet(text: Column, max_chars: int) -> Column:
    """First ``max_chars`` characters with line breaks shown as blanks."""
    return F.substring(F.translate(text, "\n", " "), 1, max_chars)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True where the lower-cased text holds one of the (lower-case) words as a substring."""
    lowered = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | lowered.contains(word)
    return found


def terms(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(all_terms(text))


def all_terms(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: w != "")


def chunk_id(doc_id: Column, block_index: Column, chunk_index: Column) -> Column:
    """Repeatable chunk id in UUID form, so that reloading the same document is an upsert."""
    digest = F.sha2(F.concat_ws("|", doc_id, block_index, chunk_index), 256)
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in parts])
