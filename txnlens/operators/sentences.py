"""Sentences by boundaries learned from the texts themselves.

Whether a full stop ends a sentence depends on the word before it. A word that nearly always has a
stop, is short, or has stops inside is an abbreviation, as log-likelihood ratios of its counts tell;
a word that follows sentence ends far more often than others is a starter. Counts come from one pass
over all texts, and only the two lists that are learned go to the texts that are cut. Lists too long to
be sent are looked up by joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.functions.text import SENTENCE_BREAK, SPACE, strip
from txnlens.operators.joins import lookup_join
from txnlens.session import materialize

# Least scores of an abbreviation and of a starter.
ABBREVIATION = 0.3
STARTER = 30.0
# Share of an abbreviation's occurrences that have a stop.
ALWAYS = 0.99
# Words of each list that are sent to the tasks, best scores first; the others are looked up by a join.
MOST = 10_000


@dataclass(frozen=True)
class Boundaries:
    """Abbreviations without their last stop, and words that begin sentences, all in lower case.

    Words beyond those that are sent to the tasks are in stored tables ``(word)``.
    """

    abbreviations: tuple[str, ...]
    starters: tuple[str, ...]
    more_abbreviations: DataFrame | None = None
    more_starters: DataFrame | None = None


# Patterns for the end of a string begin where a run begins or at the start of the string, and give nothing back:
# tried anew at every character they would take time with the square of a run's length.
def _inner(token: Column) -> Column:
    """A token in lower case without brackets, quotes and commas around it."""
    return F.regexp_replace(F.lower(token), r"^[^\p{L}\p{N}]+|(?<![^\p{L}\p{N}.])[^\p{L}\p{N}.]++$", "")


def _without_stops(inner: Column) -> Column:
    return F.regexp_replace(inner, r"(?<!\.)\.++$", "")


def _type(token: Column) -> Column:
    """The word of a token, without stops at its end."""
    return _without_stops(_inner(token))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _pieces(text: Column) -> Column:
    return F.filter(F.split(strip(text), SENTENCE_BREAK), lambda s: s != "")


def _first(piece: Column) -> Column:
    return F.regexp_extract(piece, rf"^[^{SPACE}]+", 0)


def _last(piece: Column) -> Column:
    return F.regexp_extract(piece, rf"^(?s:.*[{SPACE}])?([^{SPACE}]+)$", 1)


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    """Logarithm of the chance of ``k`` in ``n`` at rate ``p``, up to what cancels."""
    yes = F.when(k > 0, k * F.log(p)).otherwise(F.lit(0.0))
    return yes + F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(F.lit(0.0))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n, n_stop)``: how often each word occurs, and how often with a stop at its end.

    Rows are reduced where the texts are read; a frequent word is one row a task. Words without a
    letter are left out.
    """
    tokens = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), rf"[{SPACE}]+"), lambda t: t != "")
    inner = docs.select(F.explode(F.transform(tokens, _inner)).alias("inner")).filter(F.col("inner").rlike(r"\p{L}"))
    each = inner.select(_without_stops(F.col("inner")).alias("word"), F.col("inner").endswith(".").alias("stop"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop").cast("long")).alias("n_stop"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """``(word, n, n_stop, score)`` for words that occur with a stop.

    Twice the log-likelihood ratio of a stop that nearly always follows to one that follows as it
    follows all words; less for long words and for each occurrence without a stop, more for stops inside.
    """
    total, stops = counts.agg(F.sum("n"), F.sum("n_stop")).first()
    rate = F.lit(min(max((stops or 0) / (total or 1), 1e-9), 1 - 1e-9))
    n, k = F.col("n").cast("double"), F.col("n_stop").cast("double")
    ratio = 2 * (_likelihood(k, n, F.lit(ALWAYS)) - _likelihood(k, n, rate))
    inside = F.length(F.regexp_replace("word", r"[^.]", ""))
    letters = (F.length("word") - inside).cast("double")
    score = ratio * F.exp(-letters) * (inside + 1) * F.pow(letters, -(n - k))
    return counts.filter("n_stop > 0").select("word", "n", "n_stop", score.alias("score"))


def starter_scores(docs: DataFrame, counts: DataFrame, abbreviations: tuple[str, ...], text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """``(word, n, n_first, score)``: words that follow sentence ends, other than stops of abbreviations, more often
    than words do; the score is the log-likelihood ratio. ``more`` has further abbreviations ``(word)``."""
    pieces = docs.select(_pieces(F.coalesce(F.col(text_col), F.lit(""))).alias("p"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(_last(F.get("p", i - 1)).alias("end"), _first(F.get("p", i)).alias("next")))
    each = pieces.select(F.explode(F.when(F.size("p") > 1, pairs)).alias("b")).filter(~_is_abbreviation(F.col("b.end"), abbreviations))
    if more is None:
        words = each.select(_type(F.col("b.next")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_first"))
    else:  # a row per pair of words meets the list, and pairs without a stop do not
        pairs = each.select(_stopped(F.col("b.end")).alias("end"), _type(F.col("b.next")).alias("word")).groupBy("end", "word").agg(F.count(F.lit(1)).alias("n"))
        pairs = materialize(pairs, "pairs")
        others = pairs.filter("end is not null").join(more.select(F.col("word").alias("end")), "end", "left_anti")
        words = pairs.filter("end is null").unionByName(others).groupBy("word").agg(F.sum("n").alias("n_first"))
    first = materialize(words, "starts")
    ends = first.agg(F.sum("n_first")).first()[0] or 0
    total = counts.agg(F.sum("n")).first()[0] or 0
    both = first.join(counts.select("word", "n"), "word").withColumn("n_first", F.least("n_first", "n"))
    a, b, ab, all_ = F.lit(float(ends)), F.col("n").cast("double"), F.col("n_first").cast("double"), F.lit(float(max(total, ends + 1)))
    clip = lambda p: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    p, p1, p2 = clip(b / all_), clip(ab / a), clip((b - ab) / (all_ - a))
    ratio = 2 * (_likelihood(ab, a, p1) + _likelihood(b - ab, all_ - a, p2) - _likelihood(ab, a, p) - _likelihood(b - ab, all_ - a, p))
    more = ab * all_ > a * b
    return both.filter(more).select("word", "n", "n_first", ratio.alias("score"))


def _ends_in_stop(token: Column) -> Column:
    stop, other = (token.rlike(rf"(?s)^(?>.*{end})[^\p{{L}}\p{{N}}]*$") for end in (r"\.", "[!?]"))
    return stop & ~other


def _stopped(token: Column) -> Column:
    """The word of a token with a stop; null for other tokens."""
    return _bound(token, lambda t: F.when(_ends_in_stop(t), _type(t)))


def _listed(word: Column, abbreviations: tuple[str, ...]) -> Column:
    return (word.isin(list(abbreviations)) if abbreviations else F.lit(False)) | word.rlike(r"^\p{L}$")


def _is_abbreviation(token: Column, abbreviations: tuple[str, ...]) -> Column:
    """A token with a stop whose word is in the list, or is a single letter."""
    return _bound(token, lambda t: _ends_in_stop(t) & _bound(_type(t), lambda word: _listed(word, abbreviations)))


def _capitalised(token: Column) -> Column:
    return token.rlike(r"^[^\p{L}\p{N}]*\p{Lu}")


def _words(scores: DataFrame, least: float, most: int, label: str) -> tuple[tuple[str, ...], DataFrame | None]:
    """Words that score at least ``least``: the best ``most``, and a table of the others if there are any."""
    found = materialize(scores.filter(F.col("score") >= least).select("word", "score"), label)
    best = found.orderBy(F.desc("score"), "word").limit(most).collect()
    if found.count() == len(best):
        more = None
    elif best:
        last = best[-1]
        more = found.filter((F.col("score") < last["score"]) | (F.col("score") == last["score"]) & (F.col("word") > last["word"])).select("word")
    else:
        more = found.select("word")
    return tuple(sorted(r["word"] for r in best)), more


def learn(docs: DataFrame, text_col: str = "text", most: int = MOST) -> Boundaries:
    """Abbreviations and starters of a corpus: the ``most`` of each with the best scores as words, others as tables."""
    counts = materialize(word_counts(docs, text_col), "words")
    abbreviations, short = _words(abbreviation_scores(counts), ABBREVIATION, most, "abbreviations")
    starters, first = _words(starter_scores(docs, counts, abbreviations, text_col, short), STARTER, most, "starters")
    return Boundaries(abbreviations, starters, short, first)


def _joined(pieces: Column, places: Column) -> Column:
    """Pieces as sentences that begin at ``places``."""
    return _bound(
        places, lambda at: F.transform(at, lambda a, j: F.array_join(F.slice(pieces, a + 1, F.coalesce(F.get(at, j + 1), F.size(pieces)) - a), " "))
    )


def _cut(text: Column, places: Callable[[Column], Column]) -> Column:
    """Sentences of a text, whose pieces tell the places where they begin."""
    none = F.array().cast("array<string>")
    # Pieces and starts are bound as lambda variables, else they would be computed anew for every piece.
    return _bound(_pieces(F.coalesce(text, F.lit(""))), lambda p: F.when(F.size(p) > 0, _joined(p, places(p))).otherwise(none))


def sentences(text: Column, boundaries: Boundaries) -> Column:
    """Sentences as an array; null and blank texts have none.

    A text is cut after ``.``, ``!`` or ``?`` and white space, but not after an abbreviation or a single
    letter unless a capitalised starter follows. Parts that belong together are joined by one blank. Nothing is
    shuffled, and the work is in proportion to the text. Boundaries with tables need ``cut``.
    """
    if boundaries.more_abbreviations is not None or boundaries.more_starters is not None:
        raise ValueError("these boundaries have more words than are sent to tasks: use cut()")
    starters = list(boundaries.starters)

    def begins(pieces: Column, i: Column) -> Column:
        following = _first(F.get(pieces, i))
        starts = _type(following).isin(starters) & _capitalised(following) if starters else F.lit(False)
        return (i == 0) | ~_is_abbreviation(_last(F.get(pieces, i - 1)), boundaries.abbreviations) | starts

    return _cut(text, lambda p: F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: begins(p, i)))


def _looked_up(stops: DataFrame, words: DataFrame | None, on: str, mark: str) -> DataFrame:
    """``stops`` with whether the word in column ``on`` is in a table of words."""
    if words is None:
        return stops.withColumn(mark, F.lit(False))
    table = words.select(F.col("word").alias(on), F.lit(True).alias(mark))
    return lookup_join(stops, table, on, "left", spread="spot").withColumn(mark, F.coalesce(mark, F.lit(False)))


def cut(docs: DataFrame, boundaries: Boundaries, text_col: str = "text", name: str = "sentences") -> DataFrame:
    """``docs`` with a column of their ``sentences``, by all words of both lists however long they are.

    Words that are not sent to the tasks are looked up by joins of the stops alone; places that turn out to lie
    inside a sentence go back to the texts, which are stored and shuffled once for that.
    """
    if boundaries.more_abbreviations is None and boundaries.more_starters is None:
        return docs.withColumn(name, sentences(F.col(text_col), boundaries))
    stored = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "texts")

    def stop(pieces: Column, i: Column) -> Column:
        following = _first(F.get(pieces, i))
        start = _bound(following, lambda t: F.when(_capitalised(t), _type(t)))
        return F.struct(i.alias("i"), _stopped(_last(F.get(pieces, i - 1))).alias("end"), start.alias("start"))

    pieces = stored.select("_row", _pieces(F.coalesce(F.col(text_col), F.lit(""))).alias("p"))
    each = pieces.select("_row", F.explode(F.when(F.size("p") > 1, F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: stop(F.col("p"), i)))).alias("b"))
    starter = F.col("start").isin(list(boundaries.starters)) if boundaries.starters else F.lit(False)
    stops = each.select("_row", "b.*").filter(F.col("end").isNotNull() & ~F.coalesce(starter, F.lit(False)))
    stops = stops.select("*", F.xxhash64("_row", "i").alias("spot"), _listed(F.col("end"), boundaries.abbreviations).alias("short"))
    stops = materialize(stops, "stops")
    short = _looked_up(stops, boundaries.more_abbreviations, "end", "long_list").filter("short or long_list")
    inside = _looked_up(materialize(short, "stops"), boundaries.more_starters, "start", "begins").filter("not begins")
    places = inside.groupBy("_row").agg(F.collect_set("i").alias("_inside"))
    # Places are taken away as a set, so that a text of very many pieces takes time in proportion.
    left = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.coalesce("_inside", F.array().cast("array<int>")))
    return stored.join(places, "_row", "left").withColumn(name, _cut(F.col(text_col), left)).select(*docs.columns, name)
