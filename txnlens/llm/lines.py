"""Lines whose template recurs across documents, dropped by a log-template tree of fixed depth.

A line goes down the tree by its number of tokens and then by its leading tokens, those that hold a
digit generalised to a wildcard. In the leaf, tokens further on are compared place by place: a place
where most lines have the same token is constant, others hold variable fields and are generalised as
well. What is then left of a line is its template, unless wildcards outweigh it: then the line itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.operators.joins import BROADCAST_BYTES, table_bytes
from txnlens.session import materialize, shuffle_partitions

WILDCARD = "<*>"
# The filter of leaves: four bits for each leaf in one of the blocks, of which a leaf pays for sixteen.
FILTER_BYTES = 8 << 20
_LEAF_BITS = 16
_BLOCK_BITS = 1 << 15
_BLOCK_WORDS = _BLOCK_BITS // 64
# So many leaves are sent to the lines as a filter.
BROADCAST_LEAVES = FILTER_BYTES * 8 // _LEAF_BITS
# Constant places of leaves are broadcast up to so many bytes; the driver holds them several times.
PLACES_BYTES = BROADCAST_BYTES // 2
# Tokens are runs of characters other than these.
_SPACE = r"[\x20\x09-\x0D]+"


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, _SPACE), lambda t: t != "")


def _general(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(token)


def _name(*parts: Column) -> Column:
    """128 bits that tell values apart."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(*reversed(parts)).alias("b"))


def _leaf(tokens: Column, depth: int) -> Column:
    """Path to the leaf: token count and leading tokens, variable fields generalised."""
    return _name(F.size(tokens), F.transform(F.slice(tokens, 1, depth), _general))


def _template(tokens: Column, constant: Column, depth: int) -> Column:
    """What is constant in a line, or the line itself if that is less than half of its tokens."""
    general = F.transform(
        tokens, lambda t, i: F.when((i < depth) | F.coalesce(F.get(constant, i - depth), F.lit(False)), _general(t)).otherwise(F.lit(WILDCARD))
    )
    told = F.size(F.filter(general, lambda t: t != WILDCARD))
    plain = 2 * told < F.size(tokens)
    return _name(plain, F.when(plain, tokens).otherwise(general))


def _recurring(lines: DataFrame, name: str, min_docs: int) -> DataFrame:
    """Names that the lines of enough documents have, with the first of them and the number of lines; reduced to a
    row per name and document before they meet."""
    each = lines.groupBy(name, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    found = each.groupBy(name).agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"), F.sum("n").alias("n"))
    return found.filter(F.col("docs") >= min_docs).select(name, "first", "n")


def _shares(counts: DataFrame, name: str) -> DataFrame:
    """``(name, salts)`` of names with more than an even share of the lines, at most as many as shuffle partitions."""
    share = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // shuffle_partitions(counts.sparkSession))
    return counts.filter(F.col("n") > share).select(name, F.ceil(F.col("n") / share).cast("int").alias("salts"))


def _meet(lines: DataFrame, found: DataFrame, name: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """Join lines with what is known of their names; ``counts`` is stored and has the number ``n`` of lines of a name.

    Lines of a name with more than an even share of them meet in as many parts as it has shares, all others once.
    """
    hot = F.broadcast(_shares(counts, name))
    salts = F.coalesce("salts", F.lit(1))
    salted = lines.join(hot, name, "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), salts).cast("int")).drop("salts")
    every = found.join(hot, name, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return salted.join(every, [name, "salt"], how).drop("salt")


def _filter(leaves: DataFrame, blocks: int) -> DataFrame:
    """``(block, words)``: the bits of all leaves in ``blocks`` blocks."""
    place = F.explode(F.array(*[F.shiftrightunsigned("leaf.b", 15 * k).bitwiseAND(_BLOCK_BITS - 1) for k in range(4)]))
    bits = leaves.select(F.pmod("leaf.a", F.lit(blocks)).alias("block"), place.alias("place"))
    ones = bits.select("block", F.shiftright("place", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int")).alias("bits"))
    none = leaves.sparkSession.range(blocks * _BLOCK_WORDS).select(F.shiftright("id", 9).alias("block"), F.col("id").bitwiseAND(_BLOCK_WORDS - 1).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = ones.unionByName(none).groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("words"))


def _passes(lines: DataFrame, leaves: DataFrame, count: int) -> DataFrame:
    """Lines whose leaf is among ``count`` leaves, and about one in 400 others."""
    blocks = -(-max(1, count) * _LEAF_BITS // _BLOCK_BITS)
    word = lambda k: F.get("words", F.shiftrightunsigned("leaf.b", 15 * k + 6).bitwiseAND(_BLOCK_WORDS - 1).cast("int"))
    bit = lambda k: F.getbit(word(k), F.shiftrightunsigned("leaf.b", 15 * k).bitwiseAND(63).cast("int")) == 1
    there = F.broadcast(_filter(leaves, blocks))
    return lines.join(there, (F.pmod("leaf.a", F.lit(blocks)) == F.col("block")) & bit(0) & bit(1) & bit(2) & bit(3), "left_semi")


def _lines(slim: DataFrame, depth: int) -> DataFrame:
    lines = slim.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", _tokens(F.col("line")).alias("tokens"))
    return lines.filter(F.size("tokens") > 0).select("doc_id", "pos", "tokens", _leaf(F.col("tokens"), depth).alias("leaf"))


def _shared_lines(slim: DataFrame, min_docs: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, pos, tokens, leaf)`` of lines whose leaf enough documents have, stored; no others can go. And ``(leaf, n)``,
    the number of lines of each such leaf.

    Leaves are sent to the lines as a filter. It lets few others pass, and those do no harm: lines of one
    template are of one leaf, so theirs never recur. Of very many leaves, places of lines are found first, and only
    the lines there leave their texts, so that whole lines never move to their leaves.
    """
    placed = _lines(slim, depth)
    leaves = materialize(_recurring(placed, "leaf", min_docs).select("leaf", "n"), "leaves")
    count = leaves.count()
    if count <= BROADCAST_LEAVES:
        return materialize(_passes(placed, leaves, count), "lines"), leaves
    found = _meet(placed.select("doc_id", "pos", "leaf"), leaves.select("leaf"), "leaf", leaves).groupBy("doc_id").agg(F.collect_set("pos").alias("places"))
    cut = F.transform(F.array(F.split("text", "\n")), lambda every: F.transform("places", lambda i: F.struct(i.alias("pos"), F.get(every, i).alias("line"))))
    there = slim.join(found, "doc_id").select("doc_id", F.explode(cut[0]).alias("l")).select("doc_id", "l.pos", F.col("l.line").alias("line"))
    # Several texts of an id may lack some of its places.
    named = there.filter(F.col("line").isNotNull()).select("doc_id", "pos", _tokens(F.col("line")).alias("tokens")).filter(F.size("tokens") > 0)
    return materialize(named.withColumn("leaf", _leaf(F.col("tokens"), depth)), "lines"), leaves


def _constant(lines: DataFrame, depth: int) -> DataFrame:
    """``(leaf, constant)``: for each place beyond ``depth``, whether one token has at least half of a leaf's lines there."""
    tail = lines.filter(F.size("tokens") > depth).select("leaf", F.posexplode(F.slice("tokens", depth + 1, F.size("tokens"))).alias("i", "token"))
    counted = tail.groupBy("leaf", "i", "token").agg(F.count(F.lit(1)).alias("k"))
    shares = counted.groupBy("leaf", "i").agg(F.max("k").alias("most"), F.sum("k").alias("n")).filter(2 * F.col("most") >= F.col("n"))
    places = shares.groupBy("leaf").agg(F.collect_list("i").alias("places"))
    known = F.transform(F.sequence(F.lit(0), F.array_max("places")), lambda i: F.array_contains("places", i))
    return places.select("leaf", known.alias("constant"))


def drop_template_lines(docs: DataFrame, min_docs: int = 3, depth: int = 6) -> DataFrame:
    """``docs`` with the lines gone whose template at least ``min_docs`` documents have.

    The document with the smallest ``doc_id`` keeps its lines of a template. A line that goes agrees
    with one that stays in its number of tokens and in at least half of them, or in all; what differs,
    and is lost, are tokens with a digit and those beyond the first ``depth`` at places where no token
    has half of the lines that share the number of tokens and the leading ones. Lines end with a line
    feed; blank ones always stay. All rows and columns are kept, but ``text``
    holds the lines that are left and ``n_chars``, if there is one, its length where lines are gone.
    Null texts stay null. Rows with equal ``doc_id`` count as one document, and lines at the same
    place go from all of them; rows with a null id are left as they are.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    shared, leaves = _shared_lines(slim, min_docs, depth)
    places = materialize(_constant(shared, depth), "places")
    few = table_bytes(places) <= min(PLACES_BYTES, BROADCAST_LEAVES * 64)
    known = shared.join(F.broadcast(places), "leaf", "left") if few else _meet(shared, places, "leaf", leaves, "left")
    constant = F.coalesce("constant", F.array().cast("array<boolean>"))
    named = known.select("doc_id", "pos", _template(F.col("tokens"), constant, depth).alias("template"))
    named = materialize(named, "templates")
    found = materialize(_recurring(named, "template", min_docs), "found")
    dropped = _meet(named, found.select("template", "first"), "template", found).filter("doc_id > first")
    gone = dropped.groupBy("doc_id").agg(F.collect_set("pos").alias("gone")).select(F.col("doc_id").alias("gone_id"), "gone")

    joined = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id")).join(gone, F.col("id") == F.col("gone_id"), "left")
    old = F.col("row.text").cast("string")
    whole = F.col("gone").isNull()
    # Places are taken away as a set, so that a text of very many lines takes time in proportion.
    cut = F.split(old, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("gone"))
    kept = F.element_at(F.transform(F.array(cut), lambda all_lines: F.transform(left, lambda i: F.get(all_lines, i))), 1)
    rebuilt = joined.select("row", whole.alias("whole"), F.when(whole, old).otherwise(F.array_join(kept, "\n")).alias("left_over"))
    new = {"text": F.col("left_over")}
    if "n_chars" in docs.columns:
        length = F.length("left_over").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("whole"), F.col("row.n_chars")).otherwise(length)
    return rebuilt.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
