"""Paragraphs to section blocks.

A heading closes the running block. Level 1 sets the section and clears the subsection, level 2
sets the subsection, and the text of any other heading becomes part of the block it opens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.functions.text import clean_text, heading_level, is_all_caps, word_count
from txnlens.operators.ranges import block_ranges_of

MAX_CAPS_WORDS = 6
# Paragraphs of a document that one window frame runs over; longer documents are cut and carried.
SLICE = 4096


def level_of(style: Column, text: Column) -> Column:
    """Heading level of a cleaned paragraph by its style, or by short text in capitals; else null."""
    styled = F.coalesce(style.startswith("Heading"), F.lit(False))
    caps = is_all_caps(text) & (word_count(text) <= MAX_CAPS_WORDS)
    return F.when(styled, heading_level(style)).when(caps, 2)


def elements(paragraphs: DataFrame) -> DataFrame:
    """``(doc_id, pos, type, level, text)``: cleaned paragraphs, blank ones dropped."""
    cleaned = paragraphs.withColumn("text", clean_text(F.col("text"))).filter(F.col("text") != "")
    levelled = cleaned.withColumn("level", level_of(F.col("style_name"), F.col("text")))
    kind = F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph")
    return levelled.select("doc_id", "pos", kind.alias("type"), "level", "text")


def _line(at: Column) -> Column:
    return F.when(at.isNotNull(), F.get(F.col("_lines"), at)["text"])


def document_blocks(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    style: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``(doc_id, block_index, section, subsection, text)`` of documents that are one row each.

    The lines are the paragraphs; ``style`` maps a line number to a style name. A row has its whole
    document, so everything happens inside the row: no shuffle, in time linear in its lines, and
    later steps stay in the same stage. A value is limited to 2 GB, so a document is as well; for
    documents stored as paragraph rows use ``blocks``, where only one block has to fit.
    """

    def element(line: Column, pos: Column) -> Column:
        text = clean_text(line)
        name = F.lit("") if style is None else style(pos)
        return F.struct(text.alias("text"), level_of(name, text).alias("level"))

    lines = F.filter(F.transform(F.split(text_col, "\n"), element), lambda e: e["text"] != "")
    rows = documents.select(F.col(id_col).alias("doc_id"), lines.alias("_lines"))
    rows = rows.withColumn("_ranges", block_ranges_of(F.col("_lines.level")))
    found = F.transform(
        "_ranges",
        lambda r: F.struct(
            _line(r["section"]).alias("section"),
            _line(r["subsection"]).alias("subsection"),
            F.array_join(F.slice("_lines", r["a"] + 1, r["b"] - r["a"] + 1)["text"], " ").alias("text"),
        ),
    )
    out = rows.select("doc_id", F.posexplode(found).alias("block_index", "_block"))
    return out.select("doc_id", "block_index", "_block.section", "_block.subsection", "_block.text")


def blocks(elements: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """``(doc_id, block_index, section, subsection, text)`` of documents given as paragraph rows.

    Section, subsection and block number run along a document. They are computed per slice of a
    document and then carried over its slices (one row each), so that one huge document is spread
    over many tasks. Texts are first joined within the slice, then per block.
    """
    level = F.when(F.col("type") == "heading", F.coalesce("level", F.lit(1)))
    kept = F.coalesce(~level.isin(1, 2), F.lit(True))
    rows = elements.withColumns(
        {
            "slice": F.floor(F.col("pos") / slice_rows),
            "kept": kept,
            "is_heading": level.isNotNull(),
            "h1": F.when(level == 1, F.col("text")),
            # Latest level 1 or 2 heading; level 1 leaves the subsection empty.
            "mark": F.when(level == 1, F.struct(F.lit(None).cast("string").alias("sub"))).when(
                level == 2, F.struct(F.col("text").alias("sub"))
            ),
        }
    )
    along = Window.partitionBy("doc_id", "slice").orderBy("pos")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prev_kept = F.lag("kept").over(along)
    # The first kept row after a heading opens a block. At the start of a slice the row before is
    # in another slice: such an opening is counted by the carry.
    opens = (F.col("kept") & (F.col("is_heading") | ~F.coalesce(prev_kept, F.lit(True)))).cast("int")
    local = rows.withColumns({"opens": opens, "_first": prev_kept.isNull()}).withColumns(
        {
            "n_open": F.sum("opens").over(upto),
            "l_section": F.last("h1", ignorenulls=True).over(upto),
            "l_mark": F.last("mark", ignorenulls=True).over(upto),
        }
    )
    carry = _carry(rows)
    joined = local.join(carry, ["doc_id", "slice"])
    placed = joined.filter("kept").select(
        "doc_id",
        "slice",
        "pos",
        "text",
        (F.col("c_open") + F.col("n_open") - 1).cast("int").alias("block_index"),
        F.coalesce("l_section", "c_section").alias("section"),
        F.coalesce("l_mark", "c_mark")["sub"].alias("subsection"),
    )
    keys = ["doc_id", "slice", "block_index", "section", "subsection"]
    parts = placed.groupBy(*keys).agg(F.expr("listagg(text, ' ') within group (order by pos)").alias("text"))
    whole = parts.groupBy("doc_id", "block_index", "section", "subsection").agg(
        F.expr("listagg(text, ' ') within group (order by slice)").alias("text")
    )
    return whole.select("doc_id", "block_index", "section", "subsection", F.trim("text").alias("text"))


def _carry(rows: DataFrame) -> DataFrame:
    """State at the start of every slice: ``(doc_id, slice, c_open, c_section, c_mark)``."""
    edge = rows.select("doc_id", "slice", "pos", "kept", "is_heading", "h1", "mark")
    along = Window.partitionBy("doc_id", "slice").orderBy("pos")
    prev_kept = F.lag("kept").over(along)
    edge = edge.withColumns(
        {
            "opens": (F.col("kept") & (F.col("is_heading") | ~F.coalesce(prev_kept, F.lit(True)))).cast("int"),
            # Plain text at the start of a slice opens a block unless the one before goes on.
            "may_open": prev_kept.isNull() & F.col("kept") & ~F.col("is_heading"),
        }
    )
    slices = edge.groupBy("doc_id", "slice").agg(
        F.sum("opens").alias("opened"),
        F.bool_or("may_open").alias("may_open"),
        F.max_by("kept", "pos").alias("last_kept"),
        F.max_by("h1", F.when(F.col("h1").isNotNull(), F.col("pos"))).alias("h1"),
        F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("pos"))).alias("mark"),
    )
    over_doc = Window.partitionBy("doc_id").orderBy("slice")
    before = over_doc.rowsBetween(Window.unboundedPreceding, -1)
    starts = F.col("may_open") & ~F.coalesce(F.lag("last_kept").over(over_doc), F.lit(False))
    slices = slices.withColumn("starts", starts.cast("int"))
    return slices.select(
        "doc_id",
        "slice",
        (F.coalesce(F.sum(F.col("opened") + F.col("starts")).over(before), F.lit(0)) + F.col("starts")).alias("c_open"),
        F.last("h1", ignorenulls=True).over(before).alias("c_section"),
        F.last("mark", ignorenulls=True).over(before).alias("c_mark"),
    )
