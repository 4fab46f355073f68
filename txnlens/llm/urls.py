"""URL verdicts by pattern rules, each indexed by its rarest literal token.

Every rule has tokens that any URL it fits must hold as whole tokens. The one that is rarest among
the URLs at hand stands for the rule. A URL's tokens fetch the rules that may fit, and only those
run their regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Indexes of up to this many rules are broadcast (some 100 bytes each); larger ones are joined by token.
BROADCAST_RULES = 100_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOKEN = "[A-Za-z0-9]+"
# Fetches the rules that have no whole token; every URL has it.
_ANY = ""


@dataclass(frozen=True)
class Rule:
    """``text`` is ``host/path``: the host and its subdomains, where the path starts so. Or, with ``pattern``, text
    anywhere in host and path in which ``^`` is a separator or an end and ``*`` anything."""

    text: str
    verdict: str
    pattern: bool = False

    @property
    def regex(self) -> str:
        if not self.pattern:
            host, _, path = self.text.partition("/")
            return rf"^(?:[^/]*\.)?{_quoted(host.lower())}{_quoted('/' + path)}"
        special = {"^": "(?:[^A-Za-z0-9]|^|$)", "*": r"[\s\S]*"}
        return "".join(special.get(c) or _quoted(c) for c in self.text)

    @property
    def tokens(self) -> list[str]:
        """Tokens with a separator or a sure end on both sides."""
        if self.pattern:
            return [m[0] for m in re.finditer(_TOKEN, self.text) if m.start() and m.end() < len(self.text) and "*" not in (self.text[m.start() - 1], self.text[m.end()])]
        host, _, path = self.text.partition("/")
        text = f"{host.lower()}/{path}"
        return [m[0] for m in re.finditer(_TOKEN, text) if m.end() < len(text)]


def _quoted(text: str) -> str:
    """Escaped so that Java and RE2 read it alike."""
    return "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in text)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _UPPER.lower()), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: Sequence[Rule], otherwise: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages (page_id, url)``.

    The longest host rule that fits decides and is named in ``rule``. Where none fits ``rule`` is
    null and the longest pattern that fits decides, and else ``otherwise``. Of rules of one length
    blocking comes first, then the smaller text. A null URL, or one without ``://``, has empty host
    and path. Rows with equal ids or URLs are judged each; other columns are not looked at.
    """
    if len({r.text for r in rules if not r.pattern}) < sum(not r.pattern for r in rules):
        raise ValueError("a host rule is given twice")
    spark = pages.sparkSession
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = slim.filter("url is not null").select("url").distinct().select("url", F.concat(host(F.col("url")), path(F.col("url"))).alias("target"))
    tokens = urls.select("url", "target", F.explode(F.array_distinct(F.concat(F.filter(F.split("target", "[^A-Za-z0-9]+"), lambda t: t != ""), F.array(F.lit(_ANY))))).alias("token"))

    # The rules come from the caller, so this table is as large as what the driver holds anyway.
    listed = spark.createDataFrame(
        [(r.text, r.verdict, r.pattern, r.regex, r.tokens or [_ANY]) for r in rules], "rule string, verdict string, pattern boolean, regex string, tokens array<string>"
    )
    small = F.broadcast if len(rules) <= BROADCAST_RULES else lambda df: df
    literal = listed.select("rule", "pattern", "verdict", "regex", F.explode("tokens").alias("token"))
    counts = tokens.join(small(literal.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = (
        literal.join(counts, "token", "left")
        .groupBy("rule", "pattern", "verdict", "regex")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    fits = tokens.join(small(index), "token").filter(F.expr("target rlike regex"))
    rank = F.struct("pattern", (-F.length("rule")).alias("length"), (F.col("verdict") != "block").alias("mild"), "rule", "verdict")
    best = fits.groupBy("url").agg(F.min(rank).alias("best"))
    out = slim.join(best, "url", "left")
    return out.select(
        "page_id",
        host(F.col("url")).alias("host"),
        path(F.col("url")).alias("path"),
        F.when(~F.col("best.pattern"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
    )
