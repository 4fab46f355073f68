"""Operators in column functions alone: mixing, lines, URLs."""

import hashlib
import math
import re

import pytest
from corpus import SCHEMA, corpus, frame
from pyspark.sql import functions as F

from txnlens.llm import lines, mixing, queries
from txnlens.llm.lines import drop_template_lines
from txnlens.llm.mixing import mix
from txnlens.llm.urls import Rule, judge
from txnlens.operators.joins import table_bytes

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op2_mix_sources", "op7_line_dedup", "op8_url_filter"])
def test_no_python_in_tasks(spark, name):
    plan = plan_of(queries.QUERIES[name](spark, SF))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


# -- mixing


def drawn(i, rate, seed, text=None):
    """Plain version: copies of a document."""
    i = "text:" + hashlib.md5((text or "").encode()).hexdigest() if i is None else i
    parts = math.ceil(rate / mixing.PART_MEAN)
    total = 0
    for k in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{i}:{k}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate / parts)
        n = 0
        while u >= c and n < mixing.TERMS:
            n += 1
            p *= rate / parts / n
            c += p
        total += n
    return total


@pytest.mark.parametrize("broadcast", [True, False])
def test_mix(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rows = [(i, f"t{i}") for i in range(300)] + [(None, "n"), (5, "again")]
    source = lambda i: None if i is None else ("hot" if i % 3 else "rare" if i % 30 == 0 else "unnamed")
    docs = frame(spark, rows, source)
    weights = {"hot": 1.0, "rare": 3.0, None: 0.5, "absent": 1.0}
    sizes = {}
    for i, _ in rows:
        sizes[source(i)] = sizes.get(source(i), 0) + 1
    used = sum(w for s, w in weights.items() if s in sizes)
    want = {}
    for i, t in rows:
        n = drawn(i, 1000 * weights.get(source(i), 0) / used / sizes[source(i)], 3, t) if source(i) in weights else 0
        for c in range(1, n + 1):
            want[i, t, c] = want.get((i, t, c), 0) + 1
    out = mix(docs, weights, total=1000, seed=3)
    assert out.columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    got = {}
    for r in out.collect():
        got[r["doc_id"], r["text"], r["copy"]] = got.get((r["doc_id"], r["text"], r["copy"]), 0) + 1
    assert got == want
    rare = sum(n for (i, _, _), n in got.items() if i is not None and source(i) == "rare")
    assert abs(rare - 1000 * 3 / used) < 4 * math.sqrt(1000 * 3 / used)


def test_rows_without_ids_meet_their_weights(spark):
    """Every id is null: texts are drawn one by one, and their copies go to all partitions."""
    docs = spark.range(6000, numPartitions=4).selectExpr("cast(null as long) as doc_id", "concat('t', id) as text", "concat('s', id % 3) as source")
    weights = {"s0": 1.0, "s1": 2.5, "s2": 5.0}
    out = mix(docs, weights, total=17000, seed=1)
    got = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    for name, weight in weights.items():
        wanted = 17000 * weight / 8.5
        assert abs(got[name] - wanted) < 5 * math.sqrt(wanted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [len(p) for p in mix(docs, weights, total=17000, seed=1).rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 2 and min(sizes) > 0.5 * sum(sizes) / len(sizes)
    again = mix(docs.repartition(7), weights, total=17000, seed=1)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_mix_without_rows_or_weight(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mix(none, 0.5).count() == 0
    docs = frame(spark, [(1, "a"), (2, None)])
    assert mix(docs, {"other": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mix(docs, {"s": -1.0})


def test_mix_is_shuffled(spark):
    docs = frame(spark, [(i, str(i)) for i in range(500)])
    ids = [r["doc_id"] for r in mix(docs, 1.0, total=2000, seed=1).collect()]
    assert sum(a <= b for a, b in zip(ids, ids[1:])) < 0.7 * len(ids)


# -- lines


def tokens_of(text):
    return [[t for t in re.split(r"[\x20\x09-\x0D]+", line) if t] for line in text.split("\n")]


def general(token):
    return "<*>" if re.search("[0-9]", token) else token


def without_templates(rows, min_docs, depth):
    """Plain version."""
    lines = [(i, k, tuple(tokens)) for i, t in rows if i is not None and t is not None for k, tokens in enumerate(tokens_of(t)) if tokens]
    leaf = lambda tokens: (len(tokens), tuple(map(general, tokens[:depth])))
    docs = {}
    for i, _, tokens in lines:
        docs.setdefault(leaf(tokens), set()).add(i)
    lines = [x for x in lines if len(docs[leaf(x[2])]) >= min_docs]
    counts = {}
    for _, _, tokens in lines:
        for p in range(depth, len(tokens)):
            at = counts.setdefault((leaf(tokens), p), {})
            at[tokens[p]] = at.get(tokens[p], 0) + 1

    def template(tokens):
        out = [general(t) if p < depth or 2 * max(counts[leaf(tokens), p].values()) >= sum(counts[leaf(tokens), p].values()) else "<*>" for p, t in enumerate(tokens)]
        return ("plain", tokens) if 2 * sum(t != "<*>" for t in out) < len(out) else ("general", tuple(out))

    seen = {}
    for i, _, tokens in lines:
        seen.setdefault(template(tokens), set()).add(i)
    gone = {}
    for i, k, tokens in lines:
        if len(seen[template(tokens)]) >= min_docs and i > min(seen[template(tokens)]):
            gone.setdefault(i, set()).add(k)
    out = []
    for i, t in rows:
        if t is not None and i in gone:
            t = "\n".join(line for k, line in enumerate(t.split("\n")) if k not in gone[i])
        out.append((i, t))
    return out


def test_lines_that_say_something_else_stay(spark):
    """Common openings and rows of numbers are no templates; what goes agrees with a line that stays."""
    opening = "we would like to thank all"
    rows = [(i, f"{opening} people {w} who came to see us") for i, w in enumerate(["kind", "good", "old", "kind", "dear", "new"])]
    rows += [(10 + i, f"{opening} {' '.join(w + str(i) for w in 'pqrstu')}\n{i} {i + 1} {i * 7}\n1 2 3") for i in range(5)]
    rows += [(20 + i, f"user {i} logged in from host {h} today\nalpha beta gamma delta epsilon zeta {a} {b} {c}") for i, (h, a, b, c) in enumerate([("a", "x", "y", "z"), ("b", "x", "q", "z"), ("c", "x", "r", "w"), ("d", "k", "s", "z")])]
    found = dict(map(tuple, drop_template_lines(frame(spark, rows)).select("doc_id", "text").collect()))
    assert found == dict(without_templates(rows, 3, 6))
    # One field after the leading tokens varies and the rest agrees: a template.
    assert found[0] == rows[0][1] and all(found[i] == "" for i in range(1, 6))
    # Beyond a common opening nothing agrees, and rows of numbers say nothing else: those go only if equal.
    assert found[10].split("\n")[1:] == ["0 1 0", "1 2 3"]
    assert all(found[10 + i].split("\n")[-1] == f"{i} {i + 1} {i * 7}" for i in range(2, 5))
    # Users and hosts are fields; three places of nine that vary leave enough in common.
    assert found[20] == rows[11][1] and all("logged" not in found[20 + i] for i in (1, 2, 3))
    # Whatever goes has a line that stays and agrees in at least half of the tokens.
    stays = [line.split() for t in found.values() for line in t.split("\n") if line]
    for i, t in rows:
        for line in set(t.split("\n")) - set(found[i].split("\n")):
            assert any(len(s) == len(line.split()) and 2 * sum(a == b for a, b in zip(s, line.split())) >= len(s) for s in stays)


@pytest.mark.parametrize("depth,broadcast", [(2, True), (6, True), (6, False)])
def test_lines(spark, monkeypatch, depth, broadcast):
    if not broadcast:
        monkeypatch.setattr(lines, "BROADCAST_LEAVES", 0)
    rows = corpus(6)
    for i in range(30):
        rows.append((300 + i, f"own line {chr(97 + i)}x yes\n\nPage {i} of 30 pages\r\nUser u{i} logged in from here at {i}:00 today then {i} left\nAll rights reserved."))
    rows += [(None, "All rights reserved."), (400, "All rights reserved."), (401, "\n\n"), (300, "second row of an id\nPage 3 of 30 pages")]
    found = drop_template_lines(frame(spark, rows), min_docs=3, depth=depth)
    assert found.columns == frame(spark, []).columns
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str) == sorted(without_templates(rows, 3, depth), key=str)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found.collect())
    assert drop_template_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def many_leaves():
    """Documents of ten lines; three have the same, so that there are 7,000 leaves."""
    return [(i, "\n".join(f"{chr(97 + i % 700 // 26)}{chr(97 + i % 700 % 26)} line of {'ab' * k}" for k in range(10))) for i in range(2100)]


def test_leaves_are_sent_as_a_filter(spark, monkeypatch):
    """The driver never holds a table of leaves: every leaf passes the filter, few others, at sixteen bits a leaf."""
    n = 60_000
    leaf = F.struct(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b")).alias("leaf")
    leaves = spark.range(n).select(leaf, F.lit(3).alias("n"))
    blocks = lines._filter(leaves, 30).collect()
    assert len(blocks) == 30 and all(len(b["words"]) == 512 for b in blocks)
    passed = [r["id"] for r in lines._passes(spark.range(2 * n).select("id", leaf), leaves, n).select("id").collect()]
    assert sorted(i for i in passed if i < n) == list(range(n)) and len(passed) - n < n / 100

    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(table_bytes(df)) or broadcast(df))
    found = drop_template_lines(frame(spark, many_leaves()))
    assert found.filter("text <> ''").count() == 700 and max(sent) < 100_000


def test_names_meet_in_as_many_parts_as_they_fill(spark):
    """A name that all lines have is cut, and the many others are not multiplied by the number of partitions."""
    there = spark.range(6000).select((F.col("id") + 1).alias("doc_id"), F.lit(0).alias("pos"), F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("name"))
    counts = lines._recurring(there, "name", 1)
    shares = {r["name"]: r["salts"] for r in lines._shares(counts, "name").collect()}
    assert shares == {0: 2}
    got = lines._meet(there, counts.select("name", "first"), "name", counts)
    assert got.count() == 6000 and got.filter("first <> if(name = 0, 1, doc_id)").count() == 0
    left = lines._meet(there, counts.filter("name > 0").select("name", "first"), "name", counts, "left")
    assert left.count() == 6000 and left.filter("first is null").count() == 3000


# -- URLs


RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"), Rule("^spam^", "block", True), Rule("^spam*good^", "allow", True)]


def plain(url):
    """Plain version: host, path, rule, verdict."""
    rest = (url or "").partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in RULES[:4]:
        h, _, p = r.text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.text) > len(best.text)):
            best = r
    if best:
        return host, path, best.text, best.verdict
    target = host + path
    if re.search(r"(?:[^A-Za-z0-9]|^)spam[\s\S]*good(?:[^A-Za-z0-9]|$)", target):
        return host, path, None, "allow"
    return host, path, None, "block" if re.search(r"(?:[^A-Za-z0-9]|^)spam(?:[^A-Za-z0-9]|$)", target) else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://net", "https://net/", "https://a.net/x", "https://planet/x", "http://EXAMPLE.net/en/1?q=/de/", "http://example.net/EN/1",
    "http://example.net?x=/en/", "ftp://a.b.example.com/de/", "http://example.com/de", "http://www.org/fr/#top", "http://org/fr/", "http://borg/fr/", "http://spam.example.com/a",
    "http://x.com/spammer", "http://x.com/spam", "http://x.com/spam/very-good", "http://x.com/spam/good1", "http://h://x.net/", "http://Ünet.net/ü", "http://a.net:80/x",
    "http://x.com/" + "a/" * 5000, "HTTP://X.NET/\n/y",
]


def test_urls(spark):
    rows = [(k % 20, u, k) for k, u in enumerate(URLS * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule int")
    found = judge(pages, RULES).collect()
    assert sorted(map(tuple, found), key=str) == sorted(((i, *plain(u)) for i, u, _ in rows), key=str)
    assert judge(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in judge(pages, []).collect()} == {"allow"}


def test_rule_tokens():
    assert Rule("example.net/en/", "allow").tokens == ["example", "net", "en"]
    assert Rule("example.net/en", "allow").tokens == ["example", "net"]  # the last may go on
    assert Rule("^spam*good^", "allow", True).tokens == []  # a wildcard bounds no token
    assert Rule("^cheap-pills^", "block", True).tokens == ["cheap", "pills"]
