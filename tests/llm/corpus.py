"""Small corpora with the awkward cases: nulls, blanks, ties, repeats, long texts, clashing column names."""

import random

SCHEMA = "doc_id long, text string, source string, chunk int, keys string, gone string, `row` string, id string, copy string, leaf string, n_chars long"


def frame(spark, rows, source=lambda i: "s"):
    """``(doc_id, text)`` as documents whose other columns are named like those the operators use."""
    full = [(i, t, source(i), 1, "k", "g", "r", "x", "c", "l", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, size=40):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus(seed=1):
    """Texts with exact and near copies, shared passages, blanks, nulls, repeated rows and one long text."""
    rng = random.Random(seed)
    passage = words(rng, 20, 1000)
    base = words(rng, 60, 1000)
    rows = []
    for i in range(0, 60, 2):
        kind = i % 10
        if kind == 0:
            near = list(base)
            near[rng.randrange(60)] = f"x{i}"
            text = " ".join(near)
        elif kind == 2:
            text = " ".join(words(rng, 10, 1000) + passage + words(rng, 10, 1000))
        elif kind == 4:
            text = "  ".join(base) + "\n"
        elif kind == 6:
            text = " ".join(words(rng, 30, 4))
        else:
            text = " ".join(words(rng, rng.randrange(1, 40), 1000)) + " é\u3000ß"
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "one"), (105, "ONE two"), (106, "one two")]
    rows += [(7, " ".join(base)), (7, " ".join(base)), (9, " ".join(passage)), (9, "other text under one id")]
    rows += [(110, " ".join(words(rng, 20000, 3000))), (111, "a" * 5000), (112, "a" * 3000)]
    rng.shuffle(rows)
    return rows
