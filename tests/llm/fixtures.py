"""Small documents with every awkward case: nulls, empty, very long, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, body string, score double"


def words(r, n, stems=("th", "er", "in", "on", "re", "an", "es", "ou", "ti", "ha")):
    return " ".join("".join(r.choice(stems) for _ in range(r.randint(1, 4))) for _ in range(n))


def documents(spark, n=40, seed=3):
    r = random.Random(seed)
    base = [words(r, r.randint(3, 200)) for _ in range(n)]
    passage = words(r, 90)
    texts = base + [
        base[0],  # exact copy
        base[1] + " tail",  # near copy
        base[2] + " " + passage,
        passage + "\n" + base[3],
        "é" * 300 + passage + "ü" * 250,
        "a" * 1500,  # periodic
        "line of text again\n" * 60,
        None,
        "",
        "   \n\t ",
        "One",
        words(r, 6000),
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, None if t is None else len(t), 1, "x", 0.5) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base[6], "en", "s1", 1, 1, "x", 0.5), (None, "lone words here now", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
