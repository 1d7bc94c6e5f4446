from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, version string, fp string, rid string"
TOXIC = ("idiot", "scum", "moron")


def corpus(seed: int = 5, n: int = 120) -> list[tuple]:
    """Small documents with nulls, empty, long, repeated and near-copied texts, ties, and columns with names that operators use themselves."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Été", "naïve.", "ß", "x,y"]
    text = lambda k: "".join(r.choice(words) + r.choice([" ", " ", "\n", "\t ", " "]) for _ in range(k))
    passage = text(60)
    out = []
    for k in range(n):
        t = text(r.choice([1, 2, 3, 40, 80, 150]))
        if k % 9 == 0:
            t = t + passage + text(30)
        if k % 10 == 3:
            t = f"{t} {r.choice(TOXIC)} {text(3)} {r.choice(TOXIC)}"
        if k % 12 == 5:
            t = out[r.randrange(len(out))][1] or ""
            t = t.upper() if k % 24 == 5 else t
        out.append((k, t))
    out[7], out[8], out[20] = (7, None), (8, ""), (20, " \n\t")
    out[30] = (30, text(9000))
    out[31] = (31, out[30][1] + " more")
    out.append((None, "no id here"))
    out.append(out[4])  # a repeated row
    out.append(out[30])
    sources = ["a", "b", None, "ü", "c"]
    return [(d, t, "en", sources[0 if k % 3 else k % 5], len(t or ""), "v", "f", "r") for k, (d, t) in enumerate(out)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def words(t):
    return (t or "").encode().split()
