"""Small documents with the awkward cases, and plain versions of what operators compute."""

import random
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma,", "delta.", "Epsilon", "zeta", "eta", "theta;", "iota", "kappa"]) + str(rng.randrange(40)) for _ in range(n))


def documents(seed=3):
    rng = random.Random(seed)
    base = prose(rng, 120)
    words = base.split(" ")
    shared = prose(rng, 60)
    out = [(1, base), (2, base), (3, " ".join(words[:60] + ["changed"] + words[61:])), (4, " ".join(words[:100])), (5, None), (6, ""), (7, "one two"), (8, "one two"), (9, "  \n\t ")]
    out += [(10, f"{prose(rng, 40)} {shared} {prose(rng, 40)}"), (11, f"{prose(rng, 30)} {shared} {prose(rng, 20)}"), (12, "spam " * 300), (13, "spam " * 200), (14, "ÄÖÜ ß é 日本語 " * 9), (15, "A B I AM HERE, NOT there. X"), (None, base), (None, None)]
    out += [(2, base), (20, "x" * 3000), (21, "y" + "x" * 3000), (22, prose(rng, 2500))]
    return [(i, t, "en", "s", len(t) if t is not None else None) for i, t in out]


def frame(spark, rows=None):
    """Documents with extra columns whose names clash with those that operators make."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    return df.selectExpr("*", "'clash' AS shard", "1 AS n", "'k' AS key", "0 AS start", "'z' AS digest", "1.5 AS score", "'h' AS h", "7 AS label", "'w' AS words")


def shingles(text, k):
    w = SPACE_WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def strip(texts):
    """Bytes left of (doc_id, text) rows after removing what 50-byte strings of smaller ids cover."""
    first = {}
    for i, t in sorted((r for r in texts if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = []
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b) + 1)
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\x01" * 50
        out.append((i, len(b), sum(gone), bytes(gone).count(b"\x01\x00"), bytes(c for c, g in zip(b, gone, strict=False) if not g)))
    return out
