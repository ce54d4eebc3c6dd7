"""Fixtures of the training-data operators' tests."""

import random
import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, uid string, score string, shard string, copy string, leaks string, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(_FOLD))


def frame(spark, rows):
    """Documents from (doc_id, text, lang, source), with extra columns whose names operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 7) for r in rows], DOC_SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def awkward(seed=1):
    """Nulls in every column, empty and blank texts, repeated rows, one long text, non-ASCII text."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n\t ", "fr", "b"), (None, base + " tail", "en", None), (None, None, None, None), (6, "Été déjà vu ü", "fr", "a"), (7, "one two", "en", "a"), (8, "ONE two", "en", "a")]
    rows += [(9, prose(rng, 30_000, 5000), "en", "b"), (10, "x" * 5000, None, "b")]
    rows += [(20 + k, edited(rng, base, k % 4), "en", "a") for k in range(25)]
    rows += [(100 + k, prose(rng, 80), "de", "c") for k in range(20)]
    return rows
