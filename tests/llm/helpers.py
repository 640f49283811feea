"""Documents with every awkward case, and plain versions of what the operators compute."""

import re

LONG = "lorem ipsum dolor sit amet consectetur " * 20_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, _id string, _size int, target double, band long, root string"


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, shared ids, clashing column names."""
    texts = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "a"), (2, None, "a"), (3, "", "b"), (4, " \t\n ", None), (5, LONG, "b"),
        (6, "The quick brown fox jumps over the lazy dog near the river bank today", "a"), (None, "no id but some words are here for it", "c"), (8, "one two", None),
        (9, "one two", "c"), (9, "one two", "c"), (10, "naïve café İstanbul 'Σίσυφος' 12 <|endoftext|> ​ x", "😀"), (10, "another text of one id", "a"),
    ]
    rows = [(i, t, "en", s, None if t is None else len(t), 7, "n", None, 3, 1.0, None, "r") for i, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
