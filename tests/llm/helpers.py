"""Small documents with everything that may go wrong, and brute-force parts."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("words", "node", "size", "score", "kept", "component_id", "copies", "doc", "removed", "n_tokens")
LONG = "the of and to " + " ".join(f"word{i} of the thing{i % 97} and" for i in range(6000))
BASE = " ".join(f"alpha{i} beta{i}" for i in range(60))


def rows():
    return [
        (1, BASE, "en", "a", 1),
        (2, BASE, "en", "a", 1),
        (2, BASE, "en", "a", 1),
        (3, BASE.replace("alpha7 ", "other "), "en", None, 1),
        (4, None, None, None, None),
        (None, "a text without any id at all and some more words", "en", "b", 1),
        (5, "", "fr", "b", 0),
        (6, " \t\n\r ", "fr", "b", 0),
        (7, LONG, "en", "c", 1),
        (8, "one", "xx", "c", 1),
        (9, "Zwei Wörter été \U0001f600\nund noch mehr davon hier in dieser Zeile heute\n", "de", "\U0001f600", 1),
        (10, "x" * 50_000, None, "c", 1),
        (11, "line of eight words or more in here 1\n" * 3, "en", "c", 1),
    ]


def odd(spark):
    """The rows above with further columns whose names operators use inside."""
    frame = spark.createDataFrame(rows(), DOCS)
    for name in CLASHING:
        frame = frame.withColumn(name, frame["n_chars"])
    return frame


def empty(spark):
    return odd(spark).limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def groups(n, linked):
    """The smallest member of each item's component, by all pairs."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(n)]
