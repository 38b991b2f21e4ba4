"""Documents, and brute-force versions, for the tests of this folder."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "an ti re on ed the st er sh ing of".split() for b in ("", "a", "lo", "mi", "dor", "ka")]


def prose(rng: random.Random, words: int) -> str:
    out = [rng.choice(WORDS) for _ in range(words)]
    return " ".join(w + rng.choice(["", "", "", "", ".", ","]) for w in out)


def edited(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


#: Null, empty, without words, one word, repeated rows, and characters of all lengths.
ODD = [None, "", " \n\t ", "one", "one", "One", "two words", "é ü ß 漢字 \U0001f600", "a\x00b"]


def documents(spark, texts, sources=None):
    rows = [(k, t, "en", (sources or {}).get(k, f"src{k % 3}"), None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def components(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]
