"""Small documents for the tests."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema=DOCUMENTS):
    """Documents of the given texts, numbered from zero, or of (doc_id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)


def prose(seed, words, alphabet="abcdefghijklmnop"):
    chosen = random.Random(seed)
    return " ".join("".join(chosen.choice(alphabet) for _ in range(chosen.randint(2, 8))) for _ in range(words))
