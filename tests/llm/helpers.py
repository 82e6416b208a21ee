"""Documents that are awkward on purpose, and plain rewritings of what operators compute."""

import hashlib
import random

WORDS = ["a", "bé", "c", "x", "yy", "日本"]

EDGE = [
    (0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "two words"), (5, "a " * 300), (6, "a " * 300), (7, "b" * 1500), (8, "ab" * 900),
    (9, " ".join(f"q{k}" for k in range(120))), (10, "Q0 " + " ".join(f"q{k}" for k in range(1, 120))), (11, "x" * 50_000 + " " + "y " * 20_000), (12, "é" * 700),
]


def corpus(n=80, seed=5, size=50):
    """Passages that repeat across documents, some with a word changed."""
    rnd = random.Random(seed)
    vocabulary = WORDS if seed % 2 else [f"w{k}" for k in range(200)]
    base = [[rnd.choice(vocabulary) for _ in range(size * 3)] for _ in range(4)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 3)):
            if rnd.random() < 0.6:
                x = list(rnd.choice(base))[rnd.randint(0, size) : rnd.randint(size, size * 3)]
                if x and rnd.random() < 0.5:
                    x[rnd.randrange(len(x))] = f"z{rnd.randint(0, 3)}"
            else:
                x = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, size))]
            parts.append(" ".join(x))
        docs.append((i + 100, "\n".join(parts)))
    return docs


def frame(spark, docs):
    """With columns whose names operators might use themselves."""
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars", "1 as h", "2 as spans", "3 as fp", "4 as row", "5 as span_id", "6 as kept_id", "7 as rejected_id", "null as quality")


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()
