"""Small documents for the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {
    "en": ["the", "of", "th", "er", "ing", "and", "ion", "re", "ly"],
    "de": ["der", "ung", "sch", "ein", "ü", "ß", "keit", "ch", "ver"],
    "es": ["que", "ción", "ñ", "los", "ar", "mente", "ó", "el", "do"],
}
ODD = [None, "", " ", "\n\n", "a", "#", "1234", "é", "日本語", "x" * 5000, "ab " * 700, "\u0000nul \u0000", "<|endoftext|> token", "\x1c\x85  line"]


def prose(rng: random.Random, lang: str, n: int) -> str:
    words = ["".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.08 else "") for w in words).capitalize()


def rows(seed: int = 0, n: int = 90, odd: bool = True) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        text = prose(rng, lang, rng.choice([3, 12, 60, 150, 400]))
        out.append([i * 2, text, lang, f"src{min(int(rng.expovariate(0.8)), 5)}", len(text)])
    for i in range(0, n // 6):
        out[-1 - i][1] = out[i][1] if i % 2 else out[i][1] + " the end"
    if odd:
        out += [[1000 + i, t, None if i % 2 else "en", None if i % 3 else "odd", None] for i, t in enumerate(ODD)]
    return [tuple(r) for r in out]


def documents(spark, **more):
    return spark.createDataFrame(rows(**more), SCHEMA).repartition(3)


def with_clashes(df):
    """Extra columns with names that the operators use inside."""
    from pyspark.sql import functions as F

    names = ["id", "dk", "queue", "part", "start", "found", "gone", "is_first", "fp", "key", "component_id", "held_out", "ids", "n", "_id", "_dk", "sketch", "hist", "score", "words"]
    return df.withColumns({x: F.lit("clash") for x in names})
