"""Documents with the hard cases in them, and a generator of invented prose."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, stats string, shard int, fp long, n_words long"
SYLLABLES = "the on ing re er an th ea st in ou le ha ti".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    words = ["".join(draw.choices(SYLLABLES, k=draw.choice((1, 1, 2, 3)))) for _ in range(n)]
    return " ".join(w + draw.choice(("", "", "", "", ",", ".")) for w in words)


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    long_ = prose(99, 30_000)
    out = [(k, prose(k, 80), "en", f"src{k % 3}", k, 0.5, k, "x", 1, 1, 1) for k in range(24)]
    near = prose(3, 80).split()
    near[40] = "changed"
    out += [
        (100, None, None, None, None, None, None, None, None, None, None),
        (101, "", "en", "s", 0, None, None, None, None, None, None),
        (102, " \n\t ", "en", "s", 4, None, None, None, None, None, None),
        (103, long_, "en", "s", len(long_), None, None, None, None, None, None),
        (104, "x" * 50_000, "de", "s", 50_000, None, None, None, None, None, None),
        (105, prose(5, 80), "en", "s", 1, None, None, None, None, None, None),
        (106, " ".join(near), "en", "s", 1, None, None, None, None, None, None),
        (107, "#$% 12 345 !!", "fr", "s", 1, None, None, None, None, None, None),
        (108, "Éa ünd ñ 日本語 \U0001f600 <|im_start|>", None, "s", 1, None, None, None, None, None, None),
        (None, prose(7, 80), "en", "s", 1, None, None, None, None, None, None),
        (None, prose(55, 80), "en", "s", 1, None, None, None, None, None, None),
    ]
    return out + [out[2]] * 3 + [out[-1]] * 2


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], r[1]) for r in rows()]
