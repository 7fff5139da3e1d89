"""Documents that every operator must take: nulls, blanks, repeats, a long text, clashing columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, score string, n_words string, "
          "n_lines string, item_ids string, verdict string, _hits string, rid string, h1 string, spans string, pass string, "
          "n_tokens string, clauses string, low string")


def rows(long_words: int = 60_000):
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    a, b = prose(80), prose(90)
    out = [
        (1, None, "en", "s1"), (2, "", "en", "s1"), (3, " \n\t ", None, None), (4, "one", "en", None),
        (5, a, "en", "s1"), (6, a, "en", "s2"), (7, a + " more", None, "s1"), (8, b, "de", "s2"), (8, b, "de", "s2"),
        (None, a, "en", "s1"), (None, None, None, None), (9, "É ü 漢字 \U0001f600 ñ\x1c\x85x", "fr", "s3"),
        (10, prose(long_words), "en", "s1"), (11, "a b c d", "en", "s1"), (12, "A B C D", "en", "s1"),
        (13, "\n".join([prose(9), "Same line", prose(8)]), "en", "s1"), (14, prose(70), "", ""),
    ]
    return [(*r, None if r[1] is None else len(r[1]), *["x"] * 14) for r in out]


def frame(spark, **more):
    return spark.createDataFrame(rows(**more), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
