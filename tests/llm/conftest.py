import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {
    "en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(),
    "de": "sch ein der ich ung heit keit ver zu ge be en er ü ö ä ß tz pf te ie ch au lich".split(),
    "es": "ción mente ado ía ll ñ rr que os as ar ez ue do ta ga bo ci mi co".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="session")
def rows():
    """Documents in three languages with copies, near copies, nulls, blanks and a long text."""
    rng, out = random.Random(5), []
    for i in range(150):
        lang = ("en", "en", "de", "es")[i % 4]
        out.append((i, prose(rng, lang, rng.randint(4, 160)), lang, f"s{i % 3}"))
    for i in range(150, 170):  # copies of a few, some with a word changed
        text = out[i % 5][1]
        if i % 2:
            words = text.split()
            words[i % len(words)] = "changed"
            text = " ".join(words)
        out.append((i, text, out[i % 5][2], "s0"))
    out += [(170, None, "en", None), (171, "", None, "s1"), (172, " \n\t ", "de", "s1"), (173, "123 456 !!", "en", "s1"), (174, prose(rng, "en", 30000), "en", "s2")]
    out += [(None, "No id here at all.", "en", "s1"), (5, out[5][1], out[5][2], "s1"), (5, out[5][1], out[5][2], "s1")]
    return [(a, t, b, c, len(t) if t is not None else None) for a, t, b, c in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """docs with columns named as those the operators add."""
    from pyspark.sql import functions as F

    extra = ("score", "lang_pred", "coverage", "fp", "part", "key", "n", "shard", "slot", "rank", "h", "bucket", "size", "node", "root", "a", "b", "families", "held_out", "fingerprint", "found", "guest", "cuts")
    return docs.select("*", *(F.lit(k).alias(k) for k in extra))
