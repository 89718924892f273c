import random

import pytest

WORDS = {
    "en": "the of and to in is that it was for on are with his they at be this have from or one had by word but not what all were".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque".split(),
}


def prose(rnd, lang="en", n=60):
    out = []
    for _ in range(n):
        w = rnd.choice(WORDS[lang]) + (rnd.choice(WORDS[lang]) if rnd.random() < 0.5 else "")
        out.append(w.capitalize() if not out or out[-1].endswith(".") else w)
        if rnd.random() < 0.1:
            out[-1] += "."
        if rnd.random() < 0.03:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")


def corpus(seed=0, n=120):
    """(doc_id, text, lang): copies, near copies, shared passages, nulls, empty and odd texts."""
    rnd = random.Random(seed)
    texts = []
    shared = prose(rnd, n=25)
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        t = prose(rnd, lang, rnd.randint(1, 150))
        kind = rnd.random()
        if texts and kind < 0.15:
            t = rnd.choice(texts)[0] or ""
        elif texts and kind < 0.35:
            words = (rnd.choice(texts)[0] or "x").split(" ")
            words[rnd.randrange(len(words))] = "changed"
            t = " ".join(words)
        elif kind < 0.5:
            t = t + "\n" + shared + "\n" + prose(rnd, lang, 5)
        texts.append((t, lang))
    texts += [(None, "en"), ("", "en"), (" \t\n ", "de"), ("a", None), ("日本語 テキスト 日本", "en"), ("é" * 200, "es"), ("x" * 5000, None), ("1 2 3", "en"), ("same\nsame\nSAME \n\nsame", "en")]
    return [(i, t, lang) for i, (t, lang) in enumerate(texts)]


SCHEMA = "doc_id bigint, text string, lang string"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with extra columns whose names operators may use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    clash = ("id", "row", "unit", "kind", "payload", "keep", "score", "own_id", "fp", "root", "component_id", "held_out", "length", "part", "spans", "t", "rid")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)]).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
