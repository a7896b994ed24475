import random

import pytest

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, extra STRING, item_id STRING, rep BIGINT, value STRING"
WORDS = {
    "en": "the of and river stone house with under garden morning light bridge winter letter answer question market people through never walked slowly home again".split(),
    "de": "der die und nicht straße haus mit unter garten morgen licht brücke winter brief antwort frage markt leute durch niemals ging langsam heim wieder".split(),
    "fr": "le la et rivière pierre maison avec sous jardin matin lumière pont hiver lettre réponse question marché gens travers jamais marcha lentement chez encore".split(),
    "es": "el la y río piedra casa con bajo jardín mañana luz puente invierno carta respuesta pregunta mercado gente través nunca caminó despacio hogar otra".split(),
}


def prose(seed, n, lang="en"):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + (str(r.randrange(10, 99)) if r.random() < 0.02 else "") for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, lang); extra columns clash with names that operators use."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1]), "x", "clash", -1, "v") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and blank texts, a very long one, repeated rows, symbols only, and an id of null."""
    long = prose(1, 60_000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, prose(2, 80)), (5, prose(2, 80)), (None, prose(3, 50)), (6, "!!! ### ???"), (7, "😀😀 x"), (8, "a"), (None, None)]
    return make_docs(rows)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
