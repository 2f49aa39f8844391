import pytest

from vacantia.operators.evidence import read_evidence

CASES = [
    ("Fluent Danish is required. English is a plus.", ["da"], ["en"], [], False),
    ("Danish is not a requirement", [], [], ["da"], False),
    ("You speak Danish and English", ["da", "en"], [], [], False),
    ("A Danish company on the Swedish market", [], [], [], False),
    ("Our working language is English", [], [], [], True),
    ("Det er en fordel, hvis du taler dansk", [], ["da"], [], False),
    ("Gode danskkundskaber er et krav", ["da"], [], [], False),
    ("Deutsch fließend erforderlich; Englisch ist von Vorteil", ["de"], ["en"], [], False),
    ("German is required; French is not required", ["de"], [], ["fr"], False),
    ("", [], [], [], False), (None, [], [], [], False),
]


def test_evidence(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id bigint, t string")
    got = {r["id"]: (r["required"], r["preferred"], r["waived"], r["english_workplace"]) for r in read_evidence(df, "id", "t").collect()}
    for i, c in enumerate(CASES):
        assert got[i] == c[1:], c[0]


def test_nothing(spark):
    assert read_evidence(spark.createDataFrame([], "id bigint, t string"), "id", "t").count() == 0
