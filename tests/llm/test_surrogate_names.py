import re

import pytest

from rillwork.llm import op4_surrogates as op4


def found(text):
    return [text[s:e] for s, e, *_ in op4.entities(text)]


PLANTED = [
    ("Natasha Ivanova met Priya Sharma and Wang Xiaoming.", ["Natasha", "Ivanova", "Priya", "Sharma", "Wang", "Xiaoming"]),
    ("Вчера Иван Петров уехал. Петров молчал.", ["Иван", "Петров", "Петров"]),
    ("Date of birth: 1985-03-12, born on 3 May 1970.", ["1985-03-12", "3 May 1970"]),
    ("He lives at 221 Baker Street, she in Hauptstraße 12a, they at 14 rue de Rivoli.", ["221 Baker Street", "Hauptstraße 12a", "14 rue de Rivoli"]),
    ("Dear Alice, my name is Tomasz Kowalski.", ["Alice", "Tomasz", "Kowalski"]),
    ("王小明先生来了", ["王小明"]),
    ("Mrs O'Brien and Mr. van der Berg", ["O'Brien", "Berg"]),
    ("Maria Lopez's car; LOPEZ signed.", ["Maria", "Lopez", "LOPEZ"]),
]
CLEAN = ["Victoria station is near.", "Charlotte, NC is nice.", "Rosa parks the car.", "Mark the date.", "Ines.\nEdanti to.", "New York City and the Supreme Court.", "On 12 March 1985 it rained.", "John Street Station is closed."]


def test_planted_and_clean():
    hit = sum(w in found(t) for t, words in PLANTED for w in words)
    wanted = sum(len(words) for _, words in PLANTED)
    extra = [x for t, words in PLANTED for x in found(t) if x not in words]
    print("recall", hit / wanted, "beside", extra)
    assert hit == wanted and not extra
    assert not [x for t in CLEAN for x in found(t)]


def test_one_surrogate_whatever_the_title():
    text = "Dr Kelly Smith, Mr Kelly Smith, Mrs Kelly Smith and Miss Kelly. KELLY left."
    _, spans = op4.replaced(text, op4.KEY, {}, {})
    assert len({x["surrogate"].capitalize() for x in spans if text[x["start"] : x["end"]].upper() == "KELLY"}) == 1 and spans[-1]["surrogate"].isupper()


def test_surrogates_look_like_what_they_replace():
    made = op4.surrogate(op4.KEY, "name", "Natasha"), op4.surrogate(op4.KEY, "name", "Петрова"), op4.surrogate(op4.KEY, "name", "Παππάς")
    assert re.fullmatch("[A-Z][a-z]+a", made[0]) and re.fullmatch("[А-Я][а-я]+ова", made[1]) and re.fullmatch("[Α-Ω][α-ω]+", made[2])
    assert op4.surrogate(op4.KEY, "family", "Smith") in op4.SURNAMES["english"]
    for value in ("1985-03-12", "12.03.1985", "3 May 1970", "May 3, 1970", "31/12/2005"):
        new = op4.surrogate(op4.KEY, "date", value)
        assert op4.date_of(new)[1] == op4.date_of(value)[1] and new != value
    assert op4.surrogate(op4.KEY, "date", "1985-03-12") == op4.date_of(op4.surrogate(op4.KEY, "date", "12 March 1985"))[0].isoformat()


def test_full_formats_widen(spark):
    """All one-digit addresses of a block are real: their surrogates are others, and still distinct."""
    values = [f"{a}.{b}.{c}.7" for a in range(10) for b in range(10) for c in range(3)]
    table = spark.createDataFrame([(i, f"at {v} now") for i, v in enumerate(values)], "doc_id long, text string")
    new = [r.entities[0].surrogate for r in op4.pseudonymise(table).collect()]
    assert len(set(new)) == len(values) and not set(new) & set(values)
    with pytest.raises(RuntimeError):
        op4.exceptions(table, attempts=0)


def test_clashing_columns(spark):
    table = spark.createDataFrame([(1, "Mr. Smith", "e", 2, "x", None)], "doc_id long, text string, entities string, attempts__ int, text__ string, `entities__` int")
    out = op4.pseudonymise(table)
    assert out.columns == [*table.columns, "entities_"] and out.first().entities == "e" and "Smith" not in out.first().text
