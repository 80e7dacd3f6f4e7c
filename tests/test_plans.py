import datetime as dt

import pytest

from quarry.functions.text import humanise, normal, slugs
from quarry.plans.names import alternates, load_groups
from quarry.plans.query import Options, Plan, describe, parse, parse_date, parse_number, undouble

D = dt.date
TODAY = D(2024, 6, 1)


@pytest.mark.parametrize(("text", "value"), [("45", 45), ("$5,000", 5000), (" -3.50 ", -3.5), (".5", 0.5), ("€ 7", 7), ("1,23", None), ("a", None), ("", None), ("+1e3", None), ("5.", None)])
def test_numbers(text, value):
    assert parse_number(text) == value


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2019-03-04", (D(2019, 3, 4), D(2019, 3, 4))), ("2019/3", (D(2019, 3, 1), D(2019, 3, 31))), ("2/2024", (D(2024, 2, 1), D(2024, 2, 29))), ("3/4/2019", (D(2019, 3, 4),) * 2),
        ("19.3.2019", (D(2019, 3, 19),) * 2), ("4.3.19", (D(2019, 4, 3),) * 2), ("12.5", (D(2024, 12, 5),) * 2), ("13/13/2019", None), ("2/30/2019", None), ("19.99", None), ("0/2019", None),
    ],
)
def test_dates(text, want):
    got = parse_date(text, today=TODAY)
    assert (got and got[:2]) == want


def test_day_first():
    assert parse_date("4.3.2019", day_first=True)[0] == D(2019, 3, 4)


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("", Plan("empty")), ("  ", Plan("empty")), ("!!", Plan("empty")),
        ("70..40", Plan("range", low=40, high=70, label="40 to 70")), ("1/2019…3/2019", Plan("daterange", low=D(2019, 1, 1), high=D(2019, 3, 31), label="2019-01 to 2019-03")),
        (">100", Plan("range", low=101, label="over 100")), (">100.0", Plan("range", low=100.1, label="over 100")), ("≤45", Plan("range", high=45, label="45 or less")),
        ("<2019-03-01", Plan("daterange", high=D(2019, 2, 28), label="before 2019-03-01")), (">=5/2026", Plan("daterange", low=D(2026, 5, 1), label="2026-05 or later")),
        ("month:MARCH", Plan("month", month=3, label="March")), ("month: 12", Plan("month", month=12, label="December")), ("month:june", Plan("month", month=6, label="June")),
        ("2019", Plan("number", value=2019, words=("2019",), year=2019)), ("6297739565", Plan("number", value=6297739565, words=("6297739565",), digits="6297739565")),
        ("$5,000", Plan("number", value=5000, words=("5", "000"))), ("A@b", Plan("email", value="a@b")), ("+11 629 773", Plan("phone", digits="11629773")),
    ],
)
def test_kinds(q, want):
    assert parse(q, today=TODAY, groups=[]) == want


def test_text_terms():
    plan = parse('Bob "New York" =Whit *oak 55-12a Ελένη', groups=[["bob", "Róbert"], ["bob", "bobby"]])
    assert [(t.word, t.mode, t.also) for t in plan.terms] == [
        ("bob", "start", ("robert", "bobby")), ("new york", "phrase", ()), ("whit", "whole", ()), ("oak", "contains", ()), ("55", "start", ()), ("12a", "start", ()), ("ελενη", "start", ()),
    ]
    assert describe(plan) == 'words: bob (also robert, bobby), "new york", =whit, *oak, 55, 12a, ελενη'
    assert describe(parse("2019")) == "number 2019, or a date in 2019" and describe(parse("3/2019")) == "month 2019-03"


def test_names(tmp_path):
    assert alternates() == {} and alternates([["bob", "Róbert x"], ["bob", "rob"]])["bob"] == ["robert", "rob"]
    (tmp_path / "n.json").write_text('[["ann", "anna"]]')
    assert alternates(load_groups(str(tmp_path / "n.json"))) == {"ann": ["anna"], "anna": ["ann"]}


def test_small_rules():
    assert normal("Navarré  & Co.") == " navarre co " and normal(None) == normal("--") == ""
    assert undouble("a%2520b".replace("%25", "%")) == "a b" and undouble("50%") == "50%" and undouble("%FF") == "%FF"
    assert Options.of("99", ["a", ""]) == Options(20, ("a",)) and Options.of("x").limit == 5 and Options.of(0).limit == 1
    assert humanise("order_lineItems") == "Order Line Items"
    assert slugs([("T_A", "People"), ("T_B", "people"), ("Tür", None)]) == {"T_A": "people", "T_B": "people-2", "Tür": "tur"}
