import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidelog.operators.results import brushed, gridlines
from tidelog.functions.text import query_instant, spans_days
from tidelog.plans.edits import clear, selected, set_window, toggle
from tidelog.plans.lexer import Comparison, Field, Pattern, Phrase, tokenize

SCALE = ["V", "D", "I", "W", "E"]


@pytest.mark.parametrize(
    ("query", "field", "value", "expected"),
    [
        ("", "category", "Mail", "category:Mail"),
        ("category:Mail", "category", "Home", "category:Mail,Home"),
        ("category:Mail,Home", "category", "mail", "category:Home"),
        ("category:Mail", "category", "Mail", ""),
        ("-category:Door", "category", "Mail", "-category:Door category:Mail"),
        ("category:Mail hello category:Home", "category", "Door", "category:Mail,Home,Door hello"),
        ("level>=W", "level", "E", "level:W"),
        ("level:W", "level", "E", "level>=W"),
        ("level:V", "level", "E", "level:V,E"),
        ("level>=W", "level", "I", "level>=I"),
        ("hello level:W there", "level", "W", "hello there"),
    ],
)
def test_toggle(query, field, value, expected):
    assert toggle(query, field, value, SCALE if field == "level" else None) == expected


def test_clear_window_selected():
    assert clear("a category:X b", "category") == "a b"
    assert set_window("x since:1", "10:00", "11:00") == "x since:10:00 until:11:00"
    assert set_window("since:1 until:2 x", None, None) == "x"
    assert selected("level>=W", "level", SCALE) == {"W", "E"}
    assert selected("-tag:a tag:b,c tag>=d", "tag") == {"b", "c", "d"}


def test_tokens():
    assert tokenize('-tag:~A "b c" /x\\/y/ d') == [Field(0, 7, "tag", Comparison.EQUALS, "~A", True), Phrase(8, 13, "b c"), Pattern(14, 20, "x\\/y"), Phrase(21, 22, "d")]
    assert tokenize('"open') == [Phrase(0, 5, "open")]
    assert tokenize("/open") == [Pattern(0, 5, "open")]
    assert tokenize("a.b:c") == [Phrase(0, 5, "a.b:c")]
    assert tokenize("http://x") == [Field(0, 8, "http", Comparison.EQUALS, "//x", False)]
    assert tokenize('tag:"a b" x')[0] == Field(0, 9, "tag", Comparison.EQUALS, '"a b"', False)
    assert tokenize("-") == [Phrase(0, 1, "-")]


@given(st.text(alphabet="ab:-,\"'/ \\<>=~", max_size=30))
def test_every_edit_is_a_query(text):
    tokens = tokenize(text)
    assert all(t.start < t.end for t in tokens)
    assert all(a.end <= b.start for a, b in zip(tokens, tokens[1:], strict=False))
    assert "z" in {v.lower() for v in selected(toggle(clear(text, "tag"), "tag", "z"), "tag")} or "'" in text or '"' in text or "/" in text


def test_brush_and_gridlines():
    assert brushed(1000, 2000, 10, 12, 100) is None
    assert brushed(1000, 2000, 75, 25, 100) == (1250, 1750)
    assert query_instant(1784714400123, "Europe/Paris") == "2026-07-22T12:00:00.123"
    day = 86_400_000
    assert gridlines(0, 3 * day, "UTC") == [day, 2 * day, 3 * day]
    assert gridlines(0, 60 * day, "UTC") == []
    assert spans_days(0, day, "UTC") and not spans_days(0, day - 1, "UTC")
