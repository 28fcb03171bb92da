"""Copies of a statement that follow each other closely."""

import re

import pytest
from clipline.llm import licenses

LINES = {n: t for n, t in licenses.TEMPLATES.items() if n.endswith("-line")}


def scan(text):
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.GRAM, licenses.WINDOW, licenses.BAND, 0.8)
    return scanner.scan(text)


@pytest.mark.parametrize("name", sorted(LINES))
@pytest.mark.parametrize("between", range(5))
@pytest.mark.parametrize("times", [2, 100])
def test_copies_close_together(name, between, times):
    line = LINES[name]
    text = (line + " x" * between + " ") * times
    found = [(r[1], r[2]) for r in scan(text) if r[0] == name]
    assert found == [m.span() for m in re.finditer(re.escape(line), text)]


def test_list_of_photo_credits():
    text = " ".join(f"Photo: P{i}. Licensed under CC BY 4.0." for i in range(30))
    assert sum(r[0] == "cc-by-4.0-line" for r in scan(text)) == 30


def test_long_notices_one_after_the_other():
    text = " ".join([licenses.TEMPLATES["mit"]] * 3)
    assert [r[5] for r in scan(text) if r[0] == "mit"] == [1.0] * 3
