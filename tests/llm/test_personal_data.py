"""Usual forms of phone numbers, addresses and names are found, and none stays as it is."""

from __future__ import annotations

import pytest

from tarnwork.llm import pii

KEY = b"test key"


@pytest.mark.parametrize("text", ["+33 6 12 34 56 78", "+33 1 42 68 53 00", "06 12 34 56 78", "0612345678", "0171 2345678", "5551234567"])
def test_phone_forms(text):
    new, rows = pii.surrogates(f"call {text}.", KEY)
    assert [(r["kind"], r["start"], r["end"]) for r in rows] == [("phone", 5, 5 + len(text))]
    surrogate = rows[0]["surrogate"]
    assert surrogate != text and [c.isdigit() for c in surrogate] == [c.isdigit() for c in text] and surrogate.startswith(text[:2] if text[0] in "0" else text[:3] if text[0] == "+" else "")


@pytest.mark.parametrize("text,entity", [("请联系alice@example.com谢谢", "alice@example.com"), ("_bob@x.com", "_bob@x.com"), ("an müller@firma.de", "müller@firma.de"), ("İx@firma.de", "İx@firma.de")])
def test_addresses_beside_other_letters(text, entity):
    new, rows = pii.surrogates(text, KEY)
    assert [text[r["start"] : r["end"]] for r in rows] == [entity] and entity not in new


@pytest.mark.parametrize("name", ["Ýþð", "王伟", "Γιώργος", "Жжй", "김민준"])
def test_letters_of_other_scripts_change(name):
    new, rows = pii.surrogates(f"Dr. {name} spoke", KEY)
    assert len(rows) == 1 and rows[0]["surrogate"] != name and len(rows[0]["surrogate"]) == len(name)


def test_other_numbers_stay():
    text = "in 2024 12 34, 1700000000 s, 0123456789012, 3.14159265358 and 0.5234567890"
    assert pii.surrogates(text, KEY) == (text, [])


def test_numbers_in_a_list():
    assert len(pii.surrogates("656-555-1234,656-555-9999,5551234567,0612345678", KEY)[1]) == 4
