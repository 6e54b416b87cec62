"""IBANs in front of and behind tokens that look like parts of them."""

import pytest

from ticktide.llm import pii


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("DE89 3704 0044 0532 0130 00 BIC", ["DE89 3704 0044 0532 0130 00"]),
        ("GB82WEST12345698765432 USD 200", ["GB82WEST12345698765432"]),
        ("DE89370400440532013000 I", ["DE89370400440532013000"]),
        ("AB12 CDEF GHIJ KLMN DE89370400440532013000", ["DE89370400440532013000"]),
        ("GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00 NO93 8601 1117 947 PAID", ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]),
        ("DE89370400440532013000x or DE89370400440532013001 or DE8937040044053201300", []),
    ],
)
def test_ibans_end_where_their_country_says(text, wanted):
    assert [text[s.start : s.end] for s in pii.find(text) if s.kind == "iban"] == wanted
    assert pii.masked(text, pii.find(text)).count("<IBAN>") == len(wanted)
