"""Words of a text, in Python for Arrow batches."""

from __future__ import annotations

import re

#: A word is a maximal run of a-z and 0-9 after lower-casing.
WORD = re.compile("[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for a null, empty or blank text."""
    return WORD.findall(text.lower()) if text else []
