"""The cleaning rules in plain Python: what runs inside a task."""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc

# Character classes with a set meaning in the cleaning rules.
CONTROL_CHARS = r"\x00-\x08\x0b-\x0c\x0e-\x1f\x7f"
CARRIAGE_RETURN = r"\r"
ZERO_WIDTH_AND_BIDI = r"\u200b-\u200f\u202a-\u202e\ufeff"
SPACE_RUN_OR_LINE_BREAK = r"\s{2,}|[\n\t]"

# Printable ASCII without entities, double spaces and outer spaces is clean already.
MAY_NEED_CLEANING = r"[^\x20-\x7e]|&|  |^ | $"

_REMOVED = re.compile(f"[{CONTROL_CHARS}{CARRIAGE_RETURN}{ZERO_WIDTH_AND_BIDI}]+")
_SPACING = re.compile(SPACE_RUN_OR_LINE_BREAK)


def clean_text(text: str | None) -> str | None:
    """Entities decoded once, NFKC, invisible characters gone, whitespace collapsed; blank is None."""
    if text is None:
        return None
    text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _SPACING.sub(" ", _REMOVED.sub("", text)).strip() or None


def clean_values(values: pa.Array) -> pa.Array:
    """A batch cleaned: each distinct value once, and in Python only those that may need it."""
    encoded = values.dictionary_encode()
    distinct = encoded.dictionary
    untidy = pc.or_(pc.match_substring_regex(distinct, MAY_NEED_CLEANING), pc.equal(pc.binary_length(distinct), 0))
    cleaned = pa.array([clean_text(v) for v in distinct.filter(untidy).to_pylist()], distinct.type)
    return pc.replace_with_mask(distinct, untidy, cleaned).take(encoded.indices)
