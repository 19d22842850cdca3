"""Character classes spelled out, so that Java, RE2 and Python agree on them."""

from __future__ import annotations

# The characters of Python's str.isspace and of \s in a str pattern, as class content.
SPACE_CHARS = (r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
SPACE = f"[{SPACE_CHARS}]"
WORD = r"[\p{L}\p{N}_]"


def spelled(pattern: str) -> str:
    r"""A pattern without ``\s`` and ``\w`` (outside classes): both written as the classes above."""
    return pattern.replace(r"\s", SPACE).replace(r"\w", WORD)
