"""Pre-tokens of byte-level vocabularies: letters, digits or other signs with a space before them, contractions, white space."""

from __future__ import annotations

import re
from collections.abc import Iterator

import regex

# Fixed value: the split pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_any = regex.compile(PATTERN)
# the same for texts of printable ASCII, its white space and Latin letters alone, in the faster engine
_latin = r"A-Za-zÀ-ÖØ-öø-ɏ"
_beyond = re.compile(rf"[^\t-\r -~{_latin}]")
_plain = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_latin}]+| ?[0-9]+| ?[^\s0-9{_latin}]+|\s+(?!\S)|\s+")


def split(text: str) -> list[str]:
    return (_any if _beyond.search(text) else _plain).findall(text)


def pretokens(text: str, most: int = 1 << 18) -> Iterator[list[str]]:
    """The pre-tokens of a text in runs from about `most` characters each, so that no list of all of them is held.

    What a pre-token is depends on the character after it and, as contractions have three, on three of its own: what a
    part ends with may go on and is split again with the next one. A pre-token longer than a part is matched in the text."""
    at = 0
    while len(text) - at > most:
        found, back = split(text[at : at + most]), 0
        while found and back < 3:
            back += len(found.pop())
        if found:
            yield found
            at += most - back
        else:
            stop = _any.match(text, at).end()
            yield [text[at:stop]]
            at = stop
    yield split(text[at:])
