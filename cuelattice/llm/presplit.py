"""Pre-splitting for the public tokenizers: exact, and quick for Latin-1 texts.

For texts of Latin-1 characters the Unicode classes are written out, so that
the standard library's faster ``re`` can be used.  Any other text goes through
the tokenizers library itself, whose Unicode tables decide.
"""

from __future__ import annotations

import os
import re
import unicodedata

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Unicode white space within Latin-1 (\x1c-\x1f do not belong to it).
_SPACE = r"\t-\r \x85\xa0"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)


_L, _N = _class("L"), _class("N")
#: Fixed contractions of both vocabularies' patterns.
_CONTRACTIONS = "'(?:s|t|re|ve|m|ll|d)"
BYTE_LEVEL = re.compile(rf" ?[{_L}]+|{_CONTRACTIONS}| ?[{_N}]+| ?[^{_SPACE}{_L}{_N}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
WORD_LEVEL = re.compile(rf"{_CONTRACTIONS}|[{_L}]+|[{_N}]|[^{_SPACE}{_L}{_N}]+")


def is_latin1(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]
