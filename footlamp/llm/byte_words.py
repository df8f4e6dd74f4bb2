"""Words of UTF-8 bytes by one 256-byte table: letters are lower-cased and separators blanked, then ``bytes.split`` cuts.

A word is a run of digits, ASCII letters and characters beyond ASCII. Each byte of such a character is 128 or more, so the table
works on bytes and never cuts a character. ``bytes.split`` splits at ASCII blanks only.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

#: Bytes of a text that are looked at together; a slice ends at a separator.
SLICE = 1 << 20

_KEPT = set((string.digits + string.ascii_lowercase).encode()) | set(range(128, 256))
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
TABLE = bytes(LOWER[b] if LOWER[b] in _KEPT else 0x20 for b in range(256))


def slices_of_words(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text in order, a list for about ``size`` bytes; nothing for an empty text."""
    at, end = 0, len(text)
    if end <= size:
        yield text.translate(TABLE).split()
        return
    parts: list[bytes] = []  # of a word that goes on in the next slice
    while at < end:
        piece = text[at : at + size].translate(TABLE)
        at += size
        if at < end:
            cut = piece.rfind(b" ") + 1
            if not cut:
                parts.append(piece)
                continue
            piece, rest = piece[:cut], piece[cut:]
        else:
            rest = b""
        yield b"".join([*parts, piece]).split()
        parts = [rest] if rest else []
