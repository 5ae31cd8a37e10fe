"""Words of a text as runs of ASCII letters and digits and of all other non-ASCII characters, with A-Z lower-cased."""

from __future__ import annotations

_KEPT = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()
