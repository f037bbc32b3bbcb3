"""Terms of texts as byte strings, by one table of bytes."""

from __future__ import annotations

import string

#: DuckDB's way to lower A-Z alone, as in SQL of queries.
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def table_of(ascii_signs: str) -> bytes:
    """For bytes.translate: A-Z to a-z, the given ASCII signs and all bytes from 0x80 on as they are, others to spaces.
    Every byte of a character beyond ASCII is 0x80 or more in UTF-8, so that terms of bytes are terms of characters."""
    kept = set(ascii_signs.encode())
    return bytes(b + 32 if 65 <= b <= 90 else b if b in kept or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None, table: bytes) -> list[bytes]:
    """The terms of a text in order; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(table).split() if text else []
