"""Words of letters, digits and all that is not ASCII, on UTF-8 bytes."""

from __future__ import annotations

import pyarrow as pa

#: A-Z become a-z; ASCII that is no letter and no digit becomes a blank.
_PLAIN = bytes((b | 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words for SQL engines, after lower-casing A-Z.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_PLAIN).split()


def texts_of(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes; null is empty."""
    return [raw or b"" for raw in column.cast(pa.binary()).to_pylist()]
