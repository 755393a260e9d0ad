"""Lower-case words of UTF-8 texts, for operators that count them inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20

# digits, lower-case letters and all that isn't ASCII stay; A-Z become lower case; the rest parts words
_KEPT = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_in_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case, in lists of about :data:`PIECE` bytes."""
    plain, at = text.translate(_KEPT), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def utf8(column):
    """The values of an Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""
