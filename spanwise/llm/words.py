"""Word streams over whole texts, in pieces of bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: ASCII A-Z lowered; ASCII bytes that are no digit or letter become spaces; bytes above 0x7F stay.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Bytes of text split into words at a time.
PIECE = 1 << 22


def utf8(text: object) -> bytes:
    """The text's bytes; nothing for a null."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def fold(data: bytes) -> bytes:
    """Lower-cased words parted by spaces: runs of ASCII digits and letters and of non-ASCII characters."""
    return data.translate(_FOLD)


def word_pieces(data: bytes, overlap: int, size: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """Lists of the white-space separated words, each with the number of words before it.

    A list starts with the last ``overlap`` words of the one before it, so each run of ``overlap + 1`` words is whole
    in one of them. A piece ends at white space, never inside a word.
    """
    if len(data) <= size:
        yield 0, data.split()
        return
    at, seen, carried = 0, 0, []
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        fresh = data[at:end].split()
        yield seen - len(carried), carried + fresh
        seen += len(fresh)
        carried = (carried + fresh)[-overlap:] if overlap else []
        at = end


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """A batch's result as columns, also where there are no rows."""
    return pd.DataFrame({name: [row[k] for row in rows] for k, name in enumerate(names)}, columns=names)
