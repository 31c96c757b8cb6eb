"""Words of texts as bytes, for operators that hash or count them: only A-Z is lower-cased, at any length in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are cut into words at once.
RUN = 1 << 20
LETTERS, DIGITS = bytes(range(0x61, 0x7B)), bytes(range(0x30, 0x3A))
#: Bytes of the UTF-8 form of all code points from U+0080 on.
BEYOND_ASCII = bytes(range(0x80, 0x100))


def blanks(keep: bytes) -> bytes:
    """A table for `bytes.translate` under which lower-cased words keep their bytes and all others become blanks."""
    return bytes(b if b in keep else 0x20 for b in range(256))


def runs(text: bytes | None, table: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about RUN bytes; of no text none."""
    at = 0
    while text and at < len(text):
        part = text[at : at + RUN].lower().translate(table)
        at += len(part)
        while at < len(text) and part[-1] != 0x20:
            # The last word may go on: it is taken whole.
            more = text[at : at + RUN].lower().translate(table)
            end = more.find(b" ") + 1 or len(more)
            part, at = part + more[:end], at + end
        yield part.split()


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, split at space and U+0009 to U+000D."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """All runs of size words, repeats included; of fewer words the whole run."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(w) for w in zip(*(words[i:] for i in range(size)))]
