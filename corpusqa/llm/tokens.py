"""Token ids of whole texts with a public tokenizer, through a memory of text pieces.

A text is cut where the tokenizer always starts a new word, so the ids of the pieces, one after the other,
are the ids of the text. Words repeat, so most pieces are looked up.

* ``byte`` tokenizers (byte-level BPE, white space is part of words) are cut in front of a space that is
  followed by anything but white space: their pattern starts a word there, whatever comes before.
* ``word`` tokenizers (white space dropped) are cut at spaces and line ends.

A piece that is no unit of that kind (several spaces in a row and the like) is joined to the one before it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

_OPEN: dict[tuple[str, str], "Encoder"] = {}
#: A sign after one of these starts a new word for both kinds.
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Pieces longer than this are not remembered.
_LONG = 40
#: Bytes that a remembered piece takes besides its letters and ids: two objects and a place in the table.
_ENTRY = 150


class Encoder(dict):
    """Piece of text to its ids as little-endian unsigned 32-bit integers. Remembered are pieces that cannot be cut further (and words with a sign, of the byte kind), in
    about ``limit`` bytes at most: the first ones, which are mostly the frequent ones. Where they no longer help (four times
    as many unknown pieces as remembered ones have come since), the memory is emptied and fills anew. Tasks of a worker share it."""

    def __init__(self, path: str, kind: str, limit: int = 200 << 20):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if kind not in ("byte", "word"):
            raise ValueError(f"kind is byte or word, not {kind!r}")
        self.kind, self.limit, self.held, self.missed = kind, limit, 0, 0
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

    def __missing__(self, piece: str) -> bytes:
        ids = self._parts(piece)
        if ids is None:
            ids = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
        elif self.kind == "word" or "\n" in piece:
            return ids  # quickly put together again
        if self.held <= self.limit:
            if len(piece) <= _LONG:
                self.held += _ENTRY + len(piece) + len(ids)
                self[piece] = ids
        else:
            self.missed += 1
            if self.missed > 4 * len(self):
                self.forget()
        return ids

    def forget(self) -> None:
        self.clear()
        self.held = self.missed = 0

    def _parts(self, piece: str) -> bytes | None:
        """Ids of a piece that can be cut further, whose parts are more likely known."""
        core = piece.rstrip(".,;:!?")
        if core != piece:
            return self[core] + self[piece[len(core):]] if core and core[-1] in _LETTERS else None
        if "\n" in piece:
            head, end, tail = piece.partition("\n")
            return self[head] + self[end] + self[tail] if head and tail and not head[-1].isspace() and not tail[0].isspace() else None
        if self.kind == "word" and piece.isascii() and (low := piece.lower()) != piece:
            return self[low]
        return None

    def pieces(self, text: str) -> list[str]:
        if self.kind == "word":
            return text.replace("\n", " ").split(" ")
        parts = text.split(" ")
        cut = [parts[0], *(" " + p for p in parts[1:])]
        if "  " not in text and not _ODD.search(text):
            return cut
        out = [cut[0]]
        for piece in cut[1:]:
            if len(piece) > 1 and not piece[1].isspace():
                out.append(piece)
            else:
                out[-1] += piece
        return out

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text))) if text else b""


#: A space that white space or the end of the text follows.
_ODD = re.compile(r" (?:\s|[\x1c-\x1f]|\Z)")


def encoder(path: str, kind: str) -> Encoder:
    """One for each worker process."""
    if (path, kind) not in _OPEN:
        _OPEN[path, kind] = Encoder(path, kind)
    return _OPEN[path, kind]


def encoded(texts: list[str | None], path: str, kind: str, end_id: int) -> Iterator[bytes]:
    """Ids of each text and the end id, as little-endian unsigned 32-bit integers."""
    known, end = encoder(path, kind), int(end_id).to_bytes(4, "little")
    for text in texts:
        yield known.ids(text) + end
