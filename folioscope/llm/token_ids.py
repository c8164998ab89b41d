"""Token ids of whole texts by a tokenizers file, as little-endian bytes; equal chunks of text are encoded once per worker."""

from __future__ import annotations

import re

from .common import per_worker

TOKENIZER = "byte_bpe_50k.json"
#: Chunks a worker remembers. The half that it has not met for longest is forgotten, which costs time only.
REMEMBERED = 1_500_000
#: A chunk ends before a single space that a character follows. No pre-token of the byte-level pattern reaches over such a place.
_CHUNK = re.compile(r" (?=\S)")
#: Fixed value: the pattern by which the tokenizer file cuts a text into pre-tokens.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Remembering(dict):
    """Makes what it lacks, and keeps the two halves of what was asked for last."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got

    def shrink(self) -> None:
        if len(self) > REMEMBERED // 2:
            self.older = dict(self)
            self.clear()


class ChunkEncoder:
    """Encodes texts chunk by chunk; each distinct chunk is encoded once while it is remembered.

    A chunk of common letters is cut into its pre-tokens here, and the library's model encodes them one by one; the library encodes
    any other chunk as a whole.
    """

    def __init__(self, path: str):
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = regex.compile(_PIECES).findall
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.letters = {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}
        self.chunks, self.parts = _Remembering(self._chunk), _Remembering(self._part)

    def _whole(self, text: str) -> bytes:
        from array import array

        return array("H", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        from array import array

        shown = piece.replace(" ", "\u0120") if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.library.model.tokenize(shown)]).tobytes()

    def _pieces(self, text: str) -> bytes:
        if max(text, default="") > "\u024f":
            return self._whole(text)
        return b"".join([self.chunks[p[1:]] if p[0] == " " and p[1:].isalpha() else self.parts[p] for p in self.pieces(text)])

    def _chunk(self, chunk: str) -> bytes:
        return self._part(" " + chunk) if chunk.isalpha() else self._pieces(" " + chunk)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (unsigned 16-bit, little-endian) of each text. Texts that hold a special token's string go to the library whole."""
        get, out = self.chunks.__getitem__, []
        for text in texts:
            if any(s in text for s in self.special):
                out.append(self._whole(text))
                continue
            head, *rest = _CHUNK.split(text)
            out.append(self._pieces(head) + b"".join(map(get, rest)))
        self.chunks.shrink()
        self.parts.shrink()
        return out


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str | None = None) -> ChunkEncoder:
    """The encoder of this Python worker, with what it remembers from earlier tasks. The vocabulary must have at most 65,536 entries."""
    where = path or tokenizer_path()
    return per_worker("tokenizer", where, lambda: ChunkEncoder(where))


def encoded(texts, path: str | None = None, at_once: int = 256):
    """Yields the ids of each whole text of a sequence, in order (null: none), as unsigned 16-bit numbers in bytes."""
    known, texts = encoder(path), list(texts)
    for i in range(0, len(texts), at_once):
        yield from known.encode([t or "" for t in texts[i : i + at_once]])
