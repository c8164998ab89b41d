"""BPE by dynamic programming over prefixes: for every prefix of a word the one last token of its encoding, then back-pointers."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, per_worker

TOKENIZER = "word_bpe_49k.json"
WORD_END = "</w>"
#: What a worker remembers: chunks between white space, words, pairs of tokens. The half that it has not met for longest is forgotten, which
#: costs time only.
CHUNKS, WORDS, PAIRS = 800_000, 500_000, 500_000
#: What the tokenizer file counts as white space, and how it splits what stands between.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable, else the next letter from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Memo(dict):
    """Makes what it lacks and forgets the half that was not asked for last."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.half, self.older = make, size // 2, {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got


class PrefixEncoder:
    """A vocabulary with merge ranks as an automaton of token suffixes and a test of neighbouring tokens.

    The automaton walks a word once; at each place it gives every token that is a suffix of the prefix read so far. A token t may end the
    encoding of a prefix if it is what BPE makes of its own letters, and if BPE would leave the last token of the prefix before t and t
    itself apart. Exactly one does, so one number per prefix holds all encodings.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as source:
            data = json.load(source)
        self.pieces = regex.compile(_PIECES)
        self.letters = _byte_letters()
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rank = dict.fromkeys(vocab.values(), -1)
        self.left, self.right, self.pair = {}, {}, {}
        for k, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in merges):
            t = vocab[a + b]
            if self.rank[t] != -1:
                raise ValueError("two merges make one token")
            self.rank[t], self.left[t], self.right[t], self.pair[vocab[a], vocab[b]] = k, vocab[a], vocab[b], k
        self.sound = {}
        for t in sorted(self.rank, key=self.rank.get):  # a token is sound if BPE makes it of its letters
            self.sound[t] = self.rank[t] < 0 or self.sound[self.left[t]] and self.sound[self.right[t]] and self._apart(self.left[t], self.right[t], self.rank[t])
        self.automaton = ahocorasick.Automaton()
        for s, t in vocab.items():
            if self.sound[t]:
                symbols = s[: -len(WORD_END) - 1] + self._last(s[-len(WORD_END) - 1]) if s.endswith(WORD_END) and len(s) > len(WORD_END) else s
                self.automaton.add_word(symbols, (len(symbols), t))
        self.automaton.make_automaton()
        self.tested = _Memo(lambda key: self._apart(key >> 20, key & 0xFFFFF), PAIRS)
        self.words, self.chunks = _Memo(self._word, WORDS), _Memo(self._chunk, CHUNKS)

    @staticmethod
    def _last(letter: str) -> str:
        """The last letter of a word is a symbol of its own."""
        return chr(0xE000 + ord(letter))

    def _apart(self, a: int, b: int, limit: int | None = None) -> bool:
        """Whether BPE leaves the sound tokens a, b apart: take their merges back, latest first, and look for an earlier one across the border."""
        rank, pair = self.rank, self.pair
        limit = len(pair) if limit is None else limit
        while True:
            across = pair.get((a, b))
            if across is not None and across < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        symbols = "".join([self.letters[b] for b in word.encode("utf-8")])
        symbols = symbols[:-1] + self._last(symbols[-1])
        last, begin = [-1] * (len(symbols) + 1), [0] * (len(symbols) + 1)
        tested = self.tested
        for end, (size, t) in self.automaton.iter(symbols):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                if not tested[before << 20 | t]:
                    continue
            last[end + 1], begin[end + 1] = t, start
        out, at = [], len(symbols)
        while at:
            out.append(last[at])
            at = begin[at]
        return out[::-1]

    def _word(self, word: str) -> tuple[bytes, bytes]:
        """Ids and decoded text of one pre-token."""
        ids = self.word(word)
        return array("I", ids).tobytes(), " ".join([self.names[t] for t in ids]).encode()

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Ids and decoded text of what stands between white space: letter by letter in lower case, as the file's normalizer has it, then word by word."""
        if chunk.isascii():
            pieces = self.pieces.findall(chunk.lower())
        else:
            text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
            seen = "".join(["\uf8ff" if unicodedata.category(c) == "Cn" else c for c in text])  # what has no category is no letter
            pieces = [text[m.start() : m.end()] for m in self.pieces.finditer(seen)]
        if len(pieces) == 1:
            return self.words[pieces[0]]
        both = [self.words[p] for p in pieces]
        return b"".join([i for i, _ in both]), b" ".join([t for _, t in both])

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """(ids as little-endian unsigned 32-bit numbers, decoded text in UTF-8) of a whole text."""
        ids, shown = [], []
        parts = self.split_special.split(text) if self.split_special and "<" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.special[part].to_bytes(4, "little"))
                shown.append(part.encode())
                continue
            known = self.chunks
            for got in [known[chunk] for chunk in _SPACE.split(part) if chunk]:
                if got[0]:
                    ids.append(got[0])
                    shown.append(got[1])
        return b"".join(ids), b" ".join(shown)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None, digests: bool = False) -> DataFrame:
    """The columns `keep` of `docs` with the ids of the whole text (array of int) and the text decoded from them.

    With `digests` there are n_tokens, ids_sha256 and decoded_sha256 instead. A null or empty text has no ids and decodes to the empty
    text. Texts of any length are encoded whole; nothing is shuffled, so no key is hot. Rows stay as they are, also where they repeat an id
    or text; an empty table gives none. Of `keep`, columns that bear a name of the result are left out.
    """
    where = path or tokenizer_path()
    (body,) = fresh(docs, "_text")
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    keep = [c for c in keep if c.lower() not in made]

    def run(batches):
        coder = per_worker("bpe", where, lambda: PrefixEncoder(where))
        for pdf in batches:
            for i in range(0, len(pdf), 512):
                part = pdf.iloc[i : i + 512]
                both = [coder.encode(t or "") for t in part[body]]
                if digests:
                    new = {"n_tokens": [len(a) // 4 for a, _ in both], "ids_sha256": [hashlib.sha256(a).hexdigest() for a, _ in both], "decoded_sha256": [hashlib.sha256(b).hexdigest() for _, b in both]}
                else:
                    new = {"ids": [array("I", a).tolist() for a, _ in both], "decoded": [b.decode() for _, b in both]}
                yield pd.concat([part[keep].reset_index(drop=True), pd.DataFrame(new)], axis=1)

    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]) + ", " + added
    return docs.select(*keep, F.col(text).alias(body)).mapInPandas(run, schema)
