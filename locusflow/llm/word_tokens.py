"""Token ids of whole texts by the tokenizers library, one library call per distinct word.

The normaliser and splitter of the word-level vocabulary never look across white space, so the
ids of a text are the ids of its white-space-separated chunks in order. Chunks repeat, which
makes a bounded dictionary of chunk ids pay: only new words go through the library.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Unicode White_Space, where the tokenizer's own pattern splits.
_CHUNK = re.compile("[^\t-\r \x85\xa0  -     　]+")
#: str.split() also splits at these four, which the tokenizer keeps.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Chunks of these characters are split further here; their normal form and letter class are plain.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]{1,200}")
_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+"
)
#: Entries kept in each of the two dictionaries of a worker. Frequent words come early and stay;
#: after so many misses of full dictionaries they are emptied, in case the texts have changed.
CACHE_ENTRIES = 300_000
REFILL_AFTER = 3_000_000
#: Texts longer than this are encoded chunk by chunk as well, but their chunks may be huge:
#: chunks over the limit bypass the dictionaries.
LONG_CHUNK = 200


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is
    printable in Latin-1, else the next one from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._characters = _byte_characters()
        self._missed = 0
        self._chunks: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one lower-case word, digit or run of signs, by the library's model."""
        found = self._pieces.get(word)
        if found is None:
            spelled = word
            if not word.isascii():
                spelled = "".join([self._characters[b] for b in word.encode()])
            found = array("I", [token.id for token in self._model.tokenize(spelled)]).tobytes()
            if len(self._pieces) < CACHE_ENTRIES:
                self._pieces[word] = found
            elif not self._missed:  # the chunks have just been emptied, too
                self._pieces.clear()
        return found

    def _chunk(self, chunk: str) -> bytes:
        if _LETTERS.fullmatch(chunk):
            ids = self._word(chunk.lower())
        elif len(chunk) > LONG_CHUNK or "<|" in chunk or not _PLAIN.fullmatch(chunk):
            ids = self._library(chunk)
        else:
            ids = b"".join([self._word(p) for p in _PIECE.findall(chunk.lower())])
        if len(chunk) <= LONG_CHUNK:
            if len(self._chunks) < CACHE_ENTRIES:
                self._chunks[chunk] = ids
            else:
                self._missed += 1
                if self._missed > REFILL_AFTER:
                    self._chunks.clear()
                    self._missed = 0
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        chunks = _CHUNK.findall(text) if _SEPARATORS.search(text) else text.split()
        out = list(map(self._chunks.get, chunks))
        if None in out:
            out = [self._chunk(c) if ids is None else ids for c, ids in zip(chunks, out, strict=True)]
        return b"".join(out)


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    return WordEncoder(path)


def id_lists(buffers: list[bytes]) -> pa.Array:
    """An Arrow list<int32> column of the given little-endian id buffers."""
    offsets = np.zeros(len(buffers) + 1, dtype=np.int32)
    np.cumsum([len(b) // 4 for b in buffers], out=offsets[1:])
    values = np.frombuffer(b"".join(buffers), dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
