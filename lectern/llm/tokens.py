"""Token ids of whole texts, by a public tokenizer file, one white-space run to the next at a time."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import chain

#: Code points of Unicode's White_Space property, as a character class.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[^{WHITE_SPACE}]+")
#: ``str.split`` also cuts here, though these are no white space.
_SEPARATORS = "\x1c\x1d\x1e\x1f"

#: Latin letters that case folding and composition treat one by one, then sentence marks.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

#: Entries of a worker's memory of encoded chunks (about 200 bytes each); a full memory starts anew.
CACHE_ENTRIES = 600_000

#: Byte-level vocabularies write a byte without a printable Latin-1 form as the next unused code point from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def chunks(text: str) -> list[str]:
    """The runs of a text that hold no white space."""
    if any(c in text for c in _SEPARATORS):
        return _CHUNK.findall(text)
    return text.split()


class ChunkEncoder:
    """Encode texts with a tokenizer that drops white space and merges nothing across it.

    Such a tokenizer gives a text the ids of its chunks in order, so frequent chunks are encoded once. Strings of special
    tokens hold no white space, so a chunk with one has its ids in the text too.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.entries = entries
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        parts = [chunks(text) for text in texts]
        distinct = set(chain.from_iterable(parts))
        missing = distinct.difference(self.known)
        if len(self.known) + len(missing) > self.entries:
            self.known.clear()
            missing = distinct
        if missing:
            self.learn(missing)
        of = self.known.__getitem__
        return [b"".join(map(of, words)) for words in parts]

    def learn(self, missing: set[str]) -> None:
        """Remember the ids of chunks.

        A plain word goes straight to the merges, in lower case, and marks after it are words of their own; the
        whole pipeline of the tokenizer takes everything else.
        """
        tokenize, rest = self.tokenizer.model.tokenize, []
        if len(self.stems) > self.entries:
            self.stems.clear()
        for chunk in missing:
            plain = _PLAIN.fullmatch(chunk)
            if not plain:
                rest.append(chunk)
                continue
            stem, marks = plain.groups()
            stem = stem.lower()
            ids = self.stems.get(stem)
            if ids is None:
                letters = stem if stem.isascii() else stem.encode().decode("latin-1").translate(_BYTE_LEVEL)
                ids = self.stems[stem] = array("I", [token.id for token in tokenize(letters)]).tobytes()
            if marks:
                if marks not in self.stems:
                    self.stems[marks] = array("I", self.tokenizer.encode(marks, add_special_tokens=False).ids).tobytes()
                ids += self.stems[marks]
            self.known[chunk] = ids
        found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        self.known.update((chunk, array("I", one.ids).tobytes()) for chunk, one in zip(rest, found))


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file; it outlives the task."""
    return ChunkEncoder(path)
