"""Exact token ids of whole texts from a public tokenizer file, with a word cache.

A byte-level tokenizer never merges across the start of a run of white space. Texts are
cut there, pieces already seen come from a cache and only new ones are encoded, which
gives the ids that encoding the whole text gives (tests compare them).
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np

from edgeloom.llm.common import slices

#: Python counts these as white space, the tokenizer doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_DOUBLE_SPACE = re.compile(r"\s\s")
_CHUNKS = re.compile(r"\s*\S+|\s+")
#: Marks cache keys that hold a chunk as it is; others lack the space in front of them.
_AS_IS = "\x1c"
_ENCODERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


class Encoder:
    """Encodes texts with a tokenizers file; keeps up to `capacity` short pieces, by default as many as a dictionary of 2**20 places takes."""

    def __init__(self, path: str, capacity: int = 690_000):
        self.tokenizer = load_tokenizer(path)
        self.capacity = capacity
        self.cache: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values(), default=0) + 1
        # A byte-level vocabulary writes each byte as one character.
        self.widths = np.zeros(self.size, dtype=np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)

    def encode(self, texts: list[str]):
        """The ids of each text as a little-endian unsigned 32-bit array."""
        for start, end in slices(texts):
            yield from self._slice(texts[start:end])

    def _slice(self, texts: list[str]):
        cut = [_cut(text) for text in texts]
        wanted: set[str] = set()
        for pieces in cut:
            if pieces is not None:
                wanted.update(pieces)
        known = self.cache
        new = [p for p in wanted if p not in known]
        found = dict(zip(new, self._encode_pieces([_chunk(p) for p in new]), strict=True))
        of = {p: known[p] if p in known else found[p] for p in wanted}.__getitem__
        # What finds no room never enters: a dictionary that has grown stays large.
        known.update((p, found[p]) for p in islice((p for p in new if len(p) <= 40), max(0, self.capacity - len(known))))
        return [
            np.array(self._whole([text])[0], dtype="<u4") if pieces is None else np.frombuffer(b"".join(map(of, pieces)), dtype="<u4")
            for text, pieces in zip(texts, cut, strict=True)
        ]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids. Chunks that begin with white space and don't end with it are
        joined to longer texts first and told apart again by the bytes of the tokens."""
        out: list[bytes] = [b""] * len(chunks)
        joined, alone = [], []
        for i, c in enumerate(chunks):
            (joined if len(c) > 1 and c[0] in " \n" and not c[1].isspace() and not c[-1].isspace() else alone).append(i)
        groups = [joined[k : k + 100] for k in range(0, len(joined), 100)]
        for group, ids in zip(groups, self._whole(["".join([chunks[i] for i in g]) for g in groups]), strict=True):
            ids = np.array(ids, dtype="<u4")
            ends = np.cumsum([len(chunks[i].encode("utf-8", "surrogatepass")) for i in group])
            reached = np.cumsum(self.widths[ids])
            at = np.searchsorted(reached, ends)
            if at[-1] + 1 == len(ids) and np.array_equal(reached[at], ends):
                data, start = ids.tobytes(), 0
                for i, end in zip(group, ((at + 1) * 4).tolist(), strict=True):
                    out[i], start = data[start:end], end
            else:  # a tokenizer that normalizes
                alone.extend(group)
        for k in range(0, len(alone), 1000):
            part = alone[k : k + 1000]
            for i, ids in zip(part, self._whole([chunks[i] for i in part]), strict=True):
                out[i] = np.array(ids, dtype="<u4").tobytes()
        return out


def _cut(text: str) -> list[str] | None:
    """Cache keys of the pieces of a text; None where the cut isn't known to be safe."""
    if _SEPARATORS.search(text):
        return None
    if _DOUBLE_SPACE.search(text):
        return [_AS_IS + c for c in _CHUNKS.findall(text)]
    pieces = text.replace("\n", " \n").split(" ")
    pieces[0] = _AS_IS + pieces[0]
    return pieces


def _chunk(piece: str) -> str:
    if piece[:1] == _AS_IS:
        return piece[1:]
    return piece if piece[:1] == "\n" else " " + piece


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
