"""Ids of a byte-level BPE vocabulary, many texts at a time.

The vocabulary's splitting pattern never joins a character with a space before it unless the space stands alone between
two other characters, and never a line end with what follows. So a text without double white space is cut at its spaces
and line ends, each word (with its space) is encoded once and its ids are kept as bytes; texts with other white space go to
the library whole. Words that were not seen yet are encoded together from the same vocabulary's rank file, which is
several times as fast; a sample is compared with the library when a worker starts. All ways give the library's ids.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np

#: Words whose ids a Python worker keeps; then it starts anew.
CACHED_WORDS = 250_000
#: Characters that one call of the library gets.
CALL = 200_000


class ByteTokens:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.ranks = self._rank_encoder(path)
        sample = "It's the  rén’s 12 words,\n\nthatthewords and_more\tça—日本 😀 x"
        if self.ranks.encode_to_numpy(sample).tobytes() != self._whole(sample):
            raise ValueError("the rank file is of another vocabulary")
        self.line_end = self._whole("\n")
        if len(self.line_end) != 4:
            raise ValueError("a line end must be one token")
        self.first: dict[str, bytes] = {}  # words at the start of a line
        self.later: dict[str, bytes] = {}  # words after a space

    @staticmethod
    def _rank_encoder(path: str):
        """The vocabulary as ranks: the file beside ``path`` that ends in .tiktoken."""
        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _learn(self, words: set[str], known: dict[str, bytes], lead: str) -> None:
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = list(words)
        new = [w for w in new if w and not (w[0].isspace() or w[-1].isspace() or "\n" in w)]
        at, end = 0, int.from_bytes(self.line_end, "little")
        while at < len(new):
            to, size = at, 0
            while to < len(new) and (to == at or size < CALL):
                size += len(new[to]) + 2
                to += 1
            ids = self.ranks.encode_to_numpy("\n".join([lead + w for w in new[at:to]]), disallowed_special=()).astype(np.uint32, copy=False)
            cuts = [-1, *np.flatnonzero(ids == end).tolist(), len(ids)]
            if len(cuts) != to - at + 1:
                raise ValueError("words were not kept apart")
            known.update(zip(new[at:to], [ids[a + 1 : b].tobytes() for a, b in zip(cuts, cuts[1:])], strict=True))
            at = to

    def encode(self, texts: list[str], spaced: bool = False) -> list[bytes]:
        """The ids of each text (with a space in front of it, if ``spaced``) as little-endian unsigned 32-bit bytes."""
        lines = [[line.split(" ") for line in text.split("\n")] for text in texts]
        self._learn({line[0] for text in lines for line in text[spaced:]}, self.first, "")
        self._learn({*chain.from_iterable(line[1:] for text in lines for line in text), *(text[0][0] for text in lines if spaced)}, self.later, " ")
        first, later, out = self.first.__getitem__, self.later.__getitem__, []
        for text, (top, *split) in zip(texts, lines, strict=True):
            try:
                rows = [(later if spaced else first)(top[0]) + b"".join(map(later, top[1:]))]
                out.append(self.line_end.join(rows + [first(line[0]) + b"".join(map(later, line[1:])) for line in split]))
            except KeyError:
                out.append(self._whole(" " * spaced + text))
        return out


_tokens: dict[str, ByteTokens] = {}


def byte_tokens(path: str) -> ByteTokens:
    """The worker's encoder for a vocabulary file."""
    if path not in _tokens:
        _tokens[path] = ByteTokens(path)
    return _tokens[path]


def forget() -> None:
    """Drops the worker's encoders."""
    _tokens.clear()
