"""Operator 1: exact encoding and decoding with a merge-type piece vocabulary, by backtracking.

A merge-type (BPE) encoder joins neighbouring symbols in order of piece score. Its result can be found without
running the merges over the whole text: a row of pieces is the encoding exactly if every piece encodes to itself and
every two neighbours stay apart when their joined text is merged anew. The encoder therefore walks from left to right,
takes the longest piece that the Aho-Corasick automaton found at a position and that is compatible with the piece
before it, falls back to shorter ones, and steps back where none fits; a bitfield remembers positions from which no
continuation exists, so each position fails at most once.

Cases: a null text counts as empty; an empty text has no ids and decodes to an empty text; characters without a piece
become byte pieces; any length is handled, since the text is cut where no piece can reach across (before a space mark
that follows another character). Repeated rows give repeated rows. Other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.shared import id_text, slices

#: The mark that stands for a space in pieces.
SPACE = "▁"
#: Units (words with their space mark) after which a Python worker starts a new cache; it keeps the last one too.
CACHED_UNITS = 400_000
#: Most piece pairs whose compatibility a worker keeps.
CACHED_PAIRS = 1_000_000


class PieceCodec:
    """Encoder and decoder for one model file; holds per-worker caches."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.scores = {piece: sp.get_score(i) for piece, i in self.ids.items()}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.chars = chars = {c for piece in self.ids for c in piece}
        #: Character pairs inside pieces; between two others a text can be cut.
        self.bigrams = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        if not chars <= self.ids.keys():
            raise ValueError("a piece holds a character that is no piece itself")
        #: Whether a piece may hold a space mark after another character; then texts can't be cut at words.
        self.crosses = any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        self.automaton = ahocorasick.Automaton()
        own = {p: (len(p), i) for p, i in self.ids.items() if len(p) == 1 or self.merged(p) == [p]}  # others never occur
        #: By id: the next shorter piece at the same place, or None.
        self.shorter = {i: next((own[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in own), None) for p, (_, i) in own.items()}
        for piece, match in own.items():
            self.automaton.add_word(piece, match)
        self.automaton.make_automaton()
        self.cuts = self.cut_pattern(chars)
        self.foreign = re.compile(f"[^{re.escape(''.join(sorted(chars)))}]+")
        self.piece_bytes = {i: piece.replace(SPACE, " ").encode() for piece, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.spaced = {i: text.startswith(b" ") and i not in self.byte_ids for i, text in self.piece_bytes.items()}
        self.decimals = {i: str(i) for i in self.piece_bytes}
        #: Whether normalising only adds the leading space mark and writes the mark for spaces.
        sample = " a  B\u00e9e\u0301\u00a0\u3000\ufb01\u2460\t\r\n\u200b\uff21\x01 "
        self.plain = sp.normalize(sample) == SPACE + sample.replace(" ", SPACE)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.units = _Units(self)

    def cut_pattern(self, chars: set[str]) -> re.Pattern:
        """A pattern whose matches are units: no piece reaches from one into the next.

        ``ends`` are characters that no piece has after another one outside ``ends``, so a text can be cut before a
        run of them; ``bound`` are those of them that no piece has before one outside ``ends``.
        """
        pairs = self.bigrams
        ends = {c for c in chars if not c.isalnum() and c != SPACE}
        while held := {p[1] for p in pairs if p[1] in ends and p[0] not in ends and p[0] != SPACE}:
            ends -= held
        bound = {p[0] for p in pairs if p[0] in ends and p[1] not in ends and p[1] != SPACE}
        word, bound = (re.escape("".join(sorted(x))) for x in (chars - ends - {SPACE}, bound))
        end, free = f"[^{SPACE}{word}]", f"[^{SPACE}{word}{bound}]"
        return re.compile(f"{SPACE}*[{word}]+|{SPACE}*{end}*{free}(?!{end})|{SPACE}*{end}+[{word}]*|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """The merges run on a short text: the best-scored neighbouring pair first, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces stay apart when their joined text is merged anew."""
        pieces = [self.sp.id_to_piece(left), self.sp.id_to_piece(right)]
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        known = self.pairs[left, right] = self.merged("".join(pieces)) == pieces
        return known

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text of known characters only."""
        longest, shorter, pairs, n = self.automaton.iter_long, self.shorter, self.pairs, len(text)
        ids = [match[1] for _, match in longest(text)]
        if all(map(pairs.get, zip(ids, ids[1:], strict=False))):  # the longest ones fit, as they do in most words
            return ids
        matches = longest(text)
        row: list[tuple[int, int]] = []
        at, failed, strayed = 0, 0, False  # failed, bit p: no valid row of pieces continues from position p
        match = next(matches)[1]
        before = -1
        while True:
            while match:
                if not failed or not failed >> (at + match[0]) & 1:
                    fits = before < 0 or pairs.get((before, match[1]))
                    if fits or fits is None and self.compatible(before, match[1]):
                        break
                match = shorter[match[1]]
                strayed = True
            if not match:  # step back and try a shorter piece there
                failed |= 1 << at
                if not row:
                    raise ValueError(f"no encoding of {text!r}")
                last = row.pop()
                at -= last[0]
                before = row[-1][1] if row else -1
                match = shorter[last[1]]
                continue
            row.append(match)
            at += match[0]
            if at == n:
                return [x[1] for x in row]
            before = match[1]
            if strayed:
                matches, strayed = longest(text, at), False
            match = next(matches)[1]

    def unit(self, text: str) -> list[int]:
        """Ids of a unit; runs of characters without a piece become byte pieces."""
        if self.chars.issuperset(text):
            return self.backtrack(text)
        ids: list[int] = []
        at = 0
        for run in self.foreign.finditer(text):
            if run.start() > at:
                ids += self.backtrack(text[at : run.start()])
            ids += [self.byte_ids[b] for b in run.group().encode()]
            at = run.end()
        return ids + self.backtrack(text[at:]) if at < len(text) else ids

    def encoded(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """(ids, their decimal text) of the units of a text, in order."""
        if not text:
            return []
        normal = SPACE + text.replace(" ", SPACE) if self.plain else self.sp.normalize(text)
        if self.crosses:
            return [self.units.computed(normal)]
        units = self.units
        return [units[u] for u in self.cuts.findall(normal)]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids for ids, _ in self.encoded(text)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the pieces' bytes in a row, without the space that encoding put in front.

        Ids beside ordinary and byte pieces, and bytes that are no text, are left to the library's rules.
        """
        try:
            text = b"".join([self.piece_bytes[i] for i in ids]).decode()
        except (KeyError, UnicodeDecodeError):
            return self.sp.decode(ids)
        return text[1:] if ids and self.spaced[ids[0]] else text


class _Units(dict):
    """Encodings by unit: (ids, their decimal text)."""

    def __init__(self, codec: PieceCodec):
        super().__init__()
        self.codec = codec
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}  # what filled the cache last time

    def computed(self, text: str) -> tuple[tuple[int, ...], str]:
        ids = tuple(self.codec.unit(text))
        return ids, ",".join([self.codec.decimals[i] for i in ids])

    def __missing__(self, text: str) -> tuple[tuple[int, ...], str]:
        value = self.older.get(text)
        if value is None:
            if len(text) > 2 and not text[-1].isalnum() and text[-2:] not in self.codec.bigrams:  # a word and its full stop
                word, stop = self[text[:-1]], self[text[-1]]
                value = word[0] + stop[0], f"{word[1]},{stop[1]}"
            else:
                value = self.computed(text)
        if len(text) <= 64:
            if len(self) >= CACHED_UNITS:
                self.older = dict(self)
                self.clear()
            self[text] = value
        return value


#: By model file.
_codecs: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """The worker's codec for a model file."""
    if model_path not in _codecs:
        gc.freeze()  # the caches hold no cycles; looking for some in them takes a fifth of the time
        gc.disable()
        _codecs[model_path] = PieceCodec(model_path)
    return _codecs[model_path]


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for b in slices(batches):
            ids = pa.array([own.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    rows = id_text(df, id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    rows = df.select(df[id_col].alias("id"), df[ids_col].cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every row in one pass: (id, n_tokens, ids_sha256, decoded_sha256).

    The digests are lowercase hex SHA-256 of the decimal ids joined by commas and of the decoded text in UTF-8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = codec(model_path), hashlib.sha256
        for b in slices(batches):
            counts, id_digests, digests = [], [], []
            for text in b.column(1).to_pylist():
                units = own.encoded(text)
                ids = list(chain.from_iterable([u[0] for u in units]))
                counts.append(len(ids))
                id_digests.append(sha(",".join([u[1] for u in units]).encode()).hexdigest())
                digests.append(sha(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(digests, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = id_text(df, id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the public 32k piece vocabulary."""
    from auditspark.llm.shared import tokenizer_path

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model")).select(F.col("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
