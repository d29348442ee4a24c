"""Operator 7: token counts that follow edits, by a segment tree over each document's pre-tokens.

A document is cut where the splitting pattern must cut (before white space or punctuation that follows a word), about
``LEAF_WORDS`` such places to a leaf; the tree holds the sums of characters and tokens below each node. An edit descends
by character sums to the leaves it touches, takes in a neighbouring leaf where the text around its border no longer
forces a cut, encodes that region only, and updates the sums on the way up. A region that has grown to more than twice a
leaf is cut into leaves again, so an edit encodes what it inserts and a few leaves, however much was inserted before. The
count is always that of encoding the whole text. A leaf is never shorter than a pre-token, so letters without any white
space or punctuation between them are one leaf, as they are one word of the vocabulary's pattern.
Trees are a table (``planted``): a batch of edits reads it and gives the next one (``updated``), and encodes edited regions only.

Cases: a null text counts as empty (no tokens); null or no edits change nothing, nor does an edit whose start or end is
null; a null replacement removes; edits are (start, end, replacement) in
characters of the original text, applied together; of edits that overlap an earlier one the later is left out; borders
beyond the text are moved to its end; any length is handled; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.byte_tokens import ByteTokens, byte_tokens
from auditspark.llm.shared import slices, small_batches, tokenizer_path, written

#: Places where a leaf may be cut, for each leaf.
LEAF_WORDS = 32
#: What the scrubbing query replaces: addresses, links, and numbers of five digits or more.
SCRUBBED = re.compile(r"(?P<mail>[\w.+-]+@[\w-]+\.[\w.]+)|(?P<link>https?://\S+)|(?P<number>\d[\d ().-]{3,}\d)")
#: A pre-token begins at white space after anything else, and at punctuation after a letter or digit. The characters are
#: those of which every version of Unicode says the same.
_LETTERS = "0-9A-Za-zÀ-ÖØ-öø-ɏЀ-ҁぁ-ゖァ-ヺ一-龥가-힣"
_CUT = re.compile(rf"[ \t\n\r!-/:-@\[-`{{-~、。，！？；：](?:(?<=\S[ \t\n\r])|(?<=[{_LETTERS}][^ \t\n\r]))")


class CountTree:
    """Segment tree over the leaves of one text: ``chars`` and ``tokens`` hold the sums below each node, the root at 1."""

    def __init__(self, text: str, tokens: ByteTokens, leaf_words: int = LEAF_WORDS):
        self._start(tokens, leaf_words)
        leaves = self._cut(text)
        self._plant(leaves, self._counts(leaves, False))

    def _start(self, tokens: ByteTokens, leaf_words: int) -> None:
        self.encoder, self.leaf_words, self.encoded = tokens, leaf_words, 0

    def _cut(self, text: str) -> list[str]:
        cuts = [m.start() for m in _CUT.finditer(text)][self.leaf_words - 1 :: self.leaf_words]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def _counts(self, leaves: list[str], lead: bool) -> list[int]:
        """Tokens of leaves that follow each other; ``lead``: whether text comes before them."""
        # A leaf inside a text is encoded behind "x", which is a token of its own there: its start isn't a text's start.
        follows = [lead, *[True] * (len(leaves) - 1)]
        ids = self.encoder.encode([f"x{leaf}" if f else leaf for leaf, f in zip(leaves, follows, strict=True)])
        return [len(x) // 4 - f for x, f in zip(ids, follows, strict=True)]

    def _plant(self, leaves: list[str], counts: list[int]) -> None:
        """Leaves with their tokens and the sums over them; nothing is encoded."""
        self.leaves = leaves
        self.base = 1 << (len(leaves) - 1).bit_length()
        spare = [0] * (self.base - len(leaves))
        self.tokens = [0] * self.base + counts + spare
        self.chars = [0] * self.base + [len(leaf) for leaf in leaves] + spare
        for k in range(self.base - 1, 0, -1):
            self._sum(k)

    @classmethod
    def stored(cls, text: str, chars: list[int], sums: list[int], tokens: ByteTokens, leaf_words: int = LEAF_WORDS) -> CountTree:
        """The tree with these sums over a text; nothing is encoded."""
        tree, base, at, leaves = cls.__new__(cls), len(chars) // 2, 0, []
        for n in chars[base:]:
            leaves.append(text[at : at + n])
            at += n
        tree._start(tokens, leaf_words)
        tree.leaves, tree.base, tree.chars, tree.tokens = leaves, base, list(chars), list(sums)
        return tree

    def _sum(self, k: int) -> None:
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, offset inside it) of a character; the text's end belongs to its last leaf with characters."""
        k = 1
        at = max(0, min(at, self.chars[1] - 1))
        while k < self.base:
            k *= 2
            if at >= self.chars[k]:
                at -= self.chars[k]
                k += 1
        return k - self.base, at

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        k = self.base + leaf
        self.tokens[k], self.chars[k] = tokens, len(text)
        while k > 1:
            k //= 2
            self._sum(k)

    def _beside(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < len(self.leaves) and not self.leaves[leaf]:
            leaf += step
        return leaf if 0 <= leaf < len(self.leaves) else None

    def replace(self, start: int, end: int, text: str) -> None:
        """Characters start up to end become ``text``."""
        end = max(start, min(end, self.chars[1]))
        low, at = self.find(start)
        if start >= self.chars[1]:
            at = len(self.leaves[low])
        high = self.find(end - 1)[0] if end > start else low
        region = "".join(self.leaves[low : high + 1])
        region = region[:at] + text + region[at + end - start :]
        while (left := self._beside(low, -1)) is not None and not _CUT.match(self.leaves[left][-1] + region[:1], 1):
            region, low = self.leaves[left] + region, left
        while (right := self._beside(high, 1)) is not None and not (region and _CUT.match(region[-1] + self.leaves[right][:1], 1)):
            region, high = region + self.leaves[right], right
        self.encoded += len(region)
        pieces = self._cut(region)
        if len(pieces) <= 2:  # only a region of twice a leaf is split, so each split follows as many insertions
            pieces = [region]
        counts = self._counts(pieces, self._beside(low, -1) is not None)
        room = high + 1 - low
        if len(pieces) > room:
            first, last, of = self.base + low, self.base + high, self.tokens
            leaves = [*self.leaves[:low], *pieces, *self.leaves[high + 1 :]]
            counts = [*of[self.base : first], *counts, *of[last + 1 : self.base + len(self.leaves)]]
            kept = [k for k, leaf in enumerate(leaves) if leaf]
            self._plant([leaves[k] for k in kept], [counts[k] for k in kept])
            return
        for k in range(room):
            if k < len(pieces):
                self._set(low + k, pieces[k], counts[k])
            elif self.leaves[low + k]:
                self._set(low + k, "", 0)

    def text(self) -> str:
        return "".join(self.leaves)


def kept_edits(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits in order of place, without those that start inside an earlier one."""
    kept, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: (e[0], e[1])):
        if start >= at or not kept:
            kept.append((max(0, start), max(start, end, 0), new))
            at = max(start, end)
    return kept


def applied(tree: CountTree, edits: list[tuple[int, int, str]]) -> int:
    """Applies a batch of edits, the last place first; how many there were."""
    kept = kept_edits(edits)
    for start, end, new in reversed(kept):
        tree.replace(start, end, new)
    return len(kept)


TREE = {"text": pa.string(), "chars": pa.list_(pa.int32()), "tokens": pa.list_(pa.int32())}
COUNTS = ("n_tokens", "n_edits", "n_tokens_after", "encoded_chars")


EDITS = "array<struct<start:int,end:int,new:string>>"


def planted(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """(id, text, chars, tokens, edits): each document with the sums of its tree, to be kept as a table between edits.

    A first batch of edits may come with the documents (``edits_col``); later ones are joined to the table by id (rows
    without id then keep their text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_tokens(vocabulary)
        for b in slices(batches):
            trees = [CountTree(text, own) for text in b.column(1).to_pylist()]
            sums = (pa.array([getattr(t, x) for t in trees], TREE[x]) for x in ("chars", "tokens"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *sums, b.column(2)], names=["id", *TREE, "edits"])

    small_batches(df.sparkSession)
    edits = df[edits_col] if edits_col else F.lit(None)
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), edits.cast(EDITS).alias("edits"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, chars array<int>, tokens array<int>, edits {EDITS}")
    return out.withColumnRenamed("id", id_col)


def updated(trees: DataFrame, vocabulary: str, id_col: str = "doc_id", edits_col: str | None = None, keep_trees: bool = True) -> DataFrame:
    """(id, text, chars, tokens, n_tokens, n_edits, n_tokens_after, encoded_chars) of ``planted`` rows after a batch of edits.

    The result is again a table of trees, for the next batch; without ``keep_trees`` it has the counts only. ``edits_col``
    is an array of structs (start int, end int, new string); without it the scrubbing edits are applied.
    """

    def changes(text: str, edits: list[dict] | None) -> list[tuple[int, int, str]]:
        if edits_col is None:
            return [(m.start(), m.end(), f"<{m.lastgroup}>") for m in SCRUBBED.finditer(text)]
        return [(e["start"], e["end"], e["new"] or "") for e in edits or () if e and e["start"] is not None and e["end"] is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_tokens(vocabulary)
        for b in slices(batches):
            counts, after = [], []
            for text, chars, sums, edits in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
                tree = CountTree.stored(text, chars, sums, own)
                before = tree.total
                counts.append((before, applied(tree, changes(text, edits)), tree.total, tree.encoded))
                if keep_trees:
                    after.append((tree.text(), tree.chars, tree.tokens))
            new = [pa.array(c, t) for c, t in zip(zip(*after, strict=True), TREE.values(), strict=True)] if keep_trees else []
            yield pa.RecordBatch.from_arrays([b.column(0), *new, *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True))], names=["id", *(TREE if keep_trees else ()), *COUNTS])

    small_batches(trees.sparkSession)
    edits = trees[edits_col] if edits_col else F.lit(None)
    rows = trees.select(trees[id_col].alias("id"), "text", "chars", "tokens", edits.cast(EDITS).alias("edits"))
    kept = "text string, chars array<int>, tokens array<int>, " if keep_trees else ""
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {kept}{', '.join(f'{c} long' for c in COUNTS)}")
    return out.withColumnRenamed("id", id_col)


def recounted(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """(id, n_tokens, n_edits, n_tokens_after, encoded_chars) of one batch of edits, with no table of trees in between."""
    return updated(planted(df, vocabulary, id_col, text_col, edits_col), vocabulary, id_col, edits_col and "edits", keep_trees=False)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after scrubbing, by incremental recounts of stored trees."""
    vocabulary = tokenizer_path("byte_bpe_50k.json")
    trees = written(planted(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary).drop("edits"), "count-trees")
    return updated(trees, vocabulary, keep_trees=False)
