"""Operator 4: language of texts and of the spans inside them.

A word's script (by code point ranges) narrows the languages it may belong to: those that were seen in that script.
Among them each language has a score, the log-likelihood of the word's letter groups under that language against the
mean of all. Viterbi then labels the words of a text, a change of language costing ``PENALTY``; runs of words with one
label are spans. The document's language is the one with most letters, its score that language's share of the letters.

A word in a script that no language was learned in, or without a known letter group, belongs to no language: its span is
``und`` and its letters count in the share for none. Every text with a letter still gets the learned language that it is
likest to. Whether that language is ``known`` to be the text's is a column of its own: not if letters of no language are the
most, nor if the words of the main language are too unlike it: their mean log-likelihood a letter group must reach half way
from the language's own mean to that of the learned language nearest to it, less ``DOUBT`` standard errors for few letters.

Viterbi runs over many texts of similar length at once: step t handles the t-th word of every text that has one.

Fitting takes at most ``SAMPLE`` rows with a known language (those with the smallest id hashes) and keeps at most
``GROUPS`` letter groups. Cases: a null text, or one without letters, is ``und`` with score 0; without any row to learn from
every text is ``und``; repeated rows get equal results; a text of any length is labelled whole, by itself if it is long;
other columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.shared import by_length, id_text, lean, sampled_ids, slices
from auditspark.llm.toxicity import learnable

#: Most rows of a fit, most letter groups, cost of a change of language, bound of a word's score.
SAMPLE, GROUPS, PENALTY, BOUND = 20_000, 200_000, 8.0, 6.0
#: Standard errors that the mean likelihood of a document may lie too low.
DOUBT = 3.0
#: Texts, and bytes of text, that Viterbi handles at once. Words whose scores a worker keeps.
TOGETHER, BYTES = 2048, 1 << 19
CACHED_WORDS = 300_000
#: Words scored in one call, and entries of a direct table of letter groups.
CALL, DIRECT = 20_000, 1 << 22
#: First and last code point of scripts (blocks of the Unicode standard).
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0xF900, 0xFAFF),
)
_WORD = re.compile(r"[^\W\d_]+")
_STARTS = np.array(sorted(s[1] for s in SCRIPTS))
_BY_START = sorted(SCRIPTS, key=lambda s: s[1])


def script(word: str) -> str:
    """The script of a word's first letter, ``other`` outside all ranges."""
    k = int(np.searchsorted(_STARTS, ord(word[0]), "right")) - 1
    return _BY_START[k][0] if k >= 0 and ord(word[0]) <= _BY_START[k][2] else "other"


def groups(word: str) -> list[str]:
    """One to three neighbouring letters, with the word's borders."""
    w = f"^{word}$"
    return [w[k : k + n] for n in (1, 2, 3) for k in range(len(w) - n + 1)][1:]


def group_numbers(lengths: np.ndarray) -> np.ndarray:
    """How many groups words of these lengths have."""
    return 3 * lengths + 2


def words_of(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    return words if "".join(words).isalpha() else [t for w in words for t in ([w] if w.isalpha() else _letters(w).split())]


def _letters(word: str) -> str:
    """The word with spaces for what is no letter (superscripts, fractions)."""
    return "".join(c if c.isalpha() else " " for c in word)


def _places(text: str) -> list[tuple[int, int]]:
    """Start and end of every word in the text."""
    out = []
    for m in _WORD.finditer(text):
        out += [m.span()] if m[0].isalpha() else [(m.start() + part.start(), m.start() + part.end()) for part in re.finditer(r"\S+", _letters(m[0]))]
    return out


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> dict:
    """Languages, the scripts of each, and scores of letter groups, from rows that may be learned from."""
    usable = df.where(learnable(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = sampled_ids(usable, id_col, most).distinct()
    sample = usable.join(F.broadcast(ids), id_col).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for b in slices(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.update([(lang, w) for w in words_of(text)])
        counts: Counter = Counter()
        for (lang, word), n in words.items():
            counts[lang, "script", script(word)] += n
            for g in groups(word):
                counts[lang, "group", g] += n
        cols = list(zip(*((*k, n) for k, n in counts.items()), strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "kind", "item", "n"])

    counted = sample.mapInArrow(lean(run), "lang string, kind string, item string, n long").groupBy("kind", "item", "lang").agg(F.sum("n").alias("n"))
    table = counted.groupBy("kind", "item").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by")).where("total >= 3 OR kind = 'script'")
    rows = table.orderBy(F.col("kind") != "script", F.desc("total"), "item").limit(GROUPS).collect()
    langs = sorted({x["lang"] for r in rows for x in r["by"]})
    at = {lang: k for k, lang in enumerate(langs)}
    used = np.zeros(len(langs))
    seen: dict[str, np.ndarray] = {}
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        line = np.zeros(len(langs))
        for x in r["by"]:
            line[at[x["lang"]]] = x["n"]
        if r["kind"] == "script":
            seen[r["item"]] = line
        else:
            counts[r["item"]] = line
            used += line
    letters = sum(seen.values()) if seen else used
    scripts = {s: line >= 0.01 * letters for s, line in seen.items()}
    table = np.array(list(counts.values())).reshape(len(counts), len(langs))
    log = np.log((table + 0.5) / (used + 0.5 * len(counts)))
    scores = (log - log.mean(1, keepdims=True)).astype(np.float32) if counts else log.astype(np.float32)
    return {"langs": langs, "scripts": scripts, "groups": "\n".join(counts), "scores": scores, **_likelihoods(table, used)}


def _likelihoods(counts: np.ndarray, used: np.ndarray) -> dict:
    """Of the letter groups' counts (groups x languages): their mean log-likelihoods, that of an unknown group, and the
    least mean of a text and the deviation of one group by language."""
    if not counts.size:
        return {"means": np.zeros(len(counts)), "unknown": np.zeros(len(used)), "least": np.zeros(len(used)), "deviation": np.zeros(len(used))}
    p = (counts + 0.5) / (used + 0.5 * len(counts))
    log = np.log(p)
    cross = p.T @ log  # row: language of the text, column: language that it is taken for
    own = np.diag(cross).copy()
    np.fill_diagonal(cross, -np.inf)
    other = cross.max(0) if len(used) > 1 else log.mean(0)
    return {"means": log.mean(1), "unknown": np.log(0.5 / (used + 0.5 * len(counts))), "least": (own + other) / 2, "deviation": np.sqrt(np.maximum((p * log**2).sum(0) - own**2, 0))}


class _Groups:
    """Rows of letter groups: a group's characters are digits of a number to the base of the alphabet's size."""

    def __init__(self, groups: list[str]):
        alphabet = sorted(set("".join(groups)))
        self.letters = np.array([ord(c) for c in alphabet], np.uint32)
        self.base = len(alphabet) + 2  # 0: nothing, the last: any other character
        codes = [0] * len(groups)
        digit = {c: k for k, c in enumerate(alphabet, 1)}
        for k, g in enumerate(groups):
            for c in g:
                codes[k] = codes[k] * self.base + digit[c]
        order = np.argsort(np.array(codes, np.int64), kind="stable")
        self.codes, self.rows = np.array(codes, np.int64)[order], (order + 1).astype(np.int32)
        self.direct = None
        if self.base**3 <= DIRECT:
            self.direct = np.zeros(self.base**3, np.int32)
            self.direct[self.codes] = self.rows

    def _row(self, codes: np.ndarray) -> np.ndarray:
        """1 + the number of each group, 0 for unknown ones."""
        if self.direct is not None:
            return self.direct[codes]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.rows[at], 0)

    def found(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the groups that end at each character, one, two and three long; start of each word)."""
        points = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(w) for w in words], np.int64) + 2
        starts = np.cumsum(sizes) - sizes
        if not len(self.codes):
            return np.zeros((3, len(points)), np.int32), starts
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        digit = np.where(self.letters[at] == points, at + 1, self.base - 1).astype(np.int64)
        rows = np.zeros((3, len(points)), np.int32)
        code = digit
        for n in range(3):
            if n:
                code = digit[n:] + self.base * code[:-1]
            rows[n, n:] = self._row(code)
        rows[:, starts] = 0  # no group ends at the front border
        rows[2, starts + 1] = 0
        return rows, starts


class _Scores(dict):
    """Row numbers of words in a growing table of scores by language. New words are scored many at a time."""

    def __init__(self, model: dict):
        super().__init__()
        self.n = len(model["langs"])
        names = model["groups"].split("\n") if model["groups"] else []
        self.groups, self.border = _Groups(names), "$" in names
        # row 0: no group; last column: the mean over all languages
        self.group_scores = np.pad(np.column_stack([model["scores"], model["means"]]).astype(np.float32), ((1, 0), (0, 0)))
        self.unknown = model["unknown"]
        self.scripts = model["scripts"]
        self.no_fit: dict[str, np.ndarray | None] = {}  # by a word's first letter: languages that it can't belong to
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.table = np.zeros((0, self.n), np.float32)
        self.likelihood = np.zeros((0, self.n), np.float32)  # of the whole word, by language
        self.nowhere = np.zeros(0, bool)  # words that belong to no language

    def _unfit(self, letter: str) -> np.ndarray | None:
        if letter not in self.no_fit:
            fits = self.scripts.get(script(letter))
            self.no_fit[letter] = np.ones(self.n, bool) if fits is None else None if fits.all() else ~fits
        return self.no_fit[letter]

    def learn(self, words: set[str], most: int = CACHED_WORDS) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > most:
            self._forget()
            new = list(words)
        if not new:
            return
        found = [self._scored(new[at : at + CALL]) for at in range(0, len(new), CALL)]
        self.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
        self.table, self.likelihood, self.nowhere = (np.concatenate([old, *parts]) for old, parts in zip((self.table, self.likelihood, self.nowhere), zip(*found, strict=True), strict=True))

    def _scored(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bounded scores, log-likelihoods, whether it belongs to no language) of each word."""
        rows, starts = self.groups.found(words)
        sums = np.add.reduceat(self.group_scores[rows[0]] + self.group_scores[rows[1]] + self.group_scores[rows[2]], starts, axis=0)
        known = np.add.reduceat((rows > 0).sum(0), starts)
        sizes = group_numbers(np.array([len(w) for w in words]))
        likelihood = sums[:, :-1] + sums[:, -1:] + (sizes - known)[:, None] * self.unknown
        nowhere = known <= self.border  # the border alone
        scores = np.clip(sums[:, :-1], -BOUND, BOUND)
        first: dict[str, list[int]] = {}
        for k, word in enumerate(words):
            first.setdefault(word[0], []).append(k)
        for letter, at in first.items():
            unfit = self._unfit(letter)
            if unfit is not None:
                nowhere[at] |= unfit.all()
                scores[np.ix_(at, np.flatnonzero(unfit))] = -3 * BOUND
        scores[nowhere] = 0
        return scores.astype(np.float32), likelihood.astype(np.float32), nowhere


def viterbi(scores: np.ndarray, sizes: list[int], penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word: texts' words lie one after another in ``scores`` (words x languages)."""
    sizes_ = np.array(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes_)[:-1]]).astype(np.int64)
    order = np.argsort(-sizes_, kind="stable")
    starts, sizes_ = starts[order], sizes_[order]
    labels = np.zeros(len(scores), np.int32)
    if not len(scores):
        return labels
    alive = np.searchsorted(-sizes_, -np.arange(1, sizes_[0] + 1), "right")  # texts with a t-th word
    value = scores[starts[: alive[0]]].astype(np.float64)
    came, stayed = [], []
    ends = np.empty(alive[0], np.int64)
    for t in range(1, len(alive) + 1):
        now = alive[t] if t < len(alive) else 0
        if now < len(value):
            ends[now : len(value)] = value[now:].argmax(1)
            value = value[:now]
        if not now:
            break
        best = value.argmax(1)
        change = (value[np.arange(now), best] - penalty)[:, None]
        stay = value >= change
        came.append(best.astype(np.int32))
        stayed.append(stay)
        value = np.where(stay, value, change) + scores[starts[:now] + t]
    state = np.empty(0, np.int64)
    for t in range(len(alive) - 1, -1, -1):
        state = np.concatenate([state, ends[len(state) : alive[t]]])
        labels[starts[: alive[t]] + t] = state
        if t:
            state = np.where(stayed[t - 1][np.arange(alive[t]), state], state, came[t - 1])
    return labels


def _labelled(texts: list[list[str]], cache: _Scores) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, text number, row in the cache) of every word; words of no language have the label after the last one."""
    sizes = [len(ws) for ws in texts]
    cache.learn(set().union(*texts))
    at = np.array([cache[w] for ws in texts for w in ws], np.int64)
    labels = viterbi(cache.table[at], sizes)
    labels[cache.nowhere[at]] = cache.n
    return labels, np.repeat(np.arange(len(texts)), sizes), at


def predicted(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, known) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, langs = _Scores(model), np.array([*model["langs"], "und"], object)
        least, deviation = np.append(model["least"], -np.inf), np.append(model["deviation"], 0.0)
        for b in by_length(batches, BYTES, TOGETHER):
            texts = [words_of(t) if cache.n else [] for t in b.column(1).to_pylist()]
            labels, number, at = _labelled(texts, cache)
            sizes = np.array([len(w) for ws in texts for w in ws], np.float64)
            letters = np.bincount(number * (cache.n + 1) + labels, sizes, len(texts) * (cache.n + 1)).reshape(len(texts), -1)
            total, best = letters.sum(1), np.full(len(texts), cache.n)
            if cache.n:
                best = letters[:, :-1].argmax(1)
                for k in np.flatnonzero((letters[:, :-1].sum(1) == 0) & (total > 0)):  # no word of any language: the likeliest one
                    best[k] = cache.likelihood[at[number == k]].sum(0).argmax()
                best[total == 0] = cache.n
            main = np.flatnonzero((labels == best[number]) & (labels < cache.n))
            likelihood = np.bincount(number[main], cache.likelihood[at[main], labels[main]], len(texts))
            mean = likelihood / np.maximum(np.bincount(number[main], group_numbers(sizes[main]), len(texts)), 1)
            own = letters[np.arange(len(texts)), best]
            like = mean + DOUBT * deviation[best] / np.sqrt(np.maximum(own, 1)) >= least[best]
            known = (best < cache.n) & like & (own >= letters[:, -1]) & (own > 0)
            score = np.where(best < cache.n, own / np.maximum(total, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs[best], pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.bool_())], names=["id", "lang_pred", "score", "known"])

    rows = id_text(df, id_col, text_col)
    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, known boolean")


def spans(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array of (start, end, lang)) of every row, in characters of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, langs = _Scores(model), [*model["langs"], "und"]
        for b in by_length(batches, BYTES, TOGETHER):
            texts = b.column(1).to_pylist()
            found = [_places(t) if cache.n else [] for t in texts]
            labels, _, _ = _labelled([[t[start:end].lower() for start, end in places] for t, places in zip(texts, found, strict=True)], cache)
            out, at = [], 0
            for places in found:
                row: list[dict] = []
                for (start, end), label in zip(places, labels[at : at + len(places)], strict=True):
                    if row and row[-1]["lang"] == langs[label]:
                        row[-1]["end"] = end
                    else:
                        row.append({"start": start, "end": end, "lang": langs[label]})
                out.append(row)
                at += len(places)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))], names=["id", "spans"])

    rows = id_text(df, id_col, text_col)
    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<start:int,end:int,lang:string>>")


def languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, known) of every row, learned from the rows' own known languages."""
    out = predicted(df, fit(df, id_col, text_col, lang_col), id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.coalesce(~learnable(F.col("id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "known")


def op4_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
