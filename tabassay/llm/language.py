"""Language of texts: script ranges, scores of words, and Viterbi over the words.

A word's script, by ranges of code points, leaves the languages that are written in
it; sums of log chances of its letter pairs and triples score it in each of them.
Viterbi over the words of a text, with a penalty for each switch, labels spans of one
language. The language with the most letters is the text's, its share is the score.

The model is learned from about ``sample`` labelled texts of each language, all where
there are no more (whole texts, drawn by a hash below the share that is wanted); its
counts are summed by Spark, and what reaches the driver is bounded by languages times
hash places.

Defined results: a null text and one without a letter is ``und`` with score 0, and so
is every text when nothing was learned; equal shares go to the language that sorts
first; rows with equal ids are judged each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.llm.tables import remembered, small_batches

UNKNOWN = "und"
SAMPLE = 2000
DRAWS = 1 << 31
SWITCH_PENALTY = 12.0
#: Texts of one batch, and characters of its texts that are labelled together, the
#: longest texts first: their words advance side by side, one step for each position.
BATCH, BLOCK_CHARS = 4000, 1 << 21
PLACES = 1 << 17
WORDS_KEPT = 200_000
#: A language is written in a script that holds this share of its letters.
SCRIPT_SHARE = 0.01

# First code points of script blocks, in order; None is any other script.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, None), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, None),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, None), (0x0E00, "thai"), (0x0E80, None), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, None), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, None), (0x2C60, "latin"), (0x2C80, None),
    (0x3040, "kana"), (0x3100, None), (0x3400, "han"), (0xA000, None),
    (0xAC00, "hangul"), (0xD7B0, None), (0xF900, "han"), (0xFB00, None),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, None), (0x20000, "han"), (0x32000, None),
]
_STARTS = np.array([start for start, _ in SCRIPTS])
_NAMES = sorted({name or "" for _, name in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(name or "") for _, name in SCRIPTS])

WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: the word and the place of each letter group; the words' scripts."""
    joined = f" {' '.join(w.lower().replace(' ', '') for w in words)} "
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    blank = codes == 32
    word = np.cumsum(blank) - 1
    first, second, third = codes[:-2], codes[1:-1], codes[2:]
    inner = ~blank[1:-1]
    triples = (first * 0x9E3779B1 + second * 0x85EBCA6B + third * 0xC2B2AE35) >> 7
    pairs = (first * 0x27D4EB2F + second * 0x165667B1) >> 5
    places = np.concatenate([triples[inner], pairs[inner]]) % PLACES
    owner = np.concatenate([word[1:-1][inner], word[1:-1][inner]])
    heads = np.flatnonzero(blank)[: len(words)] + 1
    scripts = _SCRIPT_OF[np.searchsorted(_STARTS, codes[heads], "right") - 1]
    return owner, places, scripts


@dataclass
class Model:
    """Log chances of the places by language; the languages written in each script."""

    languages: list[str]
    chances: np.ndarray
    written: np.ndarray

    def digest(self) -> str:
        """Tells models apart."""
        whole = hashlib.sha256(repr(self.languages).encode())
        for part in (self.chances, self.written):
            whole.update(np.ascontiguousarray(part).data)
        return whole.hexdigest()

    def scores(self, words: list[str]) -> np.ndarray:
        """Score of each word in each language, relative to the best one."""
        owner, places, scripts = _features(words)
        out = np.zeros((len(words), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, self.chances[k][places], minlength=len(words))
        allowed = self.written[scripts]
        some = allowed.any(axis=1)
        out[~some] = 0.0  # no learned language has this script: the word says nothing
        out[some] = np.where(allowed[some], out[some], -np.inf)
        out -= out.max(axis=1, keepdims=True)
        return np.maximum(out, -1e3).astype(np.float32)


def learn(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE,
) -> Model:
    """The model of the labelled rows of ``docs`` that are not held out."""
    small_batches(docs.sparkSession)
    known = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)
    order = F.pmod(F.xxhash64(F.lit(7), F.col(id_col), F.col(text_col)), F.lit(DRAWS))
    rows = docs.filter(known).select(
        F.col(lang_col).cast("string").alias("lang"), order.alias("at"), F.col(text_col).alias("t")
    )
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    limits = {lang: DRAWS * min(1.0, sample / n) for lang, n in sizes.items()}
    languages = sorted(limits)
    if not languages:
        return Model([], np.zeros((0, PLACES)), np.zeros((len(_NAMES), 0), dtype=bool))
    within = F.lit(False)
    for lang, limit in limits.items():
        within |= (F.col("lang") == lang) & (F.col("at") < limit)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["t"]:
                words = [w for t in texts for w in WORD.findall(t)]
                if not words:
                    continue
                _, places, scripts = _features(words)
                totals = np.bincount(places, minlength=PLACES)
                letters = np.bincount(scripts, [len(w) for w in words], minlength=len(_NAMES))
                at, script = np.flatnonzero(totals), np.flatnonzero(letters)
                yield pd.DataFrame(
                    {
                        "lang": lang,
                        "place": np.concatenate([at, -1 - script]),
                        "n": np.concatenate([totals[at], letters[script].astype(np.int64)]),
                    }
                )

    counted = (
        rows.filter(within)
        .mapInPandas(count, "lang string, place long, n long")
        .groupBy("lang", "place")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    chances = np.full((len(languages), PLACES), 0.5)
    letters = np.zeros((len(_NAMES), len(languages)))
    for k, lang in enumerate(languages):
        own = counted[counted["lang"] == lang]
        place, n = own["place"].to_numpy(), own["n"].to_numpy()
        chances[k][place[place >= 0]] += n[place >= 0]
        letters[-1 - place[place < 0], k] = n[place < 0]
    chances = np.log(chances / chances.sum(axis=1, keepdims=True))
    share = letters / np.maximum(letters.sum(axis=0, keepdims=True), 1)
    return Model(languages, chances, share >= SCRIPT_SHARE)


def best_path(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float):
    """Viterbi labels of the words of many texts at once.

    ``scores`` has a row for each word, a text's words being rows ``starts`` to
    ``starts + sizes``. Texts advance together, the long ones staying on.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    total, languages = scores.shape
    stay = np.ones((total, languages), dtype=bool)
    come = np.zeros(total, dtype=np.int16)
    labels = np.zeros(total, dtype=np.int16)
    steps = int(sizes[0]) if len(sizes) else 0
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), "right")
    value = scores[starts[: active[0]]].astype(np.float64) if steps else None
    ends = np.zeros(len(sizes), dtype=np.int16)
    for step in range(1, steps):
        now = active[step]
        if now < len(value):
            ends[now : len(value)] = value[now:].argmax(axis=1)
            value = value[:now]
        at = starts[:now] + step
        top = value.max(axis=1, keepdims=True) - penalty
        stays = value >= top
        stay[at] = stays
        come[at] = value.argmax(axis=1)
        value = np.where(stays, value, top) + scores[at]
    if steps:
        ends[: len(value)] = value.argmax(axis=1)
    label = np.zeros(0, dtype=np.int16)
    for step in range(steps - 1, -1, -1):
        now = active[step]
        if now > len(label):
            label = np.concatenate([label, ends[len(label) : now]])
        at = starts[:now] + step
        labels[at] = label
        if step:
            label = np.where(stay[at, label], label, come[at])
    return labels


class Labeller:
    """Remembers the scores of words and labels the words of whole texts."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)), dtype=np.float32)
        self.letters = np.zeros(0, dtype=np.int64)

    def rows_of(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.known)
        if new and len(self.known) + len(new) > WORDS_KEPT:
            self._forget()
            new = set(words)
        if new:
            fresh = list(new)
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            self.table = np.concatenate([self.table, self.model.scores(fresh)])
            letters = [sum(map(str.isalpha, w)) for w in fresh]
            self.letters = np.concatenate([self.letters, np.array(letters, dtype=np.int64)])
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))

    def label(self, texts: list[str], penalty: float):
        """Words of each text, labels of all words, letters of each language by text."""
        split = [WORD.findall(text) for text in texts]
        sizes = np.array([len(words) for words in split], dtype=np.int64)
        rows = self.rows_of(list(chain.from_iterable(split)))
        starts = np.cumsum(sizes) - sizes
        labels = best_path(self.table[rows], starts, sizes, penalty)
        languages = len(self.model.languages)
        owner = np.repeat(np.arange(len(texts)), sizes)
        letters = np.bincount(
            owner * languages + labels, self.letters[rows], minlength=len(texts) * languages
        ).reshape(len(texts), languages)
        return sizes, labels, letters


def text_blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[np.ndarray]:
    """Numbers of the texts, longest first, in blocks of about ``most`` characters."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-lengths, kind="stable")
    block = (np.cumsum(lengths[order]) - lengths[order]) // most
    return iter(np.split(order, np.flatnonzero(np.diff(block)) + 1))


def _spans(text: str, labels: np.ndarray, names: list[str]) -> list[tuple[str, int, int]]:
    spans: list[tuple[str, int, int]] = []
    for match, label in zip(WORD.finditer(text), labels.tolist(), strict=True):
        if spans and spans[-1][0] == names[label]:
            spans[-1] = (names[label], spans[-1][1], match.end())
        else:
            spans.append((names[label], *match.span()))
    return spans


def identify(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    penalty: float = SWITCH_PENALTY,
    with_spans: bool = False,
) -> Column:
    """A struct column (lang, score, spans) for the rows of ``docs``.

    ``spans`` lists (lang, start, end) in code points, and is there with
    ``with_spans`` alone.
    """
    spark = docs.sparkSession
    small_batches(spark, BATCH)
    shared = spark.sparkContext.broadcast(model)
    key = ("labeller", model.digest())
    kinds = "lang string, score double"
    if with_spans:
        kinds += ", langs array<string>, starts array<int>, ends array<int>"

    def judge(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        names = model.languages
        plain = [t or "" for t in texts]
        lang = np.full(len(plain), UNKNOWN, dtype=object)
        score = np.zeros(len(plain))
        spans: list[list[tuple[str, int, int]]] = [[] for _ in plain]
        for block in text_blocks(plain) if names and plain else ():
            own = [plain[k] for k in block]
            labeller = remembered(key, lambda: Labeller(model))
            sizes, labels, letters = labeller.label(own, penalty)
            all_letters = letters.sum(axis=1)
            best = letters.argmax(axis=1)
            top = letters[np.arange(len(own)), best]
            score[block] = np.where(all_letters > 0, top / np.maximum(all_letters, 1), 0.0)
            lang[block] = [names[b] if n else UNKNOWN for b, n in zip(best, all_letters, strict=True)]
            ends = np.cumsum(sizes)
            for k, n, end in zip(block, sizes, ends, strict=True) if with_spans else ():
                spans[k] = _spans(plain[k], labels[end - n : end], names)
        out = {"lang": lang, "score": score}
        if with_spans:
            columns = enumerate(("langs", "starts", "ends"))
            out |= {c: [[s[k] for s in one] for one in spans] for k, c in columns}
        return pd.DataFrame(out)

    return F.pandas_udf(judge, kinds)(F.col(text_col))
