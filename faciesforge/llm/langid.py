"""Language identification: known words first, shorter and shorter character n-grams for the rest.

The model holds, for each language, log frequencies of words and of character n-grams of
1 to 4 characters (with word edges marked). A word that any language knows is scored by its
log frequency in each language. Any other word backs off: at each of its positions the
longest n-gram that some language knows is scored, at a cost for each step down. A text's
score for a language is the mean over its words; the answer's confidence is the softmax of
those means.

Training reads a bounded sample of the labelled rows (``TRAIN_ROWS`` a language, by a hash
of the id), and the model holds all words and n-grams of that sample; scoring reads whole
texts and every row.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is
everything if no labelled row has a letter; rows with null id are scored, never learnt from,
and not held out; repeated rows and ties are scored alike (ties between languages go to the
first by name); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import bounded_batches, cut, held, table, values

UND = "und"
#: Labelled rows of a language that are learnt from, about.
TRAIN_ROWS = 1_000
NGRAM = 4
#: Cost of a step to shorter n-grams, and of an n-gram that no language knows.
BACKOFF, UNKNOWN = float(np.log(0.4)), -14.0
#: A text whose confidence is below so many times chance (one in the number of languages) is in none of them:
#: the model knows hardly a word or n-gram of it.
ACCEPT = 1.12
#: A text is also in none of them if the model knows less than this part of the share of words that it should know
#: of a new text of that language. The floor rises from none at the first length in words to all of it at the second.
FIT, FIT_WORDS = 0.35, (5, 20)
#: Runs of letters are what Python counts as alphanumeric, without digits and other numbers (as in ``²`` or ``①``).
WORD = re.compile(r"[^\W\d_]+")
NUMBER = re.compile("[" + "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("Nl", "No")) + "]")
#: Words that a worker remembers beside the model's, and texts scored together.
MEMO_WORDS, BATCH = 100_000, 64


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for word in found for part in ([word] if word.isalpha() else NUMBER.split(word)) if part]


def grams(word: str) -> list[str]:
    """For each position of the marked word, its n-grams from there on are prefixes of these."""
    marked = f"<{word}>"
    return [marked[i : i + NGRAM] for i in range(len(marked) - 1)]


@dataclass
class Model:
    languages: list[str]
    words: list[str]
    grams: list[str]
    #: Log frequency in each language, a row for each word and each n-gram.
    word_rows: np.ndarray
    gram_rows: np.ndarray
    #: The share of words of a new text that the model should know, for each language.
    coverage: np.ndarray
    #: Tells models apart in a worker that has met several.
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def model_of(languages: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray], coverage: list[float] | None = None) -> Model:
    """From the log frequencies of each word and n-gram."""
    rows = lambda d: np.stack([*d.values()]) if d else np.empty((0, len(languages)))
    return Model(languages, list(words), list(grams), rows(words), rows(grams), np.array(coverage if coverage is not None else [0.0] * len(languages)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to counts of words (kind 0) and n-grams (kind 1)."""
    held(None, lambda: None)
    for batch in batches:
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
            words[lang].update(words_of(text))
        for lang, found in words.items():
            parts: dict[str, int] = defaultdict(int)
            for word, n in found.items():
                for gram in grams(word):
                    for k in range(1, len(gram) + 1):
                        parts[gram[:k]] += n
            for kind, got in enumerate((found, parts)):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got), pa.string()), pa.array(np.full(len(got), kind, np.int32)), pa.array(got.keys(), pa.string()), pa.array(got.values(), pa.int64())], ["lang", "kind", "item", "n"])


def learn(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on ``labelled(doc_id, text, lang)``; what reaches the driver are the items of a bounded sample."""
    bounded_batches(labelled.sparkSession)
    labelled = labelled.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return model_of([], {}, {})
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, rows / n))) for k, n in sorted(sizes.items())])
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")
    counts = sample.mapInArrow(_counts, "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    counts = cut(counts, "language-counts")
    langs = sorted(sizes)
    place = {lang: i for i, lang in enumerate(langs)}
    tables: list[dict[str, np.ndarray]] = [{}, {}]
    # words that occur once are as frequent as words not met yet (Good and Turing)
    coverage, total = [0.0] * len(langs), Counter()
    for r in counts.filter("kind = 0").groupBy("lang").agg(F.sum("n"), F.count_if(F.col("n") == 1)).collect():
        coverage[place[r[0]]] = 1.0 - r[2] / r[1]
    got = counts.orderBy("kind", "item", "lang").toArrow()  # the items of ``rows`` texts a language
    size = np.where(got["kind"].to_numpy() == 0, 0, pc.utf8_length(got["item"]).to_numpy()).tolist()
    items = list(zip(got["kind"].to_pylist(), size, map(place.__getitem__, got["lang"].to_pylist()), got["item"].to_pylist(), got["n"].to_pylist(), strict=True))
    for _, k, i, _, n in items:  # words are compared with all words, n-grams with those of their length
        total[k, i] += n
    for kind, k, i, item, n in items:
        tables[kind].setdefault(item, np.full(len(langs), np.nan))[i] = np.log(n / total[k, i])
    for known in tables:  # what a language lacks counts as half an occurrence at the rarest frequency
        if known:
            low = np.fmin.reduce(np.stack([*known.values(), np.full(len(langs), np.nan)]))
            low = np.where(np.isnan(low), UNKNOWN, low) - np.log(2)
            for item, x in known.items():
                known[item] = np.where(np.isnan(x), low, x)
    return model_of(langs, *tables, coverage)


class Scorer:
    """Language scores of texts under a model, with a bounded memo of words."""

    def __init__(self, model: Model):
        self.model, n = model, len(model.languages)
        self.known = {w: i for i, w in enumerate(model.words)}
        self.base = model.word_rows
        self.gram = {g: i for i, g in enumerate(model.grams)}
        #: The last row is that of an n-gram that no language knows.
        self.gram_rows = np.concatenate([model.gram_rows, np.full((1, n), UNKNOWN)])
        self.clear()

    def clear(self) -> None:
        self.at, self.rows = dict(self.known), self.base

    def unseen(self, words: list[str]) -> np.ndarray:
        """Backoff scores, a row for each word: the mean over its positions."""
        find, nothing = self.gram.get, len(self.gram)
        places, starts, cost = [], [], []
        for word in words:
            starts.append(len(places))
            down = 0
            for gram in grams(word):
                at = find(gram)
                while at is None and len(gram) > 1:
                    gram, down = gram[:-1], down + 1
                    at = find(gram)
                places.append(nothing if at is None else at)
            cost.append(down * BACKOFF)
        sums = np.add.reduceat(self.gram_rows[places], starts, axis=0) + np.array(cost)[:, None]
        return sums / np.diff([*starts, len(places)])[:, None]

    def places(self, texts: list[str | None]) -> list[np.ndarray]:
        """The rows of each text's words; those below the number of known words are known."""
        if len(self.at) > len(self.known) + MEMO_WORDS:
            self.clear()
        at, split, new = self.at, [words_of(t) if t else [] for t in texts], set()
        for words in split:
            new.update(set(words).difference(at))
        if new:
            found = list(new)
            at.update(zip(found, range(len(self.rows), len(self.rows) + len(found)), strict=True))
            self.rows = np.concatenate([self.rows, self.unseen(found)])
        return [np.fromiter(map(at.__getitem__, words), np.int64, len(words)) for words in split]

    def means(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The mean score of each text's words in each language, or None if it has none."""
        return [self.rows[p].mean(axis=0) if len(p) else None for p in self.places(texts)]

    def answers(self, texts: Iterator[str | None]) -> tuple[list[str], list[float]]:
        """Language and confidence of each text."""
        said, sure, texts = [], [], iter(texts)
        while some := list(islice(texts, BATCH)):
            for x in self.means(some) if self.model.languages else [None] * len(some):
                best = None if x is None else int(x.argmax())
                said.append(UND if best is None else self.model.languages[best])
                sure.append(0.0 if best is None else float(1 / np.exp(x - x[best]).sum()))
        return said, sure

    def accepted(self, texts: Iterator[str | None], floor: float) -> list[bool]:
        """Whether each text is in a learnt language: confidence of ``floor`` or more, and enough known words for its length."""
        out, texts, (none, full) = [], iter(texts), FIT_WORDS
        while some := list(islice(texts, BATCH)):
            for p in self.places(some) if self.model.languages else [()] * len(some):
                if not len(p):
                    out.append(False)
                    continue
                x = self.rows[p].mean(axis=0)
                best = int(x.argmax())
                share = FIT * self.model.coverage[best] * min(1.0, max(0, len(p) - none) / (full - none))
                out.append(bool(1 / np.exp(x - x[best]).sum() >= floor and (p < len(self.known)).mean() >= share))
        return out


def scorer(model: Model) -> Scorer:
    """The worker's scorer for a model that it got by broadcast."""
    return held(("languages", model.name), lambda: Scorer(model))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the items of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, sure = scorer(shared.value).answers(values(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(id_column: str = "doc_id", folds: int = 3):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(fold() != 1)


def accept(docs: DataFrame, model: Model, least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learnt language: with ``least`` times chance or more, and of words that the model knows."""
    floor = min(1.0, least / max(1, len(model.languages)))
    shared, i = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scorer(shared.value).accepted(values(batch.column(i)), floor), pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(training_rows(docs)))
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
