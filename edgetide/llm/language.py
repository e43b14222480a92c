"""Language of a text by its words, and by shorter and shorter character n-grams for unseen ones.

Training counts words and character n-grams per language on a bounded sample of labelled
rows (``SAMPLE`` rows expected, chosen by the hash of doc_id) and keeps the most frequent
(``WORDS`` per language, ``GRAMS`` per language and length).  A text's score is the sum of its
words' log frequencies; a word that is not known counts by its longest known n-grams, padded
with a blank at both ends.  The score of the answer is its share among the languages.

The model is sorted hashes of units with the languages each was seen in, so its size follows the
units, not units times languages.

Null texts, empty ones and texts without a letter (numerals are none) are ``und`` with score 0; so is every
text where nothing was learned.  Repeated rows are counted, and answered, each by itself; an empty table gives
no rows.  Very long texts are read whole.  Of equal scores the language first by code point wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from edgetide.llm import flow
from edgetide.llm.flow import Tables

SAMPLE = 20_000
WORDS = 20_000
GRAMS = 4_000
LENGTHS = (5, 4, 3, 2, 1)
#: A word: a run of letters and their marks, the same for training and prediction.
WORD = r"[\p{L}\p{M}]+"
WORDS_OF, LETTER = regex.compile(WORD), regex.compile(r"\p{L}")
#: A word that is known tells more than one made up of n-grams; n-grams count by length.
WEIGHT = {5: 0.8, 4: 0.6, 3: 0.4, 2: 0.25, 1: 0.1}
MEMO = 200_000         # words a task remembers the scores of, in at most so many bytes
MEMO_BYTES = 64 << 20
SMOOTH = 0.1


def _counted(rows: DataFrame, unit: str, most: int) -> list:
    """The ``most`` frequent units per language and length, of the whole training sample."""
    by = Window.partitionBy("lang", F.length(unit) if unit == "gram" else F.lit(0)).orderBy(F.desc("n"), unit)
    # each task keeps its own first ``most`` before the shuffle, so a language of any size is a
    # few rows of each task
    with flow.settings(rows.sparkSession, {"spark.sql.optimizer.windowGroupLimitThreshold": str(most + 1)}):
        return rows.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most) \
            .select("lang", unit, "n").collect()


def train(docs: DataFrame, held_out) -> dict:
    """{"langs", "words", "grams"}: log frequencies per language, bounded in size."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    usable = docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = usable.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    words = sample.select("lang", F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit(WORD), F.lit(0))).alias("word")) \
        .groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = tables.stage(words, "words")
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    grams = None
    for size in LENGTHS:
        part = words.select("lang", "n", F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - size + 1)),
            lambda i: F.substring(padded, i, F.lit(size)))).alias("gram")) \
            .filter(F.length("gram") == size).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        grams = part if grams is None else grams.union(part)
    totals = {r[0]: r[1] for r in words.groupBy("lang").agg(F.sum("n")).collect()}
    langs = sorted(totals)
    size = np.array([totals[x] for x in langs], float)
    model = {"langs": langs, "rare": np.log(SMOOTH / (size + 1)),
             "words": Units.of(_counted(words, "word", WORDS), langs),
             "grams": Units.of(_counted(grams, "gram", GRAMS), langs)}
    tables.drop(words)
    return model


class Units:
    """Words or n-grams, each with the languages it was seen in: sorted hashes and flat arrays.

    ``gains`` are what a unit's count in a language adds to the log frequency of an unseen one.
    """

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, langs: np.ndarray, gains: np.ndarray):
        self.hashes, self.starts, self.langs, self.gains = hashes, starts, langs, gains

    @classmethod
    def of(cls, counted: list, langs: list[str]) -> Units:
        place = {x: k for k, x in enumerate(langs)}
        rows = np.array([(xxhash.xxh64_intdigest(unit), place[lang], n) for lang, unit, n in counted],
                        dtype=[("h", np.uint64), ("l", np.int32), ("n", np.int64)])
        rows.sort(order=["h", "l"])
        hashes, starts = np.unique(rows["h"], return_index=True)
        return cls(hashes, np.append(starts, len(rows)), rows["l"], np.log((rows["n"] + SMOOTH) / SMOOTH))

    def find(self, units: list[str]) -> np.ndarray:
        """Place of each unit, -1 for an unknown one."""
        if not len(self.hashes) or not units:
            return np.full(len(units), -1)
        h = np.array(list(map(xxhash.xxh64_intdigest, units)), np.uint64)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[k] == h, k, -1)

    def gather(self, places: np.ndarray, owners: np.ndarray, out: np.ndarray) -> None:
        """Add the gains of each place to its owner's row."""
        count = self.starts[places + 1] - self.starts[places]
        first = np.cumsum(count) - count
        at = np.repeat(self.starts[places] - first, count) + np.arange(count.sum())
        np.add.at(out, (np.repeat(owners, count), self.langs[at]), self.gains[at])


def word_scores(model: dict, words: list[str]) -> np.ndarray:
    """A row per word: its log frequency by language, or that of its longest known n-grams.

    Rows are centred, as only differences between languages matter; a word of which nothing is known has
    zeros.
    """
    rare = model["rare"] - model["rare"].mean() if len(model["langs"]) else model["rare"]
    out = np.zeros((len(words), max(1, len(model["langs"]))))
    places = model["words"].find(words)
    known = np.flatnonzero(places >= 0)
    model["words"].gather(places[known], known, out)
    out[known] += rare
    left = np.flatnonzero(places < 0)
    for size in LENGTHS:
        padded = [f" {words[k]} " for k in left]
        count = np.array([max(0, len(p) - size + 1) for p in padded], np.int64)
        places = model["grams"].find([p[i:i + size] for p in padded for i in range(len(p) - size + 1)])
        owners = np.repeat(left, count)[places >= 0]
        model["grams"].gather(places[places >= 0], owners, out)
        hits = np.bincount(owners, minlength=len(words))[left]
        done = left[hits > 0]
        out[done] = WEIGHT[size] * (rare + out[done] / hits[hits > 0][:, None])
        left = left[hits == 0]
    return out - out.mean(axis=1, keepdims=True)


class Memo:
    """Scores of the words a task has met, up to a limit."""

    def __init__(self, model: dict):
        self.model, self.place = model, {}
        width = max(1, len(model["langs"]))
        self.limit = max(1024, min(MEMO, MEMO_BYTES // (8 * width)))
        self.scores = np.zeros((self.limit, width))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > len(self.scores):
            self.place.clear()
            new = list(words)
            # one text may hold more words than the limit
            self.scores = np.zeros((max(self.limit, len(new)), self.scores.shape[1]))
        first = len(self.place)
        self.scores[first:first + len(new)] = word_scores(self.model, new)
        self.place.update(zip(new, range(first, first + len(new))))


def _predict(model, keep: list[str], added: tuple[str, str]) -> Callable:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, memo = model.value["langs"], Memo(model.value)
        for batch in rows:
            names, scores = [], []
            held: list[list[str]] = []
            fresh: set[str] = set()

            def answer() -> None:
                memo.learn(fresh)
                place, table = memo.place, memo.scores
                for words in held:
                    if not words or not langs:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    total = table[[place[w] for w in words]].sum(axis=0)
                    best = int(np.argmax(total))
                    names.append(langs[best])
                    scores.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
                held.clear()
                fresh.clear()

            for text in batch["text"].to_pylist():
                held.append(WORDS_OF.findall(text.lower()) if text and LETTER.search(text) else [])
                fresh.update(held[-1])
                if len(fresh) > memo.limit // 2:
                    answer()
            answer()
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*keep, *added])
    return run


def identify(docs: DataFrame, model: dict, keep: list[str], added: tuple[str, str] = ("lang_pred", "score")
             ) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the language and its score, named ``added``; no shuffle."""
    schema = StructType([*(docs.schema[c] for c in keep), StructField(added[0], StringType()),
                         StructField(added[1], DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_predict(held, keep, added), schema)
