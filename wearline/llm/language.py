"""Language identification by rank-order profiles of n-grams.

A profile lists the most frequent n-grams of a language by rank. A document's own list is compared
to each profile: every n-gram adds how far it is out of place, or the full length if the profile
lacks it. The nearest profile names the language.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from wearline.llm.shared import limit_batches, wrap

UNDETERMINED = "und"
GRAMS = 300  # length of profiles
PER_LANGUAGE = 1500  # training documents of a language, about
LANGUAGES = 256  # most frequent languages learned
_BLANK = 32


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of one to three characters in lower case; runs of other characters are a blank.

    An n-gram is a number with 21 bits per character, so that lengths never mix.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter stands for its run
    kept = np.where(letter, codes, _BLANK)[keep]
    chain = np.concatenate([[_BLANK], kept, [_BLANK] if letter[-1] else []]).astype(np.int64)
    pairs = chain[:-1] << 21 | chain[1:]
    triples = pairs[:-1] << 21 | chain[2:]
    return np.unique(np.concatenate([chain[chain != _BLANK], pairs, triples]), return_counts=True)


def top(found: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` most frequent n-grams, ties by number."""
    return found[np.argsort(-counts, kind="stable")[:length]]


@dataclass
class Profiles:
    languages: list[str]
    grams: np.ndarray  # all profiles' n-grams, ascending
    ranks: np.ndarray  # rank by n-gram and language; ``length`` where a profile lacks it
    length: int

    def predict(self, text: str | None) -> tuple[str, float]:
        found, counts = grams(text or "")
        if not len(found) or not self.languages:
            return UNDETERMINED, 0.0
        best = top(found, counts, self.length)
        at = np.searchsorted(self.grams, best)
        at[at == len(self.grams)] = 0
        ranks = np.where((self.grams[at] == best)[:, None], self.ranks[at], self.length)
        away = np.abs(ranks - np.arange(len(best))[:, None])
        away[ranks == self.length] = self.length
        distance = away.sum(0)
        nearest = int(distance.argmin())  # languages are in order: ties go to the first
        return self.languages[nearest], float(1 - distance[nearest] / (self.length * len(best)))


def training_rows(docs: DataFrame, per_language: int, languages: int) -> DataFrame:
    """(lang, text): about ``per_language`` documents of each of the most frequent languages.

    Documents are chosen by a hash of doc_id and language, so the sample is the same in each run.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    scale = 1 << 30
    shares = counts.select(
        F.col("lang").alias("of"),
        (F.least(F.lit(1.0), per_language / F.col("count")) * scale).cast("long").alias("below"),
    )
    place = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(scale))
    # At most ``languages`` rows are broadcast.
    joined = known.join(F.broadcast(shares), F.col("lang") == F.col("of"))
    return joined.where(place < F.col("below")).select("lang", "text")


def learn(
    docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, length: int = GRAMS
) -> Profiles:
    """Profiles from ``docs`` (doc_id, text, lang), counted in Spark on a sample bounded by the parameters."""
    limit_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").to_pylist()
            by_lang: dict[str, list] = {}
            for name, text in zip(names, batch.column("text")):
                by_lang.setdefault(name, []).append(grams(text.as_py()))
            for name, found in by_lang.items():
                each = np.concatenate([g for g, _ in found])
                weights = np.concatenate([c for _, c in found])
                distinct, where = np.unique(each, return_inverse=True)
                summed = np.bincount(where, weights, len(distinct)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(distinct)), pa.array(distinct), pa.array(summed)],
                    ["lang", "gram", "n"],
                )

    sample = training_rows(docs, per_language, languages)
    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counted.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < length)
    rows = ranked.select("lang", "gram", "rank").collect()  # languages x length rows at most
    names = sorted({r["lang"] for r in rows})
    found = np.unique(np.array([r["gram"] for r in rows], np.int64))
    ranks = np.full((len(found), len(names)), length, np.int32)
    for r in rows:
        ranks[np.searchsorted(found, r["gram"]), names.index(r["lang"])] = r["rank"]
    return Profiles(names, found, ranks, length)


RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def language_of(text: Column, profiles: Profiles) -> Column:
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [profiles.predict(x.as_py()) for x in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["lang_pred", "score"],
            )

    return F.arrow_udf(predict, RESULT)(text)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc`` with ``lang_pred`` and ``score``, 1 less the distance's share of the largest possible.

    Null texts, texts without a letter, and any text if nothing was learned, are ``und`` with score 0.
    Texts are read whole; equal distances go to the first language by name. Repeated rows get equal
    results; an empty table gives no rows.
    """
    found = wrap(docs).withColumn("found", language_of(F.col("doc.text"), profiles))
    return found.select("doc", "found.lang_pred", "found.score")
