"""Token counts with a whole-token shortcut for a sentencepiece BPE model.

Sentencepiece turns blanks into a mark before each word, and merges pieces only into strings of
its vocabulary. Where no vocabulary string spans a boundary, the text can be cut there and the
parts counted alone. ``Splits`` proves this for two boundaries: before a run of blanks, and
around a line feed. ``whole_words`` then proves which vocabulary strings encode to themselves, one
token, so that pre-tokens equal to them count one without merging. Everything else is merged by the
library and remembered.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from wearline.llm.shared import limit_batches

MARK = "▁"
CACHED = 200_000
LONGEST = 64
_RUNS = re.compile(r" +[^ ]*|[^ ]+")


class PieceCounter:
    """Counts tokens as the model's ``encode`` would give them, without begin or end tokens."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        normal = [
            (i, p)
            for i, p in enumerate(pieces)
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))
        ]
        self.splits = self._splits_proven([p for _, p in normal])
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.feed = self.model.encode("\n")[-1]
        self.whole = self._whole_words(normal) if self.splits else {}
        self.word_cache = dict(self.whole)
        self.start_cache: dict[str, int] = {}

    def _splits_proven(self, pieces: list[str]) -> bool:
        """No piece has a blank after another character or a line feed beside any character.

        The blank's mark must also be put before the text and nothing else be rewritten.
        """
        inner = any(MARK in p.lstrip(MARK) for p in pieces)
        feeds = any("\n" in p and len(p) > 1 for p in pieces)
        probe = "é  é  ﬁx\n "
        same = self.model.decode(self.model.encode(probe)) == probe
        return not inner and not feeds and same

    def _whole_words(self, pieces: list[tuple[int, str]]) -> dict[str, int]:
        words = [(i, p[1:]) for i, p in pieces if len(p) > 1 and p[0] == MARK and MARK not in p[1:]]
        encoded = self.model.encode([w for _, w in words], num_threads=1)
        return {w: 1 for (i, w), ids in zip(words, encoded) if ids == [i]}

    def _encoded(self, words: list[str], joint: str) -> list[int]:
        """Tokens of each word after ``joint``, a blank or a line feed, from one encoding of all.

        With blanks a word's first token, and no other, starts with the mark. With line feeds
        each word follows the token of its feed, which is not counted.
        """
        text = " ".join(words) if joint == " " else joint + joint.join(words)
        ids = np.array(self.model.encode(text), np.int64)
        firsts = np.flatnonzero(self.marked[ids] if joint == " " else ids == self.feed)
        ends = np.append(firsts[1:], len(ids))
        return (ends - firsts - (joint != " ")).tolist()

    def _sum(self, cache: dict[str, int], words: list[str], joint: str) -> int:
        try:
            return sum([cache[w] for w in words])
        except KeyError:
            distinct = set(words)
            missing = [w for w in distinct if w not in cache]
            blank = [w for w in missing if " " in w]  # longer runs of blanks; encoded one by one
            plain = [w for w in missing if " " not in w]
            found = dict(zip(plain, self._encoded(plain, joint) if plain else []))
            found.update(zip(blank, map(len, self.model.encode(blank, num_threads=1))))
            known = {w: cache[w] for w in distinct if w not in found}
            if len(cache) > CACHED:
                cache.clear()
                cache.update(self.whole if joint == " " else {})
            cache.update((w, n) for w, n in found.items() if len(w) <= LONGEST)
            known.update(found)
            return sum([known[w] for w in words])

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.model.encode(text))
        text = text.replace(MARK, " ")
        lines = text.split("\n")
        words: list[str] = []  # each with one blank before it
        starts: list[str] = []  # at the start of a line, without a blank
        total = len(lines) - 1
        for k, line in enumerate(lines):
            if not k:
                line = " " + line
            if "  " in line or line[-1:] == " ":
                for run in _RUNS.findall(line):
                    if run == " ":
                        total += 1
                    elif run[0] == " ":
                        words.append(run[1:])
                    else:
                        starts.append(run)
            elif line:
                first, *rest = line.split(" ")
                words += rest
                if first:
                    starts.append(first)
        return total + self._sum(self.word_cache, words, " ") + self._sum(self.start_cache, starts, "\n")


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """One counter per model and Python worker."""
    return PieceCounter(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of ``text`` in the sentencepiece model at ``path``; null counts as empty, 0."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = counter(path)
        for batch in batches:
            yield pa.array([model.count(x.as_py() or "") for x in batch], pa.int64())

    return F.arrow_udf(count, LongType())(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` added.

    Null and empty texts have 0 bytes and tokens. Columns of these names are replaced. Repeated rows
    count alike, an empty table stays empty, and very long texts are counted whole.
    """
    limit_batches(docs.sparkSession)
    source = F.col(f"`{text}`")
    counted = docs.withColumns(
        {
            "n_bytes": F.octet_length(F.coalesce(source, F.lit(""))).cast("long"),
            "n_tokens": token_count(source, path),
        }
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
