"""Mixture-controlled packing of documents into token sequences.

Every source is a queue of its documents' tokens. Windows are filled by deficit round-robin: in
each window a source is credited its share of the window, serves the whole tokens of its credit,
and carries the rest to the next window. As documents may be cut anywhere, a queue's deficit is
at any time less than one token, so what it has served after ``w`` windows is the floor of ``w``
credits, in every partition. That turns the rounds into joins: a document's place in its queue gives
its windows, and the windows laid end to end are cut into sequences without gaps.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wearline.llm.shared import limit_batches
from wearline.session import broadcast_if_small, materialize

# Target shares by source, or to be repeated over the sources.
Weights = Mapping[str, float] | Sequence[float] | None

CACHED = 250_000
LONGEST = 40
ROWS_PER_BUCKET = 20_000
# White space to Python but not surely to the tokenizer; texts with it are encoded whole.
_ODD = "\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


class WordEncoder:
    """Ids as the tokenizer's ``encode`` gives them, remembered by white-space separated chunks.

    The tokenizer drops white space, lower-cases, cuts chunks into words and never merges across
    words, so chunks and words are encoded alone. The merges are used directly for words of
    Latin letters, single digits and ASCII signs. Other chunks go to the library, and so do whole
    texts with a special token's string or with white space that libraries see differently.
    """

    pattern = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A chunk enters ``fresh`` first and stays in ``known`` once it comes again, so that words
        # seen once do not drive out the others.
        self.known: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        # Byte-level models name every byte by a printable character.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.names = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    @staticmethod
    def _simple(chunk: str) -> bool:
        """Printable ASCII and Latin letters, whose case and class are the same everywhere."""
        if chunk.isascii():
            return chunk.isprintable()
        return chunk.isprintable() and all(c < "\x7f" or c < "\u0250" and c.isalpha() for c in chunk)

    def _merged(self, word: str) -> bytes:
        named = word if word.isascii() else "".join([self.names[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(named)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        found = self.known.get(chunk)
        if found is not None:
            return found
        found = self.fresh.get(chunk)
        if found is not None:
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[chunk] = found
            return found
        if self._simple(chunk):
            words = self.pattern.findall(chunk.lower())
            found = self._merged(chunk) if words == [chunk] else b"".join(map(self._chunk, words))
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            found = array("I", ids).tobytes()
        if len(chunk) <= LONGEST:
            if len(self.fresh) >= CACHED:
                self.fresh.clear()
            self.fresh[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as native 32-bit numbers, little-endian on the machines Spark runs on."""
        if any(c in text for c in _ODD) or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        chunks = text.split()
        parts = list(map(self.known.get, chunks))
        if None in parts:
            one = self._chunk
            parts = [one(c) if p is None else p for c, p in zip(chunks, parts)]
        return b"".join(parts)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """``row_key, doc_id, source, n_tokens, ids`` per row, the id ``end`` last; written once."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            found = [words.encode(t.as_py() or "") + last for t in batch.column("text")]
            sizes = [len(f) // 4 for f in found]
            # Two bytes an id are enough for vocabularies below 65,536.
            small = [f if np.frombuffer(f, "<u4").max() > 65535 else np.frombuffer(f, "<u4").astype("<u2").tobytes() for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("source"),
                    pa.array(sizes, pa.int64()),
                    pa.array(small, pa.binary()),
                ],
                ["doc_id", "source", "n_tokens", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(
        run, "doc_id long, source string, n_tokens long, ids binary"
    )
    return materialize(rows.withColumn("row_key", F.monotonically_increasing_id()), compression="zstd")


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _before(frame: DataFrame, groups: list[str], bucket: str, order: list[str], value: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over rows ahead in the group, by bucket, then order.

    Bucket totals are summed first, so that no window holds more than one bucket or one row per bucket.
    """
    totals = frame.groupBy(*groups, bucket).agg(F.sum(value).alias("sum"))
    ahead = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(g).alias(f"of_{g}") for g in [*groups, bucket]],
        F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"),
    )
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    frame = frame.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    condition = _same(bucket, f"of_{bucket}")
    for g in groups:
        condition = condition & _same(g, f"of_{g}")
    joined = frame.join(totals, condition).withColumn("before", F.col("ahead") + F.col("inside"))
    return joined.drop("ahead", "inside", *[f"of_{g}" for g in [*groups, bucket]])


def _served(window: Column) -> Column:
    """Tokens of a queue served before ``window``: whole tokens of its credits, at most its total."""
    return F.least(F.col("total"), F.floor(window * F.col("credit")))


def _weight(weights: Weights) -> Column:
    """The target share of a row of the queues (source, total)."""
    if weights is None or isinstance(weights, Mapping):
        weight = F.col("total").cast("double")
        for name, value in (weights or {}).items():
            weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
        return weight
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights) + 1)


def layout(rows: DataFrame, length: int, window: int, weights: Weights = None) -> DataFrame:
    """Where the tokens of each row go: ``row_key, start, length, sequence_id, offset`` per piece.

    ``rows`` has row_key, source and n_tokens. ``weights`` are target shares: by source, or a
    sequence that repeats over the sources by code point, null last. None, and sources without a
    weight, take a source's own tokens, so that all queues end together. Queues that end earlier
    leave their part of later windows out; what follows moves up, so that the others keep their
    shares among themselves.
    """
    given = weights.values() if isinstance(weights, Mapping) else weights
    if given is not None and not all(w > 0 for w in given):
        raise ValueError("target shares are above 0")
    # One row per source.
    queues = rows.groupBy("source").agg(F.sum("n_tokens").alias("total")).withColumn("weight", _weight(weights))
    credit = window * F.col("weight") / F.sum("weight").over(Window.partitionBy())
    queues = materialize(queues.select(F.col("source").alias("queue"), "total", credit.alias("credit")))
    count = rows.count()
    buckets = max(16, -(-count // ROWS_PER_BUCKET))
    dealt = rows.withColumn("mixed", F.xxhash64("row_key"))
    dealt = dealt.withColumn("bucket", F.pmod("mixed", F.lit(buckets)))
    placed = _before(dealt, ["source"], "bucket", ["mixed", "row_key"], "n_tokens")
    placed = placed.join(broadcast_if_small(queues), _same("source", "queue")).drop("queue")
    at, to = F.col("before"), F.col("before") + F.col("n_tokens")

    def window_of(token: Column) -> Column:
        """The window that serves the queue's token of this number (from 0)."""
        near = F.ceil((token + 1) / F.col("credit")) - 1
        return near - (_served(near) > token).cast("long") + (_served(near + 1) <= token).cast("long")

    # A queue with less than one token a window has a window for each token, and many without.
    windows = F.when(
        F.col("credit") >= 1, F.sequence(window_of(at), window_of(to - 1))
    ).otherwise(F.array_distinct(F.transform(F.sequence(at, to - 1), window_of)))
    pieces = placed.withColumn("window", F.explode(windows))
    pieces = pieces.select(
        "row_key",
        "source",
        "window",
        "before",
        F.greatest(at, _served(F.col("window"))).alias("from"),
        F.least(to, _served(F.col("window") + 1)).alias("to"),
    ).where(F.col("from") < F.col("to"))
    pieces = pieces.select(
        "row_key",
        "source",
        "window",
        (F.col("from") - F.col("before")).alias("start"),
        "from",
        (F.col("to") - F.col("from")).alias("size"),
    )
    pieces = materialize(pieces)
    windows = pieces.groupBy("window").agg(F.sum("size").alias("filled"))
    windows = windows.withColumn("block", F.floor(F.col("window") / 4096))
    bases = _before(windows, [], "block", ["window"], "filled").select(
        F.col("window").alias("of"), F.col("before").alias("base")
    )
    # A window holds at most ``window`` tokens and a few more, hence no more pieces.
    inside = Window.partitionBy("window").orderBy("source", "from").rowsBetween(Window.unboundedPreceding, -1)
    ordered = pieces.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ordered = ordered.join(bases, F.col("window") == F.col("of"))
    ordered = ordered.withColumn("position", F.col("base") + F.col("inside"))
    first, last = F.col("position"), F.col("position") + F.col("size")
    parts = ordered.withColumn(
        "sequence_id",
        F.explode(F.sequence(F.floor(first / length), F.floor((last - 1) / length))),
    )
    begin = F.greatest(first, F.col("sequence_id") * length)
    stop = F.least(last, (F.col("sequence_id") + 1) * length)
    return parts.select(
        "row_key",
        (F.col("start") + begin - first).alias("start"),
        (stop - begin).alias("length"),
        "sequence_id",
        (begin - F.col("sequence_id") * length).alias("offset"),
    )


def pack(
    docs: DataFrame,
    path: str,
    length: int = 4096,
    end: int = 2,
    per_window: int = 16,
    weights: Weights = None,
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens.

    Returns ``doc_id, source, start, length, ids, doc_tokens, sequence_id, offset``; ``ids`` are the
    piece's token ids, each document's last being ``end``. Only the last sequence can be shorter
    than ``length``. A window is ``per_window`` sequences, the stretch in which the sources meet
    their shares. Null texts count as empty and hold ``end`` alone. Every row is packed, repeated
    rows too, whatever its doc_id; a null source is a source. An empty table gives no rows.
    """
    limit_batches(docs.sparkSession)
    rows = encoded(docs, path, end)
    parts = layout(rows.select("row_key", "source", "n_tokens"), length, length * per_window, weights)
    per_row = parts.groupBy("row_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["start", "length", "sequence_id", "offset"]
            found: dict[str, list] = {n: [] for n in [*names, "row", "ids", "ids_crc32"]}
            sizes = batch.column("n_tokens").to_pylist()
            for row, (ids, parts) in enumerate(zip(batch.column("ids"), batch.column("parts").to_pylist())):
                raw = np.frombuffer(ids.as_buffer(), "<u2" if len(ids.as_buffer()) == 2 * sizes[row] else "<u4")
                for part in parts:
                    piece = raw[part["start"] : part["start"] + part["length"]].astype("<u4")
                    for n in names:
                        found[n].append(part[n])
                    found["row"].append(row)
                    found["ids"].append(piece)
                    found["ids_crc32"].append(zlib.crc32(piece.tobytes()))
            at = pa.array(found["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at),
                    batch.column("source").take(at),
                    *[pa.array(found[n], pa.int64()) for n in names],
                    pa.array([x.view("<i4") for x in found["ids"]], pa.list_(pa.int32())),
                    pa.array(found["ids_crc32"], pa.int64()),
                    batch.column("n_tokens").take(at),
                ],
                ["doc_id", "source", *names, "ids", "ids_crc32", "doc_tokens"],
            )

    joined = rows.join(per_row.withColumnRenamed("row_key", "of"), F.col("row_key") == F.col("of"))
    return joined.select("doc_id", "source", "n_tokens", "ids", "parts").mapInArrow(
        run,
        "doc_id long, source string, start long, length long, sequence_id long, offset long,"
        " ids array<int>, ids_crc32 long, doc_tokens long",
    )
