"""Fuzzy line dedup by edit similarity in words, on candidates that share rare runs of three words.

Lines are normalised to words. Equal lines are one item. Of ``k + 1`` runs of words that don't overlap,
``k`` edits leave one as it is. So two lines with at most ``k`` edits share one of each line's first runs, in any
order of all runs, if these hold ``k + 1`` that don't overlap. Runs that begin with rare words come first in
that order, which makes small buckets and leaves no pair out. Rules that are too loose for runs take rare words
in the same way: lines share ``t`` of each line's first ``k + t`` words. Candidates are confirmed
by their edit similarity on 64-bit word hashes, and one occurrence per connected group of lines
stays: the first by doc_id and position.

A rule ``within_bits`` also wants SimHashes of at most ``bits`` differing bits. Such lines agree on at
least two of ``bits + 2`` blocks, so they share the bucket of one pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType

from wearline.llm.linking import link
from wearline.llm.shared import limit_batches, wrap
from wearline.llm.texts import mix, text_bytes, words_of
from wearline.session import broadcast_if_small, discard, materialize

# Digits count as one digit and ASCII punctuation as a blank, so that numbering does not tell lines apart.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[48:58] = 48
BETWEEN = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
FEED = 10
CHUNK_WORDS = 1 << 14
# Words are ordered by how often their hash, cut to this many values, occurs.
ORDER_SLOTS = 1 << 18
PARITY_BITS = 48
LONGEST_MARK = (1 << 15) - 1
# Longs of the word parity of lines that shorter marks have left open.
WIDE = 8
# Lines in single-word buckets share one word more for each so many of their words.
WORDS_PER_SHARED = 100
LONGEST_RUN = 3
# Text worked on at a time; bounds the temporary arrays.
PART_BYTES = 1 << 20


@dataclass(frozen=True)
class FuzzyLines:
    """Lines of fewer than ``min_words`` words are left alone."""

    min_words: int = 1
    bits: int = 3
    percent: int = 90
    within_bits: bool = True

    def __post_init__(self):
        if not 50 < self.percent <= 100:
            raise ValueError("percent is above 50 and at most 100")

    @property
    def away(self) -> int:
        return 100 - self.percent

    def length_of(self, edits: int) -> int:
        """Words from which on a line may differ in so many edits."""
        return -(-100 * edits // self.away)

    def edits_of(self, words):
        """How many edits a line of so many words may have to one that is not shorter."""
        return 100 * words // self.percent * self.away // 100

    def run_length(self) -> int:
        """Words of a run, so that every line that may be edited has enough runs; 1 if only single words are enough.

        A run overlaps ``2 * run - 1`` runs at most, itself included.
        """
        for run in range(LONGEST_RUN, 1, -1):
            spare = self.percent - (2 * run - 1) * self.away
            if self.away and spare > 0:
                short = range(1, run * self.percent // spare + 1)
                if all((2 * run - 1) * self.edits_of(n) < n - run + 1 for n in short if self.edits_of(n)):
                    return run
        return 1

    def blocks(self) -> list[tuple[int, int]]:
        """(shift, width) of the blocks that cut 64 bits."""
        n = self.bits + 2
        edges = [64 * i // n for i in range(n + 1)]
        return [(a, b - a) for a, b in zip(edges, edges[1:])]


# Edit similarity alone decides.
DEFAULT = FuzzyLines(within_bits=False)


@dataclass
class Lines:
    """Lines in order: the text each is in, its number there, and its words."""

    text: np.ndarray
    place: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray


def lines_of(column: pa.Array) -> Lines:
    data, offsets = text_bytes(pc.utf8_lower(column))
    feeds = np.flatnonzero(data == FEED) + 1
    # A feed starts a line of its text, also at the very end; texts start lines, empty ones too.
    owner = np.searchsorted(offsets[1:], feeds, side="left")
    text = np.concatenate([np.arange(len(offsets) - 1), owner])
    start = np.concatenate([offsets[:-1], feeds])
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    place = np.arange(len(text)) - np.searchsorted(text, text)
    edges = np.append(start, len(data))
    words = words_of(PLAIN[data], np.unique(edges), BETWEEN)
    return Lines(text, place, np.searchsorted(words.starts, edges), words.hashes)


def simhash(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 majority bits of the hashes of each run of words."""
    out = np.zeros((len(begin), 64), np.int64)
    total = np.cumsum(size)
    at = 0
    while at < len(begin):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + CHUNK_WORDS)))
        for k in range(at, to) if size[at] > CHUNK_WORDS else ():
            for piece in range(0, size[k], CHUNK_WORDS):
                part = hashes[begin[k] + piece : begin[k] + min(piece + CHUNK_WORDS, size[k])]
                out[k] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        if size[at] <= CHUNK_WORDS:
            first = np.cumsum(size[at:to]) - size[at:to]
            taken = np.repeat(begin[at:to] - first, size[at:to]) + np.arange(int(size[at:to].sum()))
            bits = np.unpackbits(hashes[taken].view(np.uint8).reshape(-1, 8), axis=1)
            out[at:to] = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        at = to
    return np.packbits(2 * out > size[:, None], axis=1).view(np.int64).ravel()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a bounded size of text each, or of one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(upto):
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + PART_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def word_order(docs: DataFrame) -> np.ndarray:
    """How often each slot of word hashes occurs in all lines; of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_SLOTS, np.int64)
        for part in (part for batch in batches for part in _parts(batch)):
            slots = lines_of(part.column("text")).hashes % np.uint64(ORDER_SLOTS)
            total += np.bincount(slots.astype(np.int64), minlength=ORDER_SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    counted = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    out = np.zeros(ORDER_SLOTS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def parity(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A line's length, and for each of 48 groups of words whether it has an odd number of them.

    Replacing a word changes at most two of the bits, adding or removing one changes one.
    """
    bit = np.uint64(1) << (mix(words, 33) % np.uint64(PARITY_BITS))
    length = np.minimum(size, LONGEST_MARK).astype(np.uint64) << np.uint64(PARITY_BITS)
    return (np.bitwise_xor.reduceat(bit, first) | length).view(np.int64)


def rare_keys(words: np.ndarray, first: np.ndarray, size: np.ndarray, order: np.ndarray, rule: FuzzyLines) -> pa.Array:
    """Per line the buckets that it shares with every line of enough edit similarity.

    A word's second and further occurrences in a line count as other words. If the longer of two
    lines may have two edits at most, the buckets are pairs of words, else single words, of which two
    lines share as many as ``_least_shared`` says; lines of lengths that can be in both cases have both.
    """
    kind = pa.list_(pa.int64())
    if not rule.away:
        return pa.array([[]] * len(size), kind)
    own = np.repeat(np.arange(len(size)), size)
    by = np.lexsort((words, order[(words % np.uint64(ORDER_SLOTS)).astype(np.int64)], own))
    words = words[by]
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (own[1:] == own[:-1])
    at = np.arange(len(words))
    number = at - np.maximum.accumulate(np.where(again, 0, at))
    words = mix(words + mix(number.astype(np.uint64), 34), 34)
    edits = size * rule.away // 100
    three = rule.length_of(3)
    lines, keys = [], []
    single = np.flatnonzero(size >= three - 3)
    more = np.where(size[single] >= three, 2 + size[single] // WORDS_PER_SHARED, 1)
    taken = np.minimum(edits[single] + more, size[single])
    lines.append(np.repeat(single, taken))
    place = np.arange(int(taken.sum())) - np.repeat(np.cumsum(taken) - taken, taken)
    keys.append(mix(words[np.repeat(first[single], taken) + place], 31))
    # The shorter line may have one word less than the shortest line with an edit.
    paired = np.flatnonzero((size >= max(2, rule.length_of(1) - 1)) & (size < three))
    for i, j in combinations(range(4), 2):
        now = paired[(j < edits[paired] + 2) & (j < size[paired])]
        lines.append(now)
        keys.append(mix(words[first[now] + i] + mix(words[first[now] + j], 32), 32))
    lines, keys = np.concatenate(lines), np.concatenate(keys)
    by = np.argsort(lines, kind="stable")
    ends = np.searchsorted(lines[by], np.arange(len(size) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[by].view(np.int64)))


def run_keys(words: np.ndarray, first: np.ndarray, size: np.ndarray, order: np.ndarray, rule: FuzzyLines) -> pa.Array:
    """Per line the buckets, each once, of which it shares one with every line of enough edit similarity.

    A line's runs are taken from the rarest first word on until so many of them don't overlap that edits can't
    change all. Runs of one place in the order are one bucket.
    """
    run = rule.run_length()
    edits = rule.edits_of(size)
    lines = np.flatnonzero(edits > 0)
    runs = size[lines] - run + 1
    begin = np.cumsum(runs) - runs
    at = np.repeat(first[lines] - begin, runs) + np.arange(int(runs.sum()))
    own = np.repeat(np.arange(len(lines)), runs)
    place = words[at]
    rare = np.minimum(order[(place % np.uint64(ORDER_SLOTS)).astype(np.int64)], (1 << 24) - 1).astype(np.uint64)
    for k in range(1, run):
        place = mix(place, 34) + words[at + k]
    place = rare << np.uint64(40) | mix(place, 34) >> np.uint64(24)
    by = np.argsort(place)
    # Few enough lines are sorted by radix.
    by = by[np.argsort(own[by].astype(np.uint16 if len(lines) <= 1 << 16 else np.int64), kind="stable")]
    at, place = at[by], place[by]
    overlapped = np.zeros(len(words) + 2 * run, bool)
    taken = np.zeros(len(lines), np.int64)
    still, left, step = np.arange(len(lines)), edits[lines] + 1, 0
    while len(still):
        where = at[begin[still] + step] + run
        apart = ~overlapped[where]
        for k in range(1 - run, run):
            overlapped[where[apart] + k] = True
        left = left - apart
        step += 1
        taken[still[left == 0]] = step
        still, left = still[left > 0], left[left > 0]
    chosen = np.repeat(begin, taken) + np.arange(int(taken.sum())) - np.repeat(np.cumsum(taken) - taken, taken)
    own, keys = np.repeat(lines, taken), place[chosen]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
    ends = np.searchsorted(own[new], np.arange(len(size) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(mix(keys[new], 35).view(np.int64)))


def occurrences(docs: DataFrame, rule: FuzzyLines) -> DataFrame:
    """Every long enough line: ``doc_id, text_key, place, h1, h2, sim, n_words, keys``.

    A document is known by doc_id and a hash of its text, a line by two hashes of its words in order.
    ``sim`` is the SimHash if the rule has bits, else the word parity; ``keys`` are the buckets then.
    """
    order = None if rule.within_bits else word_order(docs)
    buckets = run_keys if rule.run_length() > 1 else rare_keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            lines = lines_of(batch.column("text"))
            size = np.diff(lines.bounds)
            kept = np.flatnonzero(size >= max(1, rule.min_words))
            if not len(kept):
                continue
            begin, size = lines.bounds[:-1][kept], size[kept]
            first = np.cumsum(size) - size
            taken = np.repeat(begin - first, size) + np.arange(int(size.sum()))
            place = (np.arange(len(taken)) - np.repeat(first, size)).astype(np.uint64)
            words = lines.hashes[taken]
            h1, h2 = (np.add.reduceat(mix(words + mix(place, s), s), first).view(np.int64) for s in (21, 22))
            rows = pa.array(lines.text[kept])
            if rule.within_bits:
                sim, keys = simhash(lines.hashes, begin, size), pa.nulls(len(size), pa.list_(pa.int64()))
            else:
                sim, keys = parity(words, first, size), buckets(words, first, size, order, rule)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows),
                    batch.column("text_key").take(rows),
                    pa.array(lines.place[kept].astype(np.int32)),
                    pa.array(h1),
                    pa.array(h2),
                    pa.array(sim),
                    pa.array(size.astype(np.int32)),
                    keys,
                ],
                ["doc_id", "text_key", "place", "h1", "h2", "sim", "n_words", "keys"],
            )

    schema = "doc_id long, text_key long, place int, h1 long, h2 long, sim long, n_words int, keys array<long>"
    return _keyed(docs).mapInArrow(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")


def _buckets(sim: Column, rule: FuzzyLines) -> Column:
    parts = [F.shiftrightunsigned(sim, shift).bitwiseAND(F.lit((1 << width) - 1)) for shift, width in rule.blocks()]
    keys = [F.xxhash64(F.lit(i * 64 + j), parts[i], parts[j]) for i, j in combinations(range(len(parts)), 2)]
    return F.array(*keys)


def _least_shared(rule: FuzzyLines):
    """How many buckets two lines share at least, by their marks; the shorter one decides."""

    def least(x: Column, y: Column) -> Column:
        shorter = F.least(F.shiftright(x, PARITY_BITS), F.shiftright(y, PARITY_BITS))
        more = 2 + F.floor(shorter / WORDS_PER_SHARED)
        return F.when(shorter >= rule.length_of(3), more).otherwise(F.lit(1))

    return least


def _line_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words) of the wanted lines: their words' 64-bit hashes as bytes, which go to Arrow and back as they are."""
    per_doc = wanted.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("place", "node")).alias("lines")
    )
    per_doc = per_doc.select(F.col("doc_id").alias("of"), F.col("text_key").alias("with"), "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            lines = lines_of(batch.column("text"))
            first = np.searchsorted(lines.text, np.arange(len(batch)))
            asked = pc.list_flatten(batch.column("lines"))
            rows = first[pc.list_parent_indices(batch.column("lines")).to_numpy()]
            at = rows + asked.field("place").to_numpy(zero_copy_only=False)
            size = lines.bounds[at + 1] - lines.bounds[at]
            ends = np.append(0, np.cumsum(size))
            taken = np.repeat(lines.bounds[at] - ends[:-1], size) + np.arange(ends[-1])
            buffers = [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(lines.hashes[taken])]
            words = pa.Array.from_buffers(pa.binary(), len(size), buffers)
            yield pa.RecordBatch.from_arrays([asked.field("node"), words], ["node", "words"])

    found = _keyed(docs).join(
        broadcast_if_small(per_doc, 20_000), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("with"))
    )
    # Rows alike in doc_id and text give the same lines.
    return found.select("text", "lines").mapInArrow(run, "node long, words binary").dropDuplicates(["node"])


def _wide_marks(words: DataFrame):
    """Lengths and word parities of ``64 * WIDE`` groups of words, for the open nodes."""
    names = [f"p{k}" for k in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(words.as_buffer(), np.uint64) for words in batch.column("words")]
            size = np.array([len(words) for words in found], np.int64)
            bits = np.zeros((len(found), 64 * WIDE), np.uint8)
            for row, words in zip(bits, found):
                place = (mix(words, 33) % np.uint64(64 * WIDE)).astype(np.int64)
                row[:] = np.bincount(place, minlength=64 * WIDE) & 1
            longs = np.packbits(bits, axis=1).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(longs[:, k])) for k in range(WIDE)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(size), *columns], ["node", "size", *names])

    def narrow(nodes: DataFrame) -> DataFrame:
        asked = broadcast_if_small(nodes.withColumnRenamed("node", "of"))
        wanted = words.join(asked, F.col("node") == F.col("of"), "left_semi")
        schema = ", ".join(f"{name} long" for name in ("node", "size", *names))
        marks = wanted.mapInArrow(run, schema)
        return marks.select("node", F.struct("size", *names).alias("better"))

    return narrow


def _shared_words(x: np.ndarray, y: np.ndarray) -> int:
    """Words in common, as often as both have them; a hash collision can only add some."""

    def numbered(words: np.ndarray) -> np.ndarray:
        words = np.sort(words.view(np.uint64))
        number = np.arange(len(words)) - np.searchsorted(words, words)
        return mix(words + mix(number.astype(np.uint64), 34), 34)

    both = np.sort(np.concatenate([numbered(x), numbered(y)]))
    return int((both[1:] == both[:-1]).sum())


def _alike(x: np.ndarray, y: np.ndarray, i: int, j: int) -> int:
    """How many words of ``x`` from ``i`` on equal those of ``y`` from ``j`` on."""
    left, done, step = min(len(x) - i, len(y) - j), 0, 16
    while done < left:
        to = min(left, done + step)
        other = x[i + done : i + to] != y[j + done : j + to]
        at = int(other.argmax())
        if other[at]:
            return done + at
        done, step = to, 4 * step
    return done


def within_edits(x: np.ndarray, y: np.ndarray, limit: int) -> bool:
    """Whether ``limit`` replaced, added or removed words turn ``x`` into ``y``.

    Takes time in proportion to the lengths, and to the square of the edits that are needed: per number of edits
    and per offset between the lines it keeps how far they can agree.
    """
    if abs(len(x) - len(y)) > limit:
        return False
    if max(len(x), len(y)) - _shared_words(x, y) > limit:
        return False
    goal = len(y) - len(x)
    reached: dict[int, int] = {}
    for edits in range(limit + 1):
        now = {}
        spare = limit - edits
        for offset in range(max(-edits, goal - spare), min(edits, goal + spare) + 1):
            if edits:
                steps = [
                    reached[offset - 1] if offset - 1 in reached else -1,
                    reached[offset] + 1 if offset in reached else -1,
                    reached[offset + 1] + 1 if offset + 1 in reached else -1,
                ]
                i = min(max(steps), len(x), len(y) - offset)
            else:
                i = 0
            if i < max(0, -offset):
                continue
            now[offset] = i + _alike(x, y, i, i + offset)
        if now.get(goal) == len(x):
            return True
        reached = now
    return False


def _confirmed(pairs: DataFrame, rule: FuzzyLines) -> DataFrame:
    """(a, b) of the rows ``a, b, words_a, words_b`` whose edit similarity is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for k, both in enumerate(zip(batch.column("words_a"), batch.column("words_b"))):
                x, y = (np.frombuffer(words.as_buffer(), np.uint64) for words in both)
                if within_edits(x, y, max(len(x), len(y)) * rule.away // 100):
                    kept.append(k)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return pairs.select("a", "b", "words_a", "words_b").mapInArrow(run, "a long, b long")


def repeated_lines(docs: DataFrame, rule: FuzzyLines = DEFAULT) -> DataFrame:
    """The line occurrences to remove: ``doc_id, text_key, place`` (from 0, by line feeds).

    Lines are linked if their edit similarity, 1 less the edit distance in words over the longer
    length, is at least ``rule.percent``, and if the rule is ``within_bits``, their SimHashes differ in at
    most ``rule.bits`` bits.
    """
    limit_batches(docs.sparkSession)
    all_lines = materialize(occurrences(docs, rule))
    first = F.min(F.struct("doc_id", "text_key", "place"))
    distinct = all_lines.groupBy("h1", "h2").agg(
        F.min("sim").alias("sim"),
        F.min("n_words").alias("n_words"),
        F.count("*").alias("n"),
        first.alias("first"),
        # Equal lines have equal keys.
        F.first("keys").alias("keys"),
    )
    # The id is fixed once the rows are written.
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()))
    keys = _buckets(F.col("sim"), rule) if rule.within_bits else F.col("keys")
    members = distinct.select(F.explode(keys).alias("bucket"), "node", F.col("sim").alias("mark"))

    def possible(size_x: Column, size_y: Column, flipped: Column) -> Column:
        shorter, longer = F.least(size_x, size_y), F.greatest(size_x, size_y)
        # Each of the edits flips two bits at most; one that changes the length flips one.
        near = 100 * (flipped + longer - shorter) <= 2 * rule.away * longer
        return near & (100 * shorter >= rule.percent * longer)

    def fits(x: Column, y: Column) -> Column:
        if rule.within_bits:
            return F.bit_count(x.bitwiseXOR(y)) <= rule.bits
        flipped = F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit((1 << PARITY_BITS) - 1)))
        return possible(F.shiftright(x, PARITY_BITS), F.shiftright(y, PARITY_BITS), flipped)

    def fits_wide(x: Column, y: Column) -> Column:
        flipped = sum(F.bit_count(x[f"p{k}"].bitwiseXOR(y[f"p{k}"])) for k in range(WIDE))
        return possible(x["size"], y["size"], flipped)

    def screen(pairs: DataFrame) -> DataFrame:
        # ``fits`` has seen the marks; lengths beyond them and the words themselves are confirmed.
        return pairs

    runs = not rule.within_bits and rule.run_length() > 1
    known = None
    if runs:
        # Most buckets of runs hold one line, or two that don't fit; they go before anything else is shuffled.
        # The window spills.
        bucket = Window.partitionBy("bucket")
        about = {
            "lowest": F.min("node"), "highest": F.max("node"), "rows": F.count("*"),
            "mark_lowest": F.min_by("mark", "node"), "mark_highest": F.max_by("mark", "node"),
        }
        comparable = (F.col("rows") > 2) | fits(F.col("mark_lowest"), F.col("mark_highest"))
        members = members.select("*", *[how.over(bucket).alias(name) for name, how in about.items()])
        members = materialize(members.where((F.col("lowest") != F.col("highest")) & comparable).drop(*about))
        asked = members.select(F.col("node").alias("of")).distinct()
        known = materialize(_line_words(docs, distinct.join(asked, F.col("node") == F.col("of")).select("first.*", "node")))

    def words_of_nodes(nodes: DataFrame) -> DataFrame:
        asked = broadcast_if_small(nodes)
        if known is not None:
            return known.join(asked, F.col("node") == F.col("of"), "left_semi")
        return _line_words(docs, distinct.join(asked, F.col("node") == F.col("of")).select("first.*", "node"))

    def both(pairs: DataFrame, frame: DataFrame, value: str) -> DataFrame:
        for side in ("b", "a"):
            one = frame.select(F.col("node").alias(f"n_{side}"), F.col(value).alias(f"{value}_{side}"))
            pairs = pairs.join(one, F.col(side) == F.col(f"n_{side}"))
        return pairs

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs)
        nodes = pairs.select(F.col("a").alias("of")).union(pairs.select("b")).distinct()
        words = materialize(words_of_nodes(nodes))
        links = materialize(_confirmed(both(pairs, words, "words"), rule))
        discard(pairs, words)
        return links

    # The last step of single words takes its number of shared buckets from the short marks.
    least = None if rule.within_bits or runs else _least_shared(rule)
    if runs:
        grouped = link(members, fits, screen, confirm, _wide_marks(known), fits_wide, spread=True)
        discard(members, known)
    else:
        grouped = link(members, fits, screen, confirm, least_shared=least)
    grouped = grouped.withColumnRenamed("node", "of")
    lines = distinct.join(grouped, F.col("node") == F.col("of"), "left").drop("of")
    lines = materialize(
        lines.select("h1", "h2", "n", "first", F.coalesce("component", "node").alias("line_group"), "component")
    )
    # The smallest node of a component has no row of its own in ``grouped``.
    groups = lines.groupBy("line_group").agg(
        F.sum("n").alias("all"), F.min("first").alias("keep")
    ).where(F.col("all") > 1)
    several = materialize(
        lines.join(groups.withColumnRenamed("line_group", "g"), F.col("line_group") == F.col("g"))
        .select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "keep")
    )
    here = F.struct("doc_id", "text_key", "place")
    found = all_lines.join(several, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    gone = materialize(found.where(~here.eqNullSafe(F.col("keep"))).select("doc_id", "text_key", "place"))
    discard(all_lines, distinct, lines, several)
    return gone


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the lines whose numbers ``gone`` (ascending) holds."""

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, numbers in batches:
            out = []
            for text, places in zip(texts.to_pylist(), numbers.to_pylist()):
                drop = set(places)
                out.append("\n".join(line for k, line in enumerate(text.split("\n")) if k not in drop))
            yield pa.array(out, pa.string())

    return F.arrow_udf(cut, "string")(text, gone)


def removals(docs: DataFrame, rule: FuzzyLines = DEFAULT) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text_key, n_lines, removed`` (line numbers, ascending).

    Null texts have no lines. Rows alike in doc_id and text are one document: each keeps and loses
    the same lines. Rows without doc_id take part and come first. Lines are compared whole; an
    empty table gives no rows.
    """
    places = F.array_sort(F.collect_set("place")).alias("removed")
    gone = repeated_lines(docs, rule).groupBy("doc_id", "text_key").agg(places)
    gone = gone.select(F.col("doc_id").alias("of"), F.col("text_key").alias("with"), "removed")
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines")
    keyed = _keyed(docs).select("doc_id", "text_key", F.when(F.col("text").isNull(), 0).otherwise(lines).alias("n_lines"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("with"))
    return keyed.join(gone, same, "left").select(
        "doc_id", "text_key", "n_lines", F.coalesce("removed", F.array().cast(ArrayType(LongType()))).alias("removed")
    )


def dedup_lines(docs: DataFrame, rule: FuzzyLines = DEFAULT) -> DataFrame:
    """``docs`` with repeated lines cut from their texts; a text left without a word is dropped.

    Texts that had no word before stay as they are.
    """
    gone = repeated_lines(docs, rule).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("place")).alias("removed"))
    gone = materialize(gone.select(F.col("doc_id").alias("of"), F.col("text_key").alias("with"), "removed"))
    same = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("of")) & (F.xxhash64("doc.text") == F.col("with"))
    joined = wrap(docs).join(broadcast_if_small(gone, 20_000), same, "left").drop("of", "with")
    untouched = joined.where(F.col("removed").isNull()).select("doc.*")
    cut = joined.where(F.col("removed").isNotNull()).withColumn("text", _without(F.col("doc.text"), F.col("removed")))
    cut = cut.where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    columns = [F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        columns = [F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else x for c, x in zip(docs.columns, columns)]
    return untouched.union(cut.select(*columns))
