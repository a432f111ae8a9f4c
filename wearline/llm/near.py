"""Near-duplicate documents by banded MinHash with odd sketches.

A document is its set of word shingles. MinHash values are cut into bands; documents that share a
band are candidates. The same values are folded into a parity bitmap, the odd sketch: two bitmaps
differ in more places the less the sets agree, and for high similarities the count of differing
bits is a precise estimate. Candidates whose estimate is clearly too low are dropped, the rest
are confirmed on the full sets. Equal sets are one item from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wearline.llm.linking import link
from wearline.llm.shared import limit_batches
from wearline.llm.texts import ASCII_LOWER, WHITE, mix, text_bytes, words_of
from wearline.session import broadcast_if_small, materialize

SKETCH_BITS = 1024
# Bits of the parity bitmap of a whole set, for documents that sampled values cannot tell apart.
SET_BITS = 2048


@dataclass(frozen=True)
class Near:
    """Shingle length, similarity in percent, and the bands.

    A pair at the similarity s shares no band with probability (1 - s**rows) ** bands: 1.2e-5
    at 0.8 with 48 bands of 7, and 3e-9 at 0.85.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 7

    @property
    def values(self) -> int:
        return self.bands * self.rows

    def fits(self, x: Column, y: Column) -> Column:
        """Sizes that allow the similarity."""
        return (100 + self.percent) * F.least(x, y) >= self.percent * (x + y)

    def fits_sets(self, x: Column, y: Column) -> Column:
        """Sizes and whole-set bitmaps that allow it.

        Every shingle of one set alone toggles a bit and two may cancel out, so bitmaps never differ in
        more bits than the sets differ in shingles: no linked pair is left out.
        """
        bits = F.zip_with(x["bits"], y["bits"], lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        apart = F.aggregate(bits, F.lit(0), lambda total, b: total + b)
        allowed = (100 - self.percent) * (x["size"] + y["size"])
        return self.fits(x["size"], y["size"]) & ((100 + self.percent) * apart <= allowed)

    def sketch_limit(self) -> int:
        """Differing bits that a pair at the similarity exceeds with a chance below one in a million.

        Differing values are binomial; each differing value toggles one bit per side at random.
        """
        away = 1 - self.percent / 100
        share = (1 - math.exp(-4 * self.values * away / SKETCH_BITS)) / 2
        slope = 2 * math.exp(-4 * self.values * away / SKETCH_BITS)
        drawn = slope * math.sqrt(self.values * away * (1 - away))
        placed = math.sqrt(SKETCH_BITS * share * (1 - share))
        return math.ceil(SKETCH_BITS * share + 5 * math.hypot(drawn, placed))


DEFAULT = Near()


def shingle_sets(column: pa.Array, length: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as ascending 64-bit hashes.

    Words are cut at ASCII white space, with A-Z in lower case. A text with fewer words is one
    shingle; one without words has none.
    """
    data, offsets = text_bytes(column)
    words = words_of(ASCII_LOWER[data], offsets, WHITE)
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        hashes = words.hashes[a:b]
        if not len(hashes):
            yield hashes
            continue
        size = min(length, len(hashes))
        chain = mix(hashes[: len(hashes) - size + 1], size)
        for k in range(1, size):
            chain = mix(chain + hashes[k : len(hashes) - size + 1 + k], size)
        yield np.unique(chain)


class Sketcher:
    def __init__(self, near: Near, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.near = near
        self.factors = rng.integers(1 << 31, 1 << 32, near.values, np.uint32) | np.uint32(1)
        self.shifts = rng.integers(0, 1 << 32, near.values, np.uint32)
        self.numbers = np.arange(near.values, dtype=np.uint64)
        self.band_numbers = np.arange(near.bands, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.near.values, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(short), 512):
            table = short[at : at + 512, None] * self.factors + self.shifts
            np.minimum(out, table.min(0), out=out)
        return out

    def bands(self, signature: np.ndarray) -> np.ndarray:
        table = signature.reshape(self.near.bands, self.near.rows).astype(np.uint64)
        key = mix(self.band_numbers, 3)
        for k in range(self.near.rows):
            key = mix(key + table[:, k], 3)
        return key.view(np.int64)

    def odd(self, signature: np.ndarray) -> np.ndarray:
        """The parity bitmap: every value toggles the bit that it is hashed to with its number."""
        place = mix((self.numbers << np.uint64(32)) | signature, 4) % np.uint64(SKETCH_BITS)
        bits = np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1
        return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, near: Near) -> DataFrame:
    """``doc_id, n_shingles``, the set's fingerprint ``f1, f2``, ``bands`` and odd ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(near)
        for batch in batches:
            sizes, marks, bands, odd = [], [], [], []
            for s in shingle_sets(batch.column("text"), near.shingle):
                sizes.append(len(s))
                marks.append((mix(s, 5).sum(), mix(s, 6).sum()))
                signature = sketcher.signature(s) if len(s) else None
                bands.append(sketcher.bands(signature) if len(s) else [])
                odd.append(sketcher.odd(signature) if len(s) else [])
            marks = np.array(marks, np.uint64).reshape(-1, 2).view(np.int64)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(marks[:, 0]),
                    pa.array(marks[:, 1]),
                    pa.array(bands, longs),
                    pa.array(odd, longs),
                ],
                ["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"],
            )

    schema = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """(node, shingles) of the documents in ``nodes``, from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"), near.shingle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"]
            )

    wanted = docs.select(F.col("doc_id").cast("long"), "text").join(
        broadcast_if_small(nodes), F.col("doc_id") == F.col("node"), "left_semi"
    )
    return wanted.mapInArrow(run, "node long, shingles array<long>")


def _sided(frame: DataFrame, side: str, value: str) -> DataFrame:
    return frame.select(F.col("node").alias(f"n_{side}"), F.col(value).alias(f"{value}_{side}"))


def _both(pairs: DataFrame, frame: DataFrame, value: str) -> DataFrame:
    """``pairs`` with the value of either side."""
    joined = pairs.join(_sided(frame, "b", value), F.col("b") == F.col("n_b"))
    return joined.join(_sided(frame, "a", value), F.col("a") == F.col("n_a"))


def _screen(items: DataFrame, near: Near):
    """Drops pairs whose sizes or odd sketches rule the similarity out."""
    marks = items.select("node", F.struct(F.col("n_shingles").alias("mark"), "sketch").alias("m"))

    def screen(pairs: DataFrame) -> DataFrame:
        bits = F.zip_with("m_a.sketch", "m_b.sketch", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        differing = F.aggregate(bits, F.lit(0), lambda total, b: total + b)
        likely = _both(pairs, marks, "m").where(near.fits(F.col("m_a.mark"), F.col("m_b.mark")))
        return likely.where(differing <= near.sketch_limit()).select("a", "b")

    return screen


def _confirm(docs: DataFrame, near: Near):
    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs)
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = materialize(full_sets(docs, nodes, near))
        common = F.size(F.array_intersect("shingles_a", "shingles_b"))
        joined = _both(pairs, sets, "shingles").select(
            "a", "b", common.alias("common"), (F.size("shingles_a") + F.size("shingles_b")).alias("both")
        )
        return joined.where(100 * F.col("common") >= near.percent * (F.col("both") - F.col("common"))).select(
            "a", "b"
        )

    return confirm


def _narrow(docs: DataFrame, near: Near):
    """Sizes and parity bitmaps of whole sets, for the open nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits = [], []
            for s in shingle_sets(batch.column("text"), near.shingle):
                place = (mix(s, 7) % np.uint64(SET_BITS)).astype(np.int64)
                odd = np.bincount(place, minlength=SET_BITS) & 1
                sizes.append(len(s))
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "size", "bits"])

    def narrow(nodes: DataFrame) -> DataFrame:
        wanted = docs.select(F.col("doc_id").cast("long"), "text").join(
            broadcast_if_small(nodes), F.col("doc_id") == F.col("node"), "left_semi"
        )
        # Repeated rows give their set again.
        sets = wanted.mapInArrow(run, "node long, size long, bits array<long>").distinct()
        return sets.select("node", F.struct("size", "bits").alias("better"))

    return narrow


def near_duplicates(docs: DataFrame, near: Near = DEFAULT) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id, kept`` (doc_id = component_id).

    Links have a Jaccard similarity of at least ``near.percent``; a component's id is its smallest
    doc_id. Documents without words, null texts included, link to nothing and stay. Rows of one
    doc_id are one document; a row without doc_id links to nothing, has a null component and
    stays. Texts count whole; an empty table gives no rows.
    """
    limit_batches(docs.sparkSession)
    found = materialize(sketches(docs, near))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = materialize(found.where(linked).groupBy("f1", "f2").agg(F.min("doc_id").alias("node")))
    keys = classes.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "node")
    same = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))
    placed = found.join(keys, same & linked, "left").drop("g1", "g2")
    # Only a class's first document keeps its bands and sketch.
    leads = F.col("doc_id") == F.col("node")
    placed = materialize(
        placed.select(
            "doc_id",
            "n_shingles",
            "node",
            F.when(leads, F.col("bands")).alias("bands"),
            F.when(leads, F.col("sketch")).alias("sketch"),
        )
    )
    items = placed.where(F.col("bands").isNotNull())
    members = items.select(F.explode("bands").alias("bucket"), "node", F.col("n_shingles").alias("mark"))
    grouped = link(
        members, near.fits, _screen(items, near), _confirm(docs, near), _narrow(docs, near), near.fits_sets
    )
    grouped = grouped.withColumnRenamed("node", "of")
    result = placed.select("doc_id", "n_shingles", "node").join(grouped, F.col("node") == F.col("of"), "left")
    component = F.coalesce("component", "node", "doc_id")
    return result.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, near: Near = DEFAULT) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component, or has no links."""
    gone = near_duplicates(docs, near).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(broadcast_if_small(materialize(gone)), F.col("doc_id") == F.col("gone"), "left_anti")
