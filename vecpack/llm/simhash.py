"""SimHash near-duplicates: fingerprints meet at the anchors of a covering code."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecpack.llm.common import checkpointed, with_python_columns
from vecpack.llm.components import connected_components

#: Shingles of a text whose bits are counted at a time.
CHUNK = 1 << 16
#: Different fingerprints from which anchors of three blocks keep their neighbourhoods small.
MANY = 100_000_000


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the text's shingles of ``words`` words, as a signed 64-bit number; 0 without words.

    A-Z are lower-cased, words end at ASCII white space, repeated shingles count each time; a text of
    fewer words is one shingle. A bit is 1 if it is set in more than half of the XXH64 (seed 42) hashes.
    """
    from xxhash import xxh64_intdigest

    if not text:
        return 0
    w = text.encode().lower().split()
    if not w:
        return 0
    if len(w) < words:
        grams = [b" ".join(w)]
    else:
        grams = list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))
    return majority(np.fromiter((xxh64_intdigest(g, 42) for g in grams), "<u8", len(grams)))


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of some unsigned 64-bit hashes, as a signed number; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        some = np.ascontiguousarray(hashes[i : i + CHUNK], "<u8").view(np.uint8)
        ones += np.unpackbits(some.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """``df`` without its ``text``, with ``fp`` (long); null and empty texts have 0."""
    return with_python_columns(df, [text], lambda texts: [[fingerprint(t, words) for t in texts]], [T.StructField("fp", T.LongType())], drop=(text,))


class Code:
    """A perfect cyclic code of ``size`` bits with this generator polynomial and covering radius."""

    def __init__(self, size: int, generator: int, radius: int, threshold: int):
        self.size, self.radius = size, radius
        self.checks = generator.bit_length() - 1
        self.remainder = np.zeros(size, np.int64)  # of each single bit
        for i in range(size):
            r = 1 << i
            for k in range(i, self.checks - 1, -1):
                if r >> k & 1:
                    r ^= generator << (k - self.checks)
            self.remainder[i] = r
        # Patterns of each excess over the radius, by syndrome: offsets and the patterns themselves.
        by_excess: list[list[tuple[int, int]]] = [[] for _ in range(threshold + 1)]
        level = {(0, -1, 0)}
        for weight in range(radius + threshold + 1):
            by_excess[max(0, weight - radius)] += [(s, p) for p, _, s in level]
            level = {(p | 1 << i, i, s ^ int(self.remainder[i])) for p, top, s in level for i in range(top + 1, size)}
        self.near = []
        for pairs in by_excess:
            pairs.sort()
            s, p = np.array(pairs, np.int64).reshape(-1, 2).T
            self.near.append((np.searchsorted(s, np.arange((1 << self.checks) + 1)), p))

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x), np.int64)
        for i in range(self.size):
            s ^= (x >> i & 1) * self.remainder[i]
        return s


class Anchors:
    """Anchors are the words of a product of perfect codes on separate bits of the fingerprint.

    The nearest word is at most the covering radius R away in each block: it is a fingerprint's home. A
    fingerprint at most t bits from another is, over all blocks, at most t further from the other's home
    than the radii: it visits every anchor within R + t. So each linked pair meets at the home of either.
    Two Golay blocks give 2^24 anchors and some 61 visits; ``blocks=3`` adds a Hamming code on 15 more
    bits, 2^35 anchors and some 150 visits, for beyond about 10^8 different fingerprints.
    """

    # Size, generator polynomial and covering radius of the two perfect codes.
    GOLAY = (23, 0b110001110101, 3)
    HAMMING = (15, 0b10011, 1)

    def __init__(self, threshold: int, blocks: int = 2):
        shapes = [self.GOLAY, self.GOLAY, self.HAMMING][:blocks]
        self.threshold = threshold
        self.codes = [Code(*shape, threshold) for shape in shapes]
        self.shifts = [sum(c.size for c in self.codes[:i]) for i in range(blocks)]

    @staticmethod
    @lru_cache(4)
    def of(threshold: int, blocks: int) -> Anchors:
        return Anchors(threshold, blocks)

    def of_all(self, fps: np.ndarray, homes: bool) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, index of the fingerprint) of the homes, or of all visits."""
        parts = [fps >> s & ((1 << c.size) - 1) for c, s in zip(self.codes, self.shifts, strict=True)]
        syndromes = [c.syndrome(x) for c, x in zip(self.codes, parts, strict=True)]
        anchors, rows = [], []
        for excess in product(range(1 if homes else self.threshold + 1), repeat=len(self.codes)):
            if sum(excess) > self.threshold:
                continue
            row, anchor = np.arange(len(fps)), np.zeros(len(fps), np.int64)
            for code, shift, part, syndrome, e in zip(self.codes, self.shifts, parts, syndromes, excess, strict=True):
                offsets, patterns = code.near[e]
                first, count = offsets[syndrome[row]], offsets[syndrome[row] + 1] - offsets[syndrome[row]]
                at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                row, anchor = np.repeat(row, count), np.repeat(anchor, count)
                anchor |= (part[row] ^ patterns[at]) << shift
            anchors.append(anchor)
            rows.append(row)
        return np.concatenate(anchors), np.concatenate(rows)


def _at_anchors(fps: DataFrame, threshold: int, blocks: int, homes: bool) -> DataFrame:
    def run(batches):
        plan = Anchors.of(threshold, blocks)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(x), 1024):
                anchors, rows = plan.of_all(x[i : i + 1024], homes)
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(x[i : i + 1024][rows])], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def links(fps: DataFrame, threshold: int = 2, blocks: int = 2) -> DataFrame:
    """(src, dst), src < dst: the pairs of different ``fp`` (distinct, long) at most ``threshold`` bits apart.

    Each pair is made once, at the home of its smaller member. Of a fingerprint there are at most
    1 + 64 + 2016 others within two bits, so the rows made grow with the input however large a group is;
    the distance is part of the join's condition, and a hot anchor is a skewed join that Spark splits.
    """
    home = _at_anchors(fps, threshold, blocks, True).select(F.col("anchor"), F.col("fp").alias("src"))
    visit = _at_anchors(fps, threshold, blocks, False).select(F.col("anchor").alias("at"), F.col("fp").alias("dst"))
    near = (F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= threshold)
    return visit.join(home, (F.col("anchor") == F.col("at")) & near).select("src", "dst")


def groups(fps: DataFrame, threshold: int = 2, blocks: int | None = None) -> DataFrame:
    """(fp, root) of those of the distinct ``fp`` that have :func:`links`; chains of links have one root.

    The anchors have three ``blocks`` for more than MANY fingerprints, and else two.
    """
    blocks = blocks or (3 if fps.count() > MANY else 2)
    return connected_components(links(fps, threshold, blocks)).toDF("fp", "root")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 2, words: int = 3, blocks: int | None = None) -> DataFrame:
    """(key, fingerprint, component_id, tag, group) for each row of ``df``.

    Rows whose fingerprints differ in at most ``threshold`` bits are linked; component_id is the smallest
    key that a chain of links reaches, the row's own included; ``group`` is the same for the same rows, but
    never null, and ``tag`` is the text's hash, to tell rows of equal keys apart. Null and empty texts have the fingerprint
    zero and are linked by it like any other; rows with a null key are linked but never name a component
    (null if it has no other row). Repeated rows come back each time. Copies collapse to one fingerprint
    before anything is compared; an empty table gives an empty one; other columns are not used. Texts of any
    length are whole: their shingles are counted piece by piece.
    """
    read = df.select(F.col(f"`{key}`").alias("doc_key"), F.col(f"`{text}`").alias("doc_text")).withColumn("tag", F.xxhash64("doc_text"))
    slim = checkpointed(fingerprints(read, "doc_text", words).select("doc_key", "tag", "fp"))
    classes = checkpointed(slim.groupBy("fp").agg(F.min("doc_key").alias("least")))
    roots = groups(classes.select("fp"), threshold, blocks)
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "root")
    return slim.join(named, "fp").select(F.col("doc_key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "tag", F.col("root").alias("group"))
