"""Byte-level BPE: each distinct pre-token of the whole corpus is encoded once, decoding joins the token bytes."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecpack.llm.common import small_batches, without
from vecpack.llm.memory import give_back

#: Characters of text after which a block of documents, and with it its word list, is closed.
BLOCK_CHARS = 2_000_000
#: Words whose ids a Python worker remembers; then it forgets them all.
REMEMBERED = 300_000


@lru_cache(2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    made = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})
    _ranks.cache_clear()
    return made


@lru_cache(2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes in a row, and where each id's begin."""
    ranks = _ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    _ranks.cache_clear()
    return np.frombuffer(b"".join(by_id), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in by_id])])


def _gather(flat: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a ragged table that ``ids`` name, in a row, and where each one begins."""
    count = offsets[ids + 1] - offsets[ids]
    ends = np.cumsum(count)
    return flat[np.repeat(offsets[ids] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)], np.concatenate([[0], ends])


def _pack(*arrays: np.ndarray | list | bytes) -> bytes:
    """Byte strings and arrays of unsigned 32-bit numbers, each after its length, compressed."""
    import zstandard

    raw = b"".join(len(x).to_bytes(8, "little") + x for x in (a if isinstance(a, bytes) else np.asarray(a, "<u4").tobytes() for a in arrays))
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(packed: bytes) -> list[bytes]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(packed), 0, []
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.int64)


def _short(x: np.ndarray) -> bytes:
    """Numbers below 2^28 in one to four bytes of seven bits, the lowest first."""
    size = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21)
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(4):
        some = size > k
        out[(ends - size)[some] + k] = x[some] >> 7 * k & 127 | (size[some] > k + 1).astype(np.int64) << 7
    return out.tobytes()


def _long(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    out = np.zeros(len(ends), np.int64)
    for k in range(4):
        some = ends - starts >= k
        out[some] |= (b[starts[some] + k] & 127).astype(np.int64) << 7 * k
    return out


#: What a row of a block is by its bucket: a document, or its sequences; from 0 a list of words.
_DOCUMENT, _SEQUENCES = -1, -2
#: The columns that blocks have beside those of the documents; ``bpe_to`` is where a row goes: a list to its bucket, others to the block.
_BLOCK = T.StructType([
    T.StructField("bpe_to", T.StringType()), T.StructField("bpe_block", T.StringType()), T.StructField("bpe_bucket", T.IntegerType()), T.StructField("bpe_row", T.IntegerType()), T.StructField("bpe_packed", T.BinaryType()),
])


def _explode(pattern: str, text: int, buckets: int):
    """Documents to blocks of rows, which are of three kinds.

    A document keeps its other columns and its place in the block. One row has the sequences: for each
    document the numbers of its pre-tokens in the block's list, by position. The list of distinct
    pre-tokens, numbered from the most frequent, is dealt to buckets by hash, one row for each bucket; which
    numbers a bucket has goes with the sequences. A block's name ends with a digest of its list, so that
    words can't meet numbers that belong to others. No bucket is named like a block, whose name has colons.
    """
    import regex
    from pyspark import TaskContext
    from xxhash import xxh32_intdigest, xxh64_hexdigest

    find = regex.compile(pattern).findall

    def run(batches):
        numbers: dict[str, int] = {}
        held: list[pa.RecordBatch] = []
        sequences: list[np.ndarray] = []
        chars, closed, schema = 0, 0, None

        def rows_of(name, rest, bucket, row, packed):
            to = [name if b < 0 else str(b) for b in bucket]
            columns = [pa.array(to, pa.string()), pa.array([name] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(row, pa.int32()), pa.array(packed, pa.binary())]
            return pa.RecordBatch.from_arrays((rest or [pa.nulls(len(bucket), f.type) for f in schema]) + columns, names=schema.names + _BLOCK.names)

        def close():
            words = [w.encode() for w in numbers]
            name = f"{TaskContext.get().partitionId()}:{closed}:{xxh64_hexdigest(b'\0'.join(words))}"
            row = 0
            for batch in held:
                n = batch.num_rows
                yield rows_of(name, batch.columns, [_DOCUMENT] * n, range(row, row + n), [None] * n)
                row += n
            numbers.clear()
            flat = np.concatenate([*sequences, np.zeros(0, "<u4")])
            rank = np.empty(len(words), np.int64)
            rank[np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")] = np.arange(len(words))
            bucket = np.array([xxh32_intdigest(w) % buckets for w in words], np.int64)
            order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
            order = order[np.argsort(bucket[order], kind="stable")]
            parts, sizes = np.unique(bucket, return_counts=True)
            whole = _pack([len(x) for x in sequences], _short(rank[flat]), parts, sizes, _short(rank[order]))
            lists = []
            for part in np.split(order, np.cumsum(sizes)[:-1]) if len(parts) else []:
                some = [words[i] for i in part.tolist()]
                lists.append(_pack([len(w) for w in some], b"".join(some)))
            yield rows_of(name, None, [_SEQUENCES, *parts], [None] * (1 + len(parts)), [whole, *lists])

        for batch in batches:
            rest = batch.select([n for i, n in enumerate(batch.schema.names) if i != text])
            schema, done = rest.schema, 0
            for i, t in enumerate(batch.column(text).to_pylist()):
                sequences.append(np.array([numbers.setdefault(w, len(numbers)) for w in find(t)] if t else [], "<u4"))
                chars += len(t or "")
                if chars >= BLOCK_CHARS:
                    held.append(rest.slice(done, i + 1 - done))
                    yield from close()
                    numbers, held, sequences, chars, closed, done = {}, [], [], 0, closed + 1, i + 1
                    give_back()
            if done < batch.num_rows:
                held.append(rest.slice(done))
        if held:
            yield from close()
        numbers, held, sequences = {}, [], []
        give_back()

    return run


def _encode_words(vocabulary: str, pattern: str):
    """Word lists to lists of ids: the words of a bucket meet in one task, which encodes each once."""

    def run(batches):
        encode = _encoding(vocabulary, pattern)._encode_single_piece
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            blocks, buckets, packs = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("bpe_block", "bpe_bucket", "bpe_packed"))
            out = []
            for packed in packs:
                sizes, flat = _unpack(packed)
                ids: list[int] = []
                counts, at = [], 0
                for end in np.cumsum(_numbers(sizes)).tolist():
                    word, at = flat[at:end], end
                    if (made := known.get(word)) is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        made = known[word] = encode(word)
                    ids += made
                    counts.append(len(made))
                out.append(_pack(_short(np.array(counts, np.int64)), _short(np.array(ids, np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.string()), pa.array(buckets, pa.int32()), pa.array(out, pa.binary())], names=["bpe_block", "bpe_bucket", "bpe_ids"])
        known.clear()
        give_back()

    return run


def _assemble(decoder: str | None):
    """The documents of a block with their ids, put together by position from the ids of its words.

    With the vocabulary ``decoder``, also with the bytes that the ids decode to.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = _assembled(left, right, decoder)
        give_back()
        return made

    return run


def _assembled(left: pa.Table, right: pa.Table, decoder: str | None) -> pa.Table:
    docs = left.filter(pc.equal(left["bpe_bucket"], _DOCUMENT))
    docs = docs.take(pc.sort_indices(docs["bpe_row"]))
    (whole,) = left.filter(pc.equal(left["bpe_bucket"], _SEQUENCES))["bpe_packed"].to_pylist()
    lengths, sequence, buckets, sizes, dealt = _unpack(whole)
    numbers = dict(zip(_numbers(buckets).tolist(), np.split(_long(dealt), np.cumsum(_numbers(sizes))[:-1]), strict=True)) if buckets else {}
    lists = {b: [_long(x) for x in _unpack(p)] for b, p in zip(right["bpe_bucket"].to_pylist(), right["bpe_ids"].to_pylist(), strict=True)}
    if numbers.keys() != lists.keys():
        raise RuntimeError("the words of a block didn't come back: its documents were read in another order")
    counts = np.zeros(sum(map(len, numbers.values())), np.int64)
    for b, (count, _) in lists.items():
        counts[numbers[b]] = count
    offsets = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(offsets[-1], np.int32)
    for b, (count, ids) in lists.items():
        flat[np.repeat(offsets[numbers[b]] - np.cumsum(count) + count, count) + np.arange(len(ids))] = ids
    values, ends, at = [np.zeros(0, np.int32)], [0], 0
    places = _long(sequence)
    for n in _numbers(lengths).tolist():
        ids, _ = _gather(flat, offsets, places[at : at + n])
        values.append(ids)
        ends.append(ends[-1] + len(ids))
        at += n
    made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))
    digests = [hashlib.sha256(v.astype("<u4").tobytes()).hexdigest() for v in values[1:]]
    made_columns = {"ids": made, "n_tokens": pc.cast(pc.list_value_length(made), pa.int64()), "ids_sha256": pa.array(digests, pa.string())}
    if decoder:
        made_columns["decoded"] = pa.array([_bytes_of(v, decoder) for v in values[1:]], pa.binary())
    docs = docs.drop_columns(_BLOCK.names)
    for name, column in made_columns.items():
        docs = docs.append_column(name, column)
    return docs


def _bytes_of(ids: np.ndarray, vocabulary: str) -> bytes:
    flat, offsets = _token_bytes(vocabulary)
    return _gather(flat, offsets, ids.astype(np.int64))[0].tobytes()


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", decoded: bool = False, ordered: bool = True) -> DataFrame:
    """``df`` without its ``text``, with ``ids`` (array of int): its byte-level BPE token ids, no special ones.

    And n_tokens, and ids_sha256: the SHA-256 of the ids as little-endian unsigned 32-bit numbers. With
    ``decoded``, the ids are decoded in the same pass, as :func:`decode` does, to the column ``decoded``.

    ``vocabulary`` is the place of a file of tiktoken ranks; each match of ``pattern`` is encoded by
    itself. Null and empty texts have no ids. Pre-tokens are listed with their positions for each block of
    documents, so that a word, however common, goes once from each block to the task of its hash, and by no
    way round; ids come back to the block. Rows are told apart by their place in the block, not by any key: repeated rows and
    null keys come back each time. A text of any length is whole in its block; an empty table gives an empty
    one. Columns of ``df`` named like a result or like a column of blocks are replaced.

    The rows of ``df`` must come in the same order if they are read again for a lost executor, as from files:
    else the blocks' names differ and the run stops. Rows that come out of a shuffle don't; without ``ordered``,
    those of each partition are first sorted by a hash of all their columns.
    """
    more = [T.StructField("decoded", T.BinaryType())] if decoded else []
    docs = without(df, ["ids", "n_tokens", "ids_sha256", *_BLOCK.names, *(f.name for f in more)])
    if not ordered:
        docs = docs.sortWithinPartitions(F.xxhash64(*[f"`{c}`" for c in docs.columns]))
    kept = [T.StructField(f.name, f.dataType) for f in docs.schema.fields if f.name != text]
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exploded = docs.mapInArrow(_explode(pattern, docs.columns.index(text), buckets), T.StructType(kept + _BLOCK.fields)).repartition("bpe_to")
    # One exchange takes the lists to their buckets and the rest to the blocks. Both its readers get all columns, and filters
    # that Spark can't move below it, so that it is reused; and the blocks' reader keeps its partitions.
    lists, rest = (exploded.where(f"bpe_bucket {x} 0 OR monotonically_increasing_id() < 0") for x in (">=", "<"))
    words = lists.mapInArrow(_encode_words(vocabulary, pattern), "bpe_block string, bpe_bucket int, bpe_ids binary")
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), *more])
    return rest.groupBy("bpe_to").cogroup(words.groupBy("bpe_block")).applyInArrow(_assemble(vocabulary if decoded else None), schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary): the token bytes of each row's ``ids``, joined by position.

    The token-byte table has one entry an id, some 50,000, and is read by each Python worker. No ids (or
    null) give no bytes; an id that the table lacks is an error.
    """
    kept = without(df, ["decoded"])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            made = [_bytes_of(values[a:b], vocabulary) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` without its text, with n_tokens, ids_sha256 and decoded_sha256 (of the bytes that the ids decode to)."""
    small_batches(df.sparkSession)
    both = encode(df, vocabulary, pattern, text, decoded=True)
    return both.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("ids", "decoded")
