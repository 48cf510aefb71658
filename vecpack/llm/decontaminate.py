"""Benchmark decontamination by a positional inverted index of the training words, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecpack.llm.common import checkpointed

#: Benchmark terms up to this number are sent to all executors; more are joined by a shuffle.
MAX_BROADCAST_TERMS = 200_000

#: The bit of an exact occurrence, above those of the list terms.
_EXACT = 1 << 30

_UPPER = "".join(map(chr, range(0x41, 0x5B)))
_SEPARATORS = "".join(chr(i) for i in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)] if i != 0x20)


def words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased; none of null."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _SEPARATORS, _UPPER.lower() + " " * len(_SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


class PositionalIndex:
    """Postings (term, document, position) of the terms by which a benchmark's windows can be found.

    A window is ``size`` consecutive words of an item (a shorter item is one window). For each window the
    ``lists`` terms that are rarest in the training texts are its list terms; only their postings are
    stored, as no other list is ever read. A posting keeps the words around it, for what the lists leave
    open. A document is known by its key and its text's hash: rows equal in both share their postings.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 13, lists: int = 3):
        self.size = size
        source = F.col(f"`{text}`")
        self.docs = docs.select(F.col(f"`{key}`").alias("doc_key"), F.xxhash64(source).alias("tag"), words(source).alias("words"))
        items = benchmark.select(F.col(f"`{item}`").alias("item"), words(F.col(f"`{item_text}`")).alias("words")).where(F.size("words") > 0)
        starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
        cut = items.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), size).alias("window"))
        #: (row, item, phrase, window): which items have which windows.
        self.of_item = checkpointed(cut.select(F.monotonically_increasing_id().alias("row"), "item", F.array_join("window", " ").alias("phrase"), "window"))
        windows = self.of_item.groupBy("phrase", "window").agg(F.min("row").alias("wid"))
        terms = windows.select("wid", "phrase", F.size("window").alias("length"), F.posexplode("window").alias("offset", "term"))
        vocabulary = terms.select("term").distinct()
        counted = self._meet(self.docs.select(F.explode("words").alias("term")), vocabulary).groupBy("term").count()
        rarest = W.partitionBy("wid").orderBy("count", "offset")
        # A window with a term that no text has can't occur: the inner join leaves it short of terms.
        known = terms.join(counted, "term").withColumn("rank", F.row_number().over(rarest) - 1).withColumn("found", F.count("*").over(W.partitionBy("wid")))
        #: (term, wid, phrase, offset, rank, length, full): the list terms of each window, rarest first.
        self.list_terms = checkpointed(rows=lists * windows.count(), df=known.where((F.col("found") == F.col("length")) & (F.col("rank") < lists)).select("term", "wid", "phrase", "offset", "rank", "length", (F.call_function("shiftleft", F.lit(1), F.least("length", F.lit(lists))) - 1).alias("full")))
        self.postings = self._store()

    @staticmethod
    def _meet(large: DataFrame, small: DataFrame) -> DataFrame:
        """Join on term; the small side is broadcast only where its rows, counted, are few."""
        return large.join(F.broadcast(small) if small.count() <= MAX_BROADCAST_TERMS else small, "term")

    def _store(self) -> DataFrame:
        """(doc_key, tag, n_words, term, pos, first, around); the empty term, at 0, stands for each row itself."""
        empty = self.docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).alias("rank"))
        wanted = self.list_terms.groupBy("term").agg(F.min("rank").alias("rank")).unionByName(empty)
        spread = self.docs.select("doc_key", "tag", F.concat(F.array(F.lit("")), "words").alias("padded")).select("doc_key", "tag", "padded", F.posexplode("padded").alias("pos", "term"))
        first = F.greatest(F.col("pos") - (self.size - 1), F.lit(1))
        around = F.when(F.col("rank") == 0, F.slice("padded", first + 1, 2 * self.size - 1))
        return checkpointed(self._meet(spread, wanted).select("doc_key", "tag", (F.size("padded") - 1).alias("n_words"), "term", "pos", first.alias("first"), around.alias("around")))

    def documents(self) -> DataFrame:
        """(doc_key, tag, n_words) of each row."""
        return self.postings.where("term = ''").select("doc_key", "tag", "n_words")

    def _shifted(self) -> DataFrame:
        """(doc_key, tag, wid, start, bits): postings shifted by their term's offset, to where the window would start.

        ``bits`` has the term's rank, and _EXACT where the words around the rarest term are the phrase.
        """
        joined = self._meet(self.postings.where("term <> ''"), self.list_terms)
        start = F.col("pos") - F.col("offset")
        there = F.array_join(F.slice("around", start - F.col("first") + 1, F.col("length")), " ") == F.col("phrase")
        bit = F.call_function("shiftleft", F.lit(1), F.col("rank"))
        return joined.where(start >= 1).select("doc_key", "tag", "wid", start.alias("start"), F.when(F.coalesce(there, F.lit(False)), bit.bitwiseOR(_EXACT)).otherwise(bit).alias("bits"), (F.col("rank") == 0).alias("is_rarest"))

    def _whole(self, lists: DataFrame, bits: int = 0) -> DataFrame:
        """``lists`` that have all of their window's bits (and ``bits``), with its phrase and length."""
        windows = self.list_terms.select("wid", "phrase", "length", "full").distinct()
        small = windows.count() <= MAX_BROADCAST_TERMS
        wanted = F.col("full").bitwiseOR(bits)
        return lists.join(F.broadcast(windows) if small else windows, "wid").where(F.col("bits").bitwiseAND(wanted) == wanted)

    def phrases(self) -> DataFrame:
        """(doc_key, tag, phrase, start, length): exact occurrences, from 1; repeated rows give them once."""
        useful = self._shifted().where(~F.col("is_rarest") | (F.col("bits") >= _EXACT))
        lists = useful.groupBy("doc_key", "tag", "wid", "start").agg(F.bit_or("bits").alias("bits"))
        return self._whole(lists, _EXACT).select("doc_key", "tag", "phrase", "start", "length")

    def proximity(self, slop: int) -> DataFrame:
        """(doc_key, tag, phrase, start): the list terms, each shifted, lie within ``slop`` words of the rarest."""
        near = W.partitionBy("doc_key", "tag", "wid").orderBy("start").rangeBetween(-slop, slop)
        lists = self._shifted().withColumn("bits", F.bit_or("bits").over(near)).where("is_rarest")
        return self._whole(lists).select("doc_key", "tag", "phrase", "start").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 13, share: int = 20) -> DataFrame:
    """(key, tag, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    A word is hit if it lies in an occurrence of a window; a document is contaminated if a word is hit and
    ``share`` times the hit words are at least its words. Null and empty texts have no words and no hits;
    items without words have no windows; either table may be empty. Items of equal ids are one; one without an id
    counts in n_items, once, and isn't in the digest. Texts of any length are whole. Rows with null or equal keys are told
    apart by ``tag``, the text's hash, and repeated rows come back each time. Other columns aren't used.
    """
    index = PositionalIndex(docs, benchmark, key, text, item, item_text, size)
    found = index.phrases()
    doc = ["doc_key", "tag"]
    before = W.partitionBy(*doc).orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    places = found.select(*doc, "start", "length").distinct()
    hit = places.withColumn("reached", F.max(end).over(before)).groupBy(*doc).agg(F.sum(F.greatest(end - F.greatest("start", F.coalesce("reached", F.col("start"))), F.lit(0))).cast("long").alias("n_hit"))
    with_items = found.select(*doc, "phrase").distinct().join(index.of_item.select("phrase", F.col("item").cast("string").alias("item")), "phrase").select(*doc, "item").distinct()
    items = with_items.groupBy(*doc).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    marks = hit.join(items, (hit.doc_key.eqNullSafe(items.doc_key)) & (hit.tag == items.tag)).select(hit.doc_key, hit.tag, "n_hit", "n_items", "items")
    base = index.documents()
    all_rows = base.join(marks, base.doc_key.eqNullSafe(marks.doc_key) & (base.tag == marks.tag), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return all_rows.select(
        base.doc_key.alias(key), base.tag.alias("tag"), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
