"""Repeated runs of lines, found by winnowing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecpack.llm.common import checkpointed, fresh, hinted, without

_SPACES = "\t\r\x0b\x0c"


def _plain(line: Column) -> Column:
    return F.trim(F.translate(line, _SPACES, " " * len(_SPACES)))


def repeated_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 50) -> DataFrame:
    """(doc_key, tag, first, last): the runs of lines, from 0, that ``df`` has had before; disjoint in a document.

    A run is consecutive lines (those without words don't count) of together ``least`` words or more. It
    is repeated if the same lines stand in a row earlier, by key, text hash ``tag`` and line number. Lines
    are equal if they are so without the white space at their ends, one white space character for another.

    Winnowing: the windows of a line are the shortest runs from it on and back to it of ``least`` words; the
    smallest line hash in a window is its fingerprint, and equal windows can't but have equal ones. A
    fingerprint is a place: document and line. Windows whose fingerprint stands at one place only are done.
    From the others the match is extended from the fingerprint to both ends of the window: a window meets the
    earliest place where all of its lines are the same. Extended further, over windows that overlap, matches
    grow to whole runs, whichever earlier document each part is equal to. So a hot line costs a row for each
    window that it marks, and no pairs of places are made.

    A row that is repeated combines with its copies before anything is sent; the tables that places are
    joined with are counted, and broadcast or else joined where a hot fingerprint's partition can be split.
    A text of any length is one row a line; no list grows beyond one window's lines.
    """
    source = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = df.select(F.col(f"`{key}`").alias("doc_key"), F.xxhash64(source).alias("tag"), F.posexplode(F.split(source, "\n")).alias("pos", "line"))
    plain = _plain(F.col("line"))
    counted = lines.select("doc_key", "tag", "pos", F.unhex(F.md5(plain)).alias("h"), F.size(F.array_remove(F.split(plain, " "), "")).cast("long").alias("n")).where("n > 0")
    doc = ["doc_key", "tag"]
    before = W.partitionBy(*doc).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    placed = counted.distinct().withColumn("s", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("e", F.col("s") + F.col("n"))
    ahead = W.partitionBy(*doc).orderBy("s").rangeBetween(0, least - 1)
    back = W.partitionBy(*doc).orderBy("e").rangeBetween(1 - least, 0)

    def window(frame) -> Column:
        """Fingerprint, digest and ends of a run of enough words."""
        digest = F.unhex(F.md5(F.concat_ws("", F.transform(F.collect_list("h").over(frame), F.hex))))
        return F.when(F.sum("n").over(frame) >= least, F.struct(F.min(F.struct("h", "pos")).over(frame).alias("print"), digest.alias("gram"), F.min("pos").over(frame).alias("a"), F.max("pos").over(frame).alias("b")))

    spans = checkpointed(placed.select(*doc, window(ahead).alias("ahead"), window(back).alias("back")).where("ahead IS NOT NULL OR back IS NOT NULL"))
    windows = spans.select(*doc, F.explode(F.array_distinct(F.array("ahead", "back"))).alias("w")).where("w IS NOT NULL").select(*doc, "w.print", "w.gram", "w.a", "w.b")
    places = windows.select(*doc, F.col("print.h").alias("h"), F.col("print.pos").alias("pos")).distinct()
    shared = checkpointed(places.groupBy("h").agg(F.count("*").alias("places")).where("places > 1").select("h"))
    marked = windows.withColumn("h", F.col("print.h")).join(hinted(shared, shared.count(), 100), "h", "left_semi").select(*doc, "gram", "a", "b")

    place = F.struct("doc_key", "tag", "a")
    earliest = checkpointed(marked.groupBy("gram").agg(F.count("*").alias("times"), F.min(place).alias("place")).where("times > 1").select("gram", "place"))
    later = marked.join(hinted(earliest, earliest.count(), 200), "gram").where(place > F.col("place")).select(*doc, "a", "b")

    order = W.partitionBy(*doc).orderBy("a", "b")
    reached = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = later.withColumn("opens", F.when(F.col("a") <= reached, 0).otherwise(1))
    return opens.withColumn("island", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy(*doc, "island").agg(F.min("a").alias("first"), F.max("b").alias("last")).drop("island")


def cut_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 50, n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """``df``, all its columns, with the later repeated runs of lines cut from ``text``; the counts only where named.

    The runs of a document are joined to its text by a broadcast where their table, counted, is small: then
    no text is shuffled, and one without runs isn't even split.
    """
    runs = repeated_runs(df, key, text, least)
    cut_key, cut_tag, cut = fresh(df, "cut_key", "cut_tag", "cut_runs")
    cuts = checkpointed(runs.groupBy("doc_key", "tag").agg(F.collect_list(F.struct("first", "last")).alias("runs"))).toDF(cut_key, cut_tag, cut)
    size = cuts.agg(F.count("*"), F.coalesce(F.sum(F.size(cut)), F.lit(0))).first()
    source = F.col(f"`{text}`")
    joined = df.join(hinted(cuts, 200 * size[0] + 32 * size[1], 1), F.col(f"`{key}`").eqNullSafe(F.col(cut_key)) & (F.xxhash64(F.coalesce(source, F.lit(""))) == F.col(cut_tag)), "left")
    kept = F.filter(F.split(source, "\n"), lambda _, i: ~F.exists(cut, lambda r: (i >= r["first"]) & (i <= r["last"])))
    removed = F.coalesce(F.aggregate(cut, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1), F.lit(0))
    lines = F.coalesce(F.octet_length(source) - F.octet_length(F.replace(source, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    counts = [c.cast("long").alias(n) for c, n in ((lines, n_lines), (removed, n_removed)) if n is not None]
    return joined.select(*[F.when(F.col(cut).isNull(), source).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns], *counts)


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 50) -> DataFrame:
    """``df`` with the later repeated runs of lines cut from ``text``, and n_lines and n_removed.

    See :func:`repeated_runs`. Lines without words stay unless they stand inside a cut run. Null texts stay
    null, with no lines; a text that is nothing but repeated runs becomes empty. Rows equal in key and text
    count as one document and come back each time, cut alike; null keys come first. An empty table gives an
    empty one. Columns of ``df`` named like a result are replaced; all others come back as they were.
    """
    return cut_runs(without(df, ["n_lines", "n_removed"]), key, text, least, "n_lines", "n_removed")
