"""Language identification by fusing evidence: text, declared language, address, and what the host else has."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecpack.llm.common import checkpointed, hinted, with_python_columns, without

#: Labelled rows from which the text model is fitted, at most: those of least key hash of all, and of each label.
SAMPLE_ROWS, LABEL_ROWS = 2000, 500
#: Slots of the table of byte trigrams.
SLOTS = 1 << 17

#: How often a declaration or an address names the language that a page has, and how much one page's text can say.
DECLARED_RIGHT, ADDRESS_RIGHT = 0.9, 0.8
#: Pages that a level's prior counts for, against its parent's.
PRIOR_WEIGHT = 10.0
#: Trigrams after which more text says nothing more: neighbouring ones aren't independent.
MOST_EVIDENCE = 200.0
#: Least share of trigrams that the best language has seen, for the text to be in any of them.
LEAST_KNOWN = 0.25

_LETTERS = re.compile(r"[^\W\d_]")
_ADDRESS = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)")
# Each looks at one tag, and what isn't closed ends with the page: linear in the page's length.
_MARKUP = re.compile(r"""<html\b[^<>]*?\slang\s*=\s*["']?([A-Za-z]+)|<meta\b[^<>]*?content-language["']?\s+content\s*=\s*["']?([A-Za-z]+)""", re.I)
_TAGS = re.compile(r"<(script|style)\b.*?(?:</\1>|\Z)|<!--.*?(?:-->|\Z)|<[a-z/!?][^>]*(?:>|\Z)", re.S | re.I)
_CODE = re.compile(r"([a-z]{2})(?:[-_][a-z]{2})?")

#: The main language of a country suffix; others, and suffixes used all over the world, say nothing.
COUNTRY_LANGUAGE = {
    "at": "de", "de": "de", "li": "de", "ar": "es", "bo": "es", "cl": "es", "cr": "es", "cu": "es", "do": "es", "ec": "es", "es": "es", "gt": "es", "hn": "es", "mx": "es", "ni": "es", "pa": "es", "pe": "es", "py": "es", "sv": "es", "uy": "es", "ve": "es",
    "fr": "fr", "mc": "fr", "sn": "fr", "ao": "pt", "br": "pt", "mz": "pt", "pt": "pt", "au": "en", "gb": "en", "ie": "en", "nz": "en", "uk": "en", "us": "en", "it": "it", "sm": "it", "nl": "nl", "pl": "pl", "ru": "ru", "by": "ru", "ua": "uk", "cz": "cs", "sk": "sk",
    "hu": "hu", "ro": "ro", "bg": "bg", "gr": "el", "tr": "tr", "dk": "da", "se": "sv", "no": "no", "fi": "fi", "is": "is", "ee": "et", "lv": "lv", "lt": "lt", "hr": "hr", "rs": "sr", "si": "sl", "al": "sq", "jp": "ja", "cn": "zh", "tw": "zh", "hk": "zh", "kr": "ko",
    "vn": "vi", "th": "th", "id": "id", "ir": "fa", "il": "he", "sa": "ar", "eg": "ar", "ae": "ar", "ma": "ar", "dz": "ar", "tn": "ar", "iq": "ar", "jo": "ar", "kw": "ar", "lb": "ar", "qa": "ar", "sy": "ar", "ye": "ar",
}


def trigrams(text: str) -> np.ndarray:
    """Slots of the byte trigrams of a text's words, in lower case, each between spaces."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    raw = np.frombuffer((" " + " ".join(words) + " ").encode(), np.uint8).astype(np.uint32)
    if not words or len(raw) < 3:
        return np.zeros(0, np.int64)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(15)).astype(np.int64)


@dataclass
class TextModel:
    """Log probabilities of trigram slots by language, with one added to every count."""

    languages: list[str]
    logs: np.ndarray  # SLOTS x languages
    seen: np.ndarray  # SLOTS x languages

    @staticmethod
    def of(counts: dict[str, np.ndarray]) -> TextModel:
        languages = sorted(counts)
        table = np.stack([counts[x] for x in languages], axis=1).astype(np.float64) if languages else np.zeros((SLOTS, 0))
        return TextModel(languages, np.log((table + 1) / (table.sum(axis=0) + SLOTS)).astype(np.float32), table > 0)

    def score(self, text: str | None) -> tuple[list[float], float]:
        """Log likelihood of each language, of at most MOST_EVIDENCE trigrams' worth; share known to the best."""
        slots = trigrams(text) if text else np.zeros(0, np.int64)
        if not len(slots) or not self.languages:
            return [0.0] * len(self.languages), 0.0
        total = self.logs[slots].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return (total * (min(len(slots), MOST_EVIDENCE) / len(slots))).tolist(), float(self.seen[slots, best].mean())


def _least_of_each(hashed: DataFrame, rows: int) -> list[tuple]:
    """(label, key) of (label, key, h), distinct, with the ``rows`` least hashes of each label; no label is gathered in a task.

    Hashes are even, so some twice as many as are wanted lie below a bound that follows from the label's count.
    """
    enough = 2 * rows + 64
    sizes = hashed.groupBy("label").agg(F.count("*").alias("n"), F.min("h").alias("least"))
    share = (F.lit(-(2.0**63)) + F.lit(2.0**64) * (enough / F.col("n"))).cast("long")
    bounds = sizes.select("label", F.when(F.col("n") <= enough, F.lit(2**63 - 1)).otherwise(F.greatest("least", share)).alias("bound"))
    by_label: dict[str, list] = {}
    for label, key, h in hashed.join(F.broadcast(bounds), "label").where("h <= bound").select("label", "key", "h").collect():
        by_label.setdefault(label, []).append((h, key))
    return [(label, key) for label, found in by_label.items() for _, key in sorted(found)[:rows]]


def sample(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", rows: int = SAMPLE_ROWS, label_rows: int = LABEL_ROWS) -> DataFrame:
    """(label, text): the labelled rows of the least key hashes, ``rows`` of all and ``label_rows`` of each label, at most.

    Rows equal in key and label are one, that of the least text hash, and combine before they are sent. So the sample
    has ``rows`` rows and ``label_rows`` times the labels at most, however often rows are repeated. Its keys go to the driver.
    """
    good = labelled.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(text).isNotNull())
    hashed = good.select(F.col(label).alias("label"), F.col(key).alias("key"), F.xxhash64(key).alias("h")).distinct()
    pairs = {(r[0], r[1]) for r in hashed.orderBy("h", "key", "label").limit(rows).collect()} | set(_least_of_each(hashed, label_rows))
    # As an Arrow table: a list of rows would start Python workers of its own on the executors.
    wanted = labelled.sparkSession.createDataFrame(pa.table({"label": pa.array([p[0] for p in sorted(pairs)], pa.string()), "key": pa.array([p[1] for p in sorted(pairs)], None if pairs else pa.null())}))
    wanted = wanted.select("label", F.col("key").cast(labelled.schema[key].dataType).alias("key"))
    found = good.select(F.col(label).alias("label"), F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(wanted), ["label", "key"], "left_semi")
    return found.groupBy("label", "key").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", rows: int = SAMPLE_ROWS, label_rows: int = LABEL_ROWS) -> TextModel:
    """A model of the :func:`sample`, in which every label has a class, however rare.

    All tasks look for the sample's rows; one task, after the shuffle, counts the rows found, whose number is
    bounded. The counts go to the driver, one table a language.
    """

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = tables.setdefault(language, np.zeros(SLOTS, np.int64))
                table += np.bincount(trigrams(t), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.string()), pa.array([t.astype("<i8").tobytes() for t in tables.values()], pa.binary())], names=["label", "counts"])

    counted = sample(labelled, key, text, label, rows, label_rows).repartition(1).mapInArrow(count, "label string, counts binary").collect()
    return TextModel.of({r["label"]: np.frombuffer(r["counts"], "<i8") for r in counted})


def declared_language(html: str | None) -> str | None:
    """The language of the html element or of a content-language meta element, in lower case."""
    found = _MARKUP.search(html) if html else None
    return (found[1] or found[2]).lower() if found else None


def address(url: str | None) -> tuple[str, str, str | None]:
    """(host, its last two labels, the language that the path's first part, the host's first label or its country names)."""
    found = _ADDRESS.match(url) if url else None
    if not found:
        return "", "", None
    labels = found[1].lower().split(".")
    first = found[2].split("/", 2)[1].lower() if found[2].count("/") else ""
    named = (_CODE.fullmatch(x) for x in (first, labels[0] if len(labels) > 1 else ""))
    code = next((m[1] for m in named if m), COUNTRY_LANGUAGE.get(labels[-1]))
    return ".".join(labels), ".".join(labels[-2:]), code


def page_text(html: str | None) -> str | None:
    """What a page has between its tags, character references decoded."""
    return unescape(_TAGS.sub(" ", html)) if html else None


def _evidence(model: TextModel, texts, declarations, codes) -> tuple[list, list]:
    """Log likelihoods of text, declaration and address by language, and the share of trigrams known, of each row."""
    n, logs, known = max(len(model.languages), 2), [], []
    for t, *said in zip(texts, declarations, codes, strict=True):
        row, share = model.score(t)
        for code, right in zip(said, (DECLARED_RIGHT, ADDRESS_RIGHT), strict=True):
            if code is not None and (code := code.lower()) in model.languages:
                row = [x + math.log(right if code == language else (1 - right) / (n - 1)) for x, language in zip(row, model.languages, strict=True)]
        logs.append(row)
        known.append(share)
    return logs, known


def _normal(logs: Column) -> Column:
    """Probabilities in proportion to the exponentials."""
    exps = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda s, y: s + y))


def _smoothed(sums: Column, rows: Column, parent: Column) -> Column:
    """Shares of a level: (its sums + PRIOR_WEIGHT times the parent's shares) over (its rows + PRIOR_WEIGHT)."""
    return F.zip_with(sums, parent, lambda s, p: (s + PRIOR_WEIGHT * p) / (rows + PRIOR_WEIGHT))


def _fused(scored: DataFrame, languages: list[str], names: list[str]) -> DataFrame:
    """The columns ``names`` of ``scored`` with lid_lang, lid_score and lid_kept.

    The sums of the rows' own probabilities are grouped by host, by domain and at all. A row's prior is its
    host's share without the row itself, smoothed by its domain's, which all rows' smooth. One row of sums
    goes to the driver; host sums are broadcast if their table, counted, is small, and else joined, where a
    host that has many rows is split.
    """
    n = len(languages)
    own = scored.where("lid_known > 0")
    hosts = own.groupBy("lid_domain", "lid_host").agg(F.count("*").alias("h_rows"), *[F.sum(F.col("lid_own")[i]).alias(f"h{i}") for i in range(n)])
    hosts = checkpointed(hosts.select("lid_domain", "lid_host", "h_rows", F.array(*[f"h{i}" for i in range(n)]).alias("h_sums")))
    by_domain = hosts.groupBy("lid_domain").agg(F.sum("h_rows").alias("d_rows"), *[F.sum(F.col("h_sums")[i]).alias(f"d{i}") for i in range(n)])
    domains = by_domain.select("lid_domain", "d_rows", F.array(*[f"d{i}" for i in range(n)]).alias("d_sums"))
    total = hosts.agg(F.coalesce(F.sum("h_rows"), F.lit(0)).alias("rows"), *[F.coalesce(F.sum(F.col("h_sums")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n)]).first()
    top = F.array(*[F.lit((total[f"s{i}"] + PRIOR_WEIGHT / n) / (total["rows"] + PRIOR_WEIGHT)) for i in range(n)])
    levels = hosts.join(domains, "lid_domain")
    joined = scored.join(hinted(levels, hosts.count(), 128 + 16 * n), ["lid_domain", "lid_host"], "left")

    def others(sums: str) -> Column:
        return F.zip_with(sums, "lid_own", lambda s, o: F.greatest(s - o, F.lit(0.0)))

    middle = _smoothed(others("d_sums"), F.col("d_rows") - 1, top)
    prior = F.when(F.col("lid_known") > 0, _smoothed(others("h_sums"), F.col("h_rows") - 1, middle)).otherwise(top)
    fused = joined.withColumn("lid_all", _normal(F.zip_with("lid_logs", prior, lambda x, p: x + F.ln(p)))).withColumn("lid_kept", F.col("lid_known") >= LEAST_KNOWN)
    score = F.array_max("lid_all")
    best = F.element_at(F.array(*map(F.lit, languages)), F.array_position("lid_all", score).cast("int"))
    return fused.select(*[f"`{c}`" for c in names], F.when(F.col("lid_kept"), best).otherwise("und").alias("lid_lang"), F.when(F.col("lid_kept"), score).otherwise(0.0).alias("lid_score"), "lid_kept")


def identify(df: DataFrame, model: TextModel, inputs: list[str], read) -> DataFrame:
    """``df`` without its columns ``inputs``, with lid_lang, lid_score (its probability) and lid_kept.

    ``read(*lists)`` makes of the inputs' values lists of texts, declared languages, address languages,
    domains and hosts. The probability of a language is in proportion to text, declaration and address
    likelihoods and the host's prior. A row is rejected, its language ``und``, if its text has no letters,
    or if even the best language knows less than LEAST_KNOWN of its trigrams. Null and empty texts have no
    letters; a null declaration, address or host says nothing (its host is the empty one); a model without
    languages rejects all, and an empty table gives an empty one. Whole texts are scored, of any length.
    Repeated rows are judged alike; of equal probabilities the first language by name counts. Columns of
    ``df`` named like a result are replaced.

    Texts are scored once, in batches, and don't come back from the worker: what is checkpointed is a row's
    other columns and its likelihoods, and these meet the priors.
    """
    kept = without(df, ["lid_lang", "lid_score", "lid_kept"])
    if not model.languages:
        return kept.drop(*inputs).withColumns({"lid_lang": F.lit("und"), "lid_score": F.lit(0.0), "lid_kept": F.lit(False)})
    names = [c for c in kept.columns if c not in inputs]
    plain = kept.select(*[F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(names)], *[F.col(f"`{c}`").alias(f"of{i}") for i, c in enumerate(inputs)])
    fields = [T.StructField("lid_logs", T.ArrayType(T.DoubleType())), T.StructField("lid_known", T.DoubleType()), T.StructField("lid_domain", T.StringType()), T.StructField("lid_host", T.StringType())]

    def compute(*columns):
        texts, declarations, codes, domains, hosts = read(*columns)
        return [*_evidence(model, texts, declarations, codes), domains, hosts]

    of = [f"of{i}" for i in range(len(inputs))]
    scored = checkpointed(with_python_columns(plain, of, compute, fields, drop=tuple(of)).withColumn("lid_own", _normal(F.col("lid_logs"))))
    back = [f"in{i}" for i in range(len(names))]
    return _fused(scored, model.languages, back).withColumnsRenamed(dict(zip(back, names, strict=True)))


def identify_documents(docs: DataFrame, model: TextModel, text: str = "text", source: str = "source") -> DataFrame:
    """Documents, without ``text`` and ``source``: ``source`` is the host; they have no markup and no address.

    Their column ``lang`` isn't evidence: it is the label that the model is fitted on.
    """

    def read(texts, sources):
        hosts = [s or "" for s in sources]
        return texts, [None] * len(texts), [None] * len(texts), hosts, hosts

    return identify(docs, model, [text, source], read)


def identify_pages(pages: DataFrame, model: TextModel, html: str = "html", url: str = "url") -> DataFrame:
    """Pages, without ``html`` and ``url``: the markup's declaration, the address's host and language, the text between tags."""

    def read(pages, urls):
        parts = [address(u) for u in urls]
        return map(page_text, pages), map(declared_language, pages), [p[2] for p in parts], [p[1] for p in parts], [p[0] for p in parts]

    return identify(pages, model, [html, url], read)
