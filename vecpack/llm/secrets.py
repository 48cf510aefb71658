"""Secret scans: fixed patterns, then strings that a tokenizer's vocabulary packs badly."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vecpack.llm.common import with_python_columns

KINDS = ("assign", "access", "hex", "packed")

# The patterns of the base kinds and the least sizes of what they must have found.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Runs that can be a key: long, in an alphabet of keys.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
#: Parts of a run: words by case, numbers; a linear scan, with no choice to come back to.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
SEPARATOR = re.compile(r"[_/+=-]+")


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base kinds, in code points, by start and kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_identifier(run: str, encode, ratio: float) -> bool:
    """Words joined by separators or a change of case, each with a number of up to four digits at most after it.

    The words, by themselves, must pack well into tokens: more than ``ratio`` characters each. One linear scan.
    """
    words = []
    for piece in SEPARATOR.split(run):
        parts = PART.findall(piece)
        if not parts:
            continue
        for before, part in zip(["", *parts], parts, strict=False):
            if part.isdigit():
                if len(part) > 4:
                    return False
            elif before.isdigit() and not (part[0].isupper() and part[-1].islower()):
                return False
            else:
                words.append(part)
    if len(words) < 2 or any(len(w) < 2 for w in words):
        return False
    return sum(map(len, words)) > ratio * sum(len(encode(w.lower())) for w in words)


def is_known(run: str, encode, ratio: float) -> bool:
    """Numbers, whole digests, UUIDs and identifiers of words that pack well are no secrets, however badly the run packs."""
    body = run.strip("=-_/+")
    if re.fullmatch(r"[0-9_/+=-]*", body):
        return True
    if len(body) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
        return True
    return bool(UUID.fullmatch(body)) or is_identifier(run, encode, ratio)


def packed_spans(text: str, encode, ratio: float) -> list[tuple[int, int, int]]:
    """Candidate runs with at most ``ratio`` characters a token that aren't known to be harmless."""
    return [(m.start(), 3, m.end()) for m in CANDIDATE.finditer(text) if len(m[0]) <= ratio * len(encode(m[0])) and not is_known(m[0], encode, ratio)]


def scan(text: str | None, encode, ratio: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans); a run that lies in a base span or holds one isn't reported again."""
    if not text:
        return [], []
    base = base_spans(text)
    starts, reached = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
    before = [(s, bisect_left(starts, s[2])) for s in packed_spans(text, encode, ratio)]  # base spans that begin before its end
    return base, sorted(base + [s for s, n in before if not n or reached[n - 1] <= s[0]])


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ratio: float = 2.0) -> DataFrame:
    """``df`` without its ``text``, with n_assign, n_access, n_hex, base_sha256 and spans (``kind:start:end``, comma-joined).

    ``vocabulary`` is the place of a file of tiktoken ranks. Null and empty texts have no spans (and the
    digest of the empty string); whole texts are scanned, repeated rows alike; columns of ``df`` named
    like a result are replaced. One pass, no shuffle: memory is one Arrow batch.
    """

    def compute(texts):
        encode = _encoding(vocabulary, pattern).encode_ordinary
        out = [[], [], [], [], []]
        for t in texts:
            base, spans = scan(t, encode, ratio)
            for k in range(3):
                out[k].append(sum(s[1] == k for s in base))
            out[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out[4].append(_joined(spans))
        return out

    fields = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    return with_python_columns(df, [text], compute, fields, drop=(text,))
