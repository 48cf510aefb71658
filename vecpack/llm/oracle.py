"""DuckDB SQL for SimHash groups: XXH64 in whole numbers of 128 bits, then bits, links and components."""

from __future__ import annotations

# Fixed values of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SEED = 42
_ALL = "18446744073709551616::UHUGEINT"


def _n(value: int) -> str:
    return f"{value % 2**64}::UHUGEINT"


def _times(x: str, y: int) -> str:
    return f"(({x}) * {_n(y)} % {_ALL})"


def _plus(x: str, y: str) -> str:
    return f"((({x}) + ({y})) % {_ALL})"


def _let(value: str, name: str, body: str) -> str:
    """``body``, in which ``name`` stands for a value that is worked out once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _turned(x: str, by: int, name: str) -> str:
    return _let(x, name, f"({name} * {2**by}::UHUGEINT % {_ALL} + {name} // {2 ** (64 - by)}::UHUGEINT)")


def _xor(x: str, y: str) -> str:
    return f"xor(({x}), ({y}))"


def _lane(at: str, size: int) -> str:
    """The little-endian number of ``size`` bytes from byte ``at`` of the hexadecimal text ``x``."""
    digits = " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(size)))
    return f"CAST(('0x' || {digits})::UBIGINT AS UHUGEINT)"


def _round(v: str, lane: str, name: str) -> str:
    return _times(_turned(_plus(v, _times(lane, P2)), 31, name), P1)


def _after_stripes(first: str, k: int) -> str:
    """Accumulator ``k`` after all stripes of 32 bytes."""
    lanes = f"list_transform(range(size // 32), lambda s: {_lane(f'32 * s + {8 * k}', 8)})"
    return f"list_reduce(list_prepend({first}, {lanes}), lambda v, l: {_round('v', 'l', 'q')})"


def xxh64(source: str) -> str:
    """(gram, h) of a source of distinct texts ``gram``; h is unsigned."""
    starts = [_n(SEED + P1 + P2), _n(SEED + P2), _n(SEED), _n(SEED - P1)]
    merged = " + ".join(_turned(f"v{k}", by, "q") for k, by in enumerate((1, 7, 12, 18)))
    h = f"(({merged}) % {_ALL})"
    for k in range(4):
        h = _plus(_times(_xor(h, _times(_turned(_times(f"v{k}", P2), 31, "q"), P1)), P1), _n(P4))
    by8 = f"list_transform(range((size % 32) // 8), lambda s: {_lane('size // 32 * 32 + 8 * s', 8)})"
    by4 = f"list_transform(range((size % 8) // 4), lambda s: {_lane('size // 8 * 8', 4)})"
    by1 = f"list_transform(range(size % 4), lambda s: {_lane('size // 4 * 4 + s', 1)})"
    step8 = _plus(_times(_turned(_xor("h", _times(_turned(_times("l", P2), 31, "q"), P1)), 27, "q"), P1), _n(P4))
    step4 = _plus(_times(_turned(_xor("h", _times("l", P1)), 23, "q"), P2), _n(P3))
    step1 = _times(_turned(_xor("h", _times("l", P5)), 11, "q"), P1)
    return f"""
        SELECT gram, CAST({_let(_times(_let(_times(_let('h', 'z', _xor('z', f'z // {2**33}::UHUGEINT')), P2), 'z', _xor('z', f'z // {2**29}::UHUGEINT')), P3), 'z', _xor('z', f'z // {2**32}::UHUGEINT'))} AS UBIGINT) AS h
        FROM (SELECT gram, list_reduce(list_prepend(h, {by1}), lambda h, l: {step1}) AS h, x, size
        FROM (SELECT gram, list_reduce(list_prepend(h, {by4}), lambda h, l: {step4}) AS h, x, size
        FROM (SELECT gram, list_reduce(list_prepend(h, {by8}), lambda h, l: {step8}) AS h, x, size
        FROM (SELECT gram, ({_plus(f'CASE WHEN size < 32 THEN {_n(SEED + P5)} ELSE {h} END', 'CAST(size AS UHUGEINT)')}) AS h, x, size
        FROM (SELECT gram, x, size, {', '.join(f'{_after_stripes(v, k)} AS v{k}' for k, v in enumerate(starts))}
        FROM (SELECT gram, hex(encode(gram)) AS x, octet_length(encode(gram)) AS size FROM {source}))))))"""


def simhash_groups(words: int = 3, threshold: int = 2) -> str:
    """doc_id, fingerprint and component_id of the documents."""
    bits = " || ".join(f"CASE WHEN 2 * sum(h >> {b} & 1) > count(*) THEN '1' ELSE '0' END" for b in reversed(range(64)))
    return f"""
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT doc_id, array_to_string(w[i : i + {words - 1}], ' ') AS gram
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM split WHERE len(w) > 0)),
        hashed AS MATERIALIZED ({xxh64('(SELECT DISTINCT gram FROM shingles)')}),
        voted AS (SELECT doc_id, {bits} AS b FROM shingles JOIN hashed USING (gram) GROUP BY doc_id),
        prints AS MATERIALIZED (
            SELECT d.doc_id, CAST(coalesce(b, '{'0' * 64}') AS BIT) AS fp, coalesce(lower(list_aggregate(list_transform(range(16), lambda k: printf('%x', list_position(['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'], substr(b, 4 * k + 1, 4)) - 1)), 'string_agg', '')), '{'0' * 16}') AS fingerprint
            FROM documents d LEFT JOIN voted v USING (doc_id)),
        kinds AS (SELECT fp, min(doc_id) AS id FROM prints GROUP BY fp),
        links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM kinds a JOIN kinds b ON a.id <> b.id AND bit_count(xor(a.fp, b.fp)) <= {threshold}),
        reach AS (SELECT id, id AS other FROM kinds UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
        components AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
        SELECT p.doc_id, p.fingerprint, c.component_id FROM prints p JOIN kinds k ON p.fp = k.fp JOIN components c ON c.id = k.id
    """
