"""DuckDB SQL for the whole codec, with the model's matrices as literals."""

from __future__ import annotations

import numpy as np

from vecpack.model import INTERVALS, LEAST_MASS, LLOYD_MAX, ROUNDS, SPAN, TINY, TOLERANCE, VectorModel


def literal(a: np.ndarray) -> str:
    """A list, or a list of lists, of doubles."""
    if np.ndim(a) == 2:
        return f"[{', '.join(map(literal, a))}]::DOUBLE[][]"
    return f"[{', '.join(repr(float(x)) for x in a)}]::DOUBLE[]"


def encoded(model: VectorModel, scaled: bool = False, prefix: str = "") -> str:
    """CTEs ``m``, ``v``, ... ``enc``: each row of ``embeddings`` with all the codec's inner values.

    ``enc`` has vec_id, label, x, norm, rotated, code or angle and radius, near, residual (norm) and sign;
    ``norm_f`` and ``residual_f`` are the norms as they are stored, in single precision.
    """
    p, scale = prefix, " * (1 + vec_id % 5)" if scaled else ""
    steps, top, r = 1 << model.angle_bits, (1 << model.radius_bits) - 1, repr(float(model.max_radius))
    if model.variant == LLOYD_MAX:
        coded = f"""
        {p}coded AS (SELECT t.*, list_transform(rotated, lambda z: len(list_filter(B, lambda b: z > b))) AS code FROM {p}turned t, {p}m),
        {p}approx AS (SELECT t.*, list_transform(code, lambda i: C[i + 1]) AS near FROM {p}coded t, {p}m),"""
    else:
        coded = f"""
        {p}padded AS (SELECT t.*, {f"list_append(rotated, 0.0)" if model.dim % 2 else "rotated"} AS pts FROM {p}turned t),
        {p}coded AS (
            SELECT t.* EXCLUDE (pts),
                   list_transform(range({model.pairs}), lambda i: CAST(round((atan2(pts[2 * i + 2], pts[2 * i + 1]) + pi()) / (2 * pi()) * {steps}) AS INTEGER) % {steps}) AS angle,
                   list_transform(range({model.pairs}), lambda i: CAST(round(least(sqrt(pts[2 * i + 1] * pts[2 * i + 1] + pts[2 * i + 2] * pts[2 * i + 2]), {r}) / {r} * {top}) AS INTEGER)) AS radius
            FROM {p}padded t),
        {p}approx AS (
            SELECT t.*, list_transform(range({model.dim}), lambda i:
                CAST(radius[i // 2 + 1] AS DOUBLE) / {top} * {r} * CASE WHEN i % 2 = 0 THEN cos(CAST(angle[i // 2 + 1] AS DOUBLE) / {steps} * (2 * pi()) - pi()) ELSE sin(CAST(angle[i // 2 + 1] AS DOUBLE) / {steps} * (2 * pi()) - pi()) END) AS near
            FROM {p}coded t),"""
    return f"""
        {p}m AS (SELECT {literal(model.rotation)} AS Q, {literal(model.projection)} AS S, {literal(model.centroids)} AS C, {literal(model.boundaries)} AS B),
        {p}v AS (SELECT vec_id, label, list_transform(embedding, lambda z: CAST(z AS DOUBLE){scale}) AS x FROM embeddings),
        {p}sized AS (SELECT v.*, sqrt(list_inner_product(x, x)) AS norm FROM {p}v v),
        {p}turned AS (SELECT s.*, list_transform(Q, lambda r: list_inner_product(r, list_transform(x, lambda z: CASE WHEN norm > {TINY} THEN z / norm ELSE 0 END))) AS rotated FROM {p}sized s, {p}m),{coded}
        {p}left_over AS (SELECT t.*, list_transform(list_zip(rotated, near), lambda z: z[1] - z[2]) AS rest FROM {p}approx t),
        {p}enc AS (
            SELECT t.*, sqrt(list_inner_product(rest, rest)) AS residual, CAST(CAST(sqrt(list_inner_product(rest, rest)) AS FLOAT) AS DOUBLE) AS residual_f, CAST(CAST(norm AS FLOAT) AS DOUBLE) AS norm_f,
                   list_transform(S, lambda r: CASE WHEN list_inner_product(r, rest) > 0 THEN 1 ELSE 0 END) AS sign
            FROM {p}left_over t, {p}m)"""


def prepared(where: str, prefix: str = "") -> str:
    """CTE ``q``: query_id, turned and projected queries, the unnormalised rows of ``v`` that ``where`` names."""
    p = prefix
    return f"""
        {p}q1 AS (SELECT vec_id AS query_id, x AS qx, list_transform(Q, lambda r: list_inner_product(r, x)) AS qr FROM {p}v, {p}m WHERE {where}),
        {p}q AS (SELECT q1.*, list_transform(S, lambda r: list_inner_product(r, qr)) AS qp FROM {p}q1 q1, {p}m)"""


def score(model: VectorModel, stored: bool = True, qjl: bool = True) -> str:
    """The estimate of a row of ``enc`` with one of ``q``."""
    f = "_f" if stored else ""
    extra = f" + CASE WHEN residual{f} > {TINY} THEN residual{f} * sqrt(pi() / {2 * model.dim}) * list_inner_product(list_transform(sign, lambda b: 2.0 * b - 1), qp) ELSE 0 END" if qjl else ""
    return f"norm{f} * (list_inner_product(qr, near){extra})"


def packed(column: str, bits: int, values: int) -> str:
    """Upper-case hexadecimal text of packed codes."""
    size = -(-values * bits // 8)
    bit = f"CASE WHEN 8 * k + j < {values * bits} THEN ({column}[(8 * k + j) // {bits} + 1] >> ((8 * k + j) % {bits})) & 1 ELSE 0 END"
    return f"array_to_string(list_transform(range({size}), lambda k: printf('%02X', CAST(list_sum(list_transform(range(8), lambda j: ({bit}) << CAST(j AS INTEGER))) AS INTEGER))), '')"


def decoded(prefix: str = "", norm: str = "norm") -> str:
    """The vector that a row of ``enc`` stands for, with ``m`` in scope."""
    return f"list_transform(range(len(x)), lambda i: {norm} * list_inner_product(list_transform(Q, lambda r: r[i + 1]), near))"


def codebook(dim: int, bits: list[int]) -> str:
    """(bits, i, centroid, rounds): the fixed-point iteration as a recursive query, independent of ours."""
    sigma = f"(1 / sqrt({dim}.0))"
    reach = f"({SPAN} * {sigma})"
    weight = f"(CASE WHEN k IN (0, {INTERVALS}) THEN 0.5 ELSE 1.0 END)"
    x = f"(a + (b - a) * (CAST(k AS DOUBLE) / {INTERVALS}))"
    density = f"exp(-1.0 * {x} * {x} / (2 * {sigma} * {sigma}))"
    parts = []
    for n in bits:
        levels = 1 << n
        parts.append(f"""
        SELECT {n} AS bits, unnest(range({levels})) AS i, unnest(list_sort(c)) AS centroid, round AS rounds
        FROM (WITH RECURSIVE it AS (
                SELECT list_transform(range({levels}), lambda i: -1.0 * {reach} + 2 * {reach} * (i + 0.5) / {levels}) AS c, 0 AS round, 1.0::DOUBLE AS change
                UNION ALL
                SELECT new, round + 1, list_max(list_transform(list_zip(new, c), lambda z: abs(z[1] - z[2]))) FROM (
                    SELECT c, round, list_transform(range({levels}), lambda i: CASE WHEN masses[i + 1] > {LEAST_MASS} THEN moments[i + 1] / masses[i + 1] ELSE c[i + 1] END) AS new FROM (
                        SELECT c, round,
                               list_transform(list_zip(edges[1:{levels}], edges[2:{levels + 1}]), lambda e: list_sum(list_transform(range({INTERVALS + 1}), lambda k: {density.replace('a +', 'e[1] +').replace('b - a', 'e[2] - e[1]')} * {weight})) * (e[2] - e[1]) / {INTERVALS} / ({sigma} * sqrt(2 * pi()))) AS masses,
                               list_transform(list_zip(edges[1:{levels}], edges[2:{levels + 1}]), lambda e: list_sum(list_transform(range({INTERVALS + 1}), lambda k: {x.replace('a +', 'e[1] +').replace('b - a', 'e[2] - e[1]')} * {density.replace('a +', 'e[1] +').replace('b - a', 'e[2] - e[1]')} * {weight})) * (e[2] - e[1]) / {INTERVALS} / ({sigma} * sqrt(2 * pi()))) AS moments
                        FROM (SELECT c, round, list_concat(list_concat([-1.0 * {reach}], list_transform(range({levels - 1}), lambda i: (c[i + 1] + c[i + 2]) / 2)), [{reach}]) AS edges FROM it
                              WHERE round < {ROUNDS} AND change >= {TOLERANCE}))))
              SELECT c, round FROM it ORDER BY round DESC LIMIT 1)""")
    return " UNION ALL ".join(parts)
