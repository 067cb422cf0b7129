"""Text expressions: signatures, ids, tokens, hashed vectors. All of them are plain Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from runwarden import fixed


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    A one-element array and ``transform`` give a name to an intermediate result without a second
    projection, which the optimizer could merge back and so evaluate again per use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def error_signature(text: Column) -> Column:
    """First error word of a log text in the case it was written in."""
    word = F.regexp_extract(F.coalesce(text, F.lit("")), f"(?i)({fixed.ERROR_WORDS})", 1)
    return F.coalesce(F.nullif(word, F.lit("")), F.lit(fixed.NO_SIGNATURE))


def merged_output(*pieces: Column) -> Column:
    """Join the non-empty parts of a task's output with newlines; all but the first are stripped."""
    first, rest = F.nullif(pieces[0], F.lit("")), [blank_to_null(p) for p in pieces[1:]]
    return F.concat_ws("\n", first, *rest)


def error_class_name(text: Column) -> Column:
    """Class name in front of a colon, e.g. ``ValueError`` or ``java.lang.OutOfMemoryError``."""
    return F.nullif(F.regexp_extract(text, r"([A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception)):", 1), F.lit(""))


def error_detail(text: Column) -> Column:
    return F.nullif(
        F.regexp_extract(text, r"[A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception): ([^\n]*)", 1), F.lit("")
    )


def failing_stage(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)stage ([0-9]+)", 1), F.lit("")).cast("int")


def surrogate_id(*parts: Column | str | int, length: int = 12) -> Column:
    """First hex digits of the SHA-1 of the colon-joined parts."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.substring(F.sha1(F.concat_ws(":", *cols)), 1, length)


def record_id(*parts: Column) -> Column:
    """Full SHA-1 key for rows the reference keys by random UUID; stable when a job is run again."""
    return F.sha1(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.TOKEN_PATTERN), F.lit(0))


def _hex_byte(digest: Column, position: int) -> Column:
    return F.conv(F.substring(digest, 1 + 2 * position, 2), 16, 10).cast("long")


def _slot(digest: Column, dim: int) -> Column:
    """First four digest bytes, little-endian, modulo ``dim``."""
    value = _hex_byte(digest, 0)
    if 256 % dim != 0:  # beyond byte 0 only multiples of 256 are added
        for i in (1, 2, 3):
            value = value + _hex_byte(digest, i) * F.lit(256**i)
    return (value % F.lit(dim)).cast("int")


def _run_lengths(ordered: Column) -> Column:
    """Map value -> number of occurrences of a sorted array, in time linear in its length."""

    def lengths(a: Column) -> Column:
        starts = F.filter(
            F.transform(a, lambda x, i: F.when((i == 0) | (x != F.get(a, i - 1)), i)),
            lambda i: i.isNotNull(),
        )
        return bind(
            starts,
            lambda s: F.map_from_arrays(
                F.transform(s, lambda i: F.get(a, i)),
                F.transform(s, lambda i, j: F.coalesce(F.get(s, j + 1), F.size(a)) - i),
            ),
        )

    return bind(ordered, lengths)


def hashed_counts(text: Column, dim: int = fixed.EMBED_DIM) -> Column:
    """Signed token counts per hash slot as a map, zero slots left out.

    The whole vector is built inside the row: no shuffle per token and no Python.
    """
    coded = F.transform(
        tokens(text),
        lambda t: bind(
            F.sha2(t, 256),
            # slot, with the sign (parity of digest byte 4) in the lowest bit
            lambda h: _slot(h, dim) * 2 + (_hex_byte(h, 4) % 2).cast("int"),
        ),
    )

    def net(codes: Column) -> Column:
        plus = F.array_sort(F.transform(F.filter(codes, lambda c: c % 2 == 0), lambda c: F.shiftright(c, 1)))
        minus = F.array_sort(F.transform(F.filter(codes, lambda c: c % 2 == 1), lambda c: F.shiftright(c, 1)))
        both = F.map_zip_with(
            _run_lengths(plus),
            _run_lengths(minus),
            lambda k, p, m: F.coalesce(p, F.lit(0)) - F.coalesce(m, F.lit(0)),
        )
        return F.map_filter(both, lambda k, v: v != 0)

    return bind(coded, net)


def hashed_weights(text: Column, dim: int = fixed.EMBED_DIM) -> Column:
    """Unit-length sparse vector, map slot -> weight; empty for a text without tokens."""

    def scaled(counts: Column) -> Column:
        squares = F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda s, v: s + v * v)
        return bind(
            F.sqrt(squares.cast("double")),
            lambda norm: F.transform_values(counts, lambda k, v: v / norm),
        )

    return bind(hashed_counts(text, dim), scaled)


def dense(weights: Column, dim: int = fixed.EMBED_DIM) -> Column:
    return bind(
        weights,
        lambda w: F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at(w, i), F.lit(0.0))
        ),
    )


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two dense vectors, 0 when either has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def excerpt(text: Column, n: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)
