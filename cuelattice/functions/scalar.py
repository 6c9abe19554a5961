"""Column expressions of the engine, all of them JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET_LIMIT = 500
#: Name and dimension of the offline embedder, :func:`hash_embedding`.
HASH_MODEL, HASH_DIM = "hash-sha256-d32", 32
ELLIPSIS = "…"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def git_blob_sha(content: Column | str) -> Column:
    """SHA-1 of a git blob holding these bytes (or this text in UTF-8)."""
    data = _col(content).cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(data).cast("string")).cast("binary"), F.lit(b"\x00"), data))


def module_path(path: Column | str) -> Column:
    """Dotted module of a path: without .py, without a trailing __init__."""
    bare = F.regexp_replace(_col(path), r"\.py$", "")
    bare = F.regexp_replace(bare, r"(^|/)__init__$", "")
    return F.replace(bare, F.lit("/"), F.lit("."))


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 with a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used; inside a lambda it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def l2_normalise(a: Column | str) -> Column:
    """The vector over its norm; a zero vector stays."""

    def over(v: Column, length: Column) -> Column:
        return F.transform(v, lambda x: x.cast("double") / F.when(length == 0, F.lit(1.0)).otherwise(length))

    return _once(_col(a), lambda v: _once(norm(v), lambda length: over(v, length)))


def hash_embedding(text: Column | str) -> Column:
    """Offline embedding: the 32 bytes of SHA-256 less 128, normalised."""

    def raw(digest: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128.0)

    return l2_normalise(_once(F.sha2(_col(text).cast("binary"), 256), raw))


def truncated(text: Column | str, limit: int = SNIPPET_LIMIT) -> Column:
    c = _col(text)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(ELLIPSIS))).otherwise(c)


def content_label() -> Column:
    """First of signature, symbol name and kind that is not empty."""
    return F.coalesce(F.nullif(F.col("signature"), F.lit("")), F.nullif(F.col("symbol_name"), F.lit("")), F.col("kind"))


def content_snippet() -> Column:
    """The docstring as it is, else the body cut to the limit."""
    return F.coalesce(F.col("docstring"), truncated("body"))


def short_sha(sha: Column | str) -> Column:
    return F.substring(_col(sha), 1, 7)


def message_slug(message: Column | str) -> Column:
    return F.substring(F.sha1(_col(message).cast("binary")), 1, 12)


def module_content_id(file: Column | str) -> Column:
    return F.concat(F.lit("content:"), _col(file), F.lit("::<module>"))


def definition_content_id(file: Column | str, qualified: Column | str, symbol: Column | str) -> Column:
    """The cross-reference symbol where there is one, else an id of file and name."""
    return F.coalesce(F.nullif(_col(symbol), F.lit("")), F.concat(F.lit("content:"), _col(file), F.lit("::"), _col(qualified)))


def symbol_cue_id(file: Column | str, qualified: Column | str) -> Column:
    return F.concat(F.lit("cue:symbol:"), _col(file), F.lit("::"), _col(qualified))


def error_cue_id(file: Column | str, message: Column | str) -> Column:
    return F.concat(F.lit("cue:error:"), _col(file), F.lit("::"), message_slug(message))


def tag_id(category: Column | str, value: Column | str) -> Column:
    return F.concat(F.lit("tag:"), _col(category), F.lit(":"), _col(value))


def decoded_range() -> Column:
    """(start_line, start_character, end_line, end_character) of an occurrence: single-line form, multi-line form, then the older array of 3 or 4, else zeros."""

    def four(a, b, c, d):
        return F.struct(
            a.cast("int").alias("start_line"),
            b.cast("int").alias("start_character"),
            c.cast("int").alias("end_line"),
            d.cast("int").alias("end_character"),
        )

    single, multi, old = F.col("single_line"), F.col("multi_line"), F.col("range")
    zero = F.lit(0)
    return (
        F.when(single.isNotNull(), four(single["line"], single["start_character"], single["line"], single["end_character"]))
        .when(multi.isNotNull(), four(multi["start_line"], multi["start_character"], multi["end_line"], multi["end_character"]))
        .when(F.size(old) == 3, four(old[0], old[1], old[0], old[2]))
        .when(F.size(old) == 4, four(old[0], old[1], old[2], old[3]))
        .otherwise(four(zero, zero, zero, zero))
    )
