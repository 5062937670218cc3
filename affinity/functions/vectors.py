"""Column expressions for feature vectors.

Vectors rest as ``array<double>``. The text forms ``[1.0,0.5]`` (dense) and
``(3,[0,2],[1.0,0.5])`` (sparse) exist only where text is read or written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_brackets(text: Column) -> Column:
    """Text without the square brackets around it."""
    return F.btrim(text, F.lit("[]"))


def _numbers(csv: Column, dtype: str) -> Column:
    pieces = F.transform(F.split(csv, ","), lambda piece: F.trim(piece))
    kept = F.filter(pieces, lambda piece: piece != "")
    return F.transform(kept, lambda piece: piece.cast(dtype))


def parse_dense(text: Column) -> Column:
    """``[a,b,c]`` to ``array<double>``."""
    return _numbers(strip_brackets(F.trim(text)), "double")


def _sparse_width(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*\(\s*(\d+)", 1).try_cast("int")


def dense(width: Column, indices: Column, values: Column) -> Column:
    """The ``array<double>`` of a sparse vector, in one pass over its entries."""
    entries = F.array_sort(F.zip_with(indices, values, lambda i, v: F.struct(i.alias("i"), v.alias("v"))))

    def place(sorted_entries: Column, n: Column) -> Column:
        return F.coalesce(F.get(sorted_entries, n)["i"], F.lit(-1))

    def zeros(n: Column) -> Column:
        return F.array_repeat(F.lit(0.0), n.cast("int"))

    def filled(e: Column) -> Column:
        runs = F.transform(e, lambda x, n: F.concat(zeros(x["i"] - place(e, n - 1) - 1), F.array(x["v"])))
        return F.concat(F.flatten(runs), zeros(width - 1 - place(e, F.size(e) - 1)))

    # The array of one holds the sorted entries, so that they are sorted once.
    return F.transform(F.array(entries), filled)[0]


def parse_sparse(text: Column) -> Column:
    """``(n,[i..],[v..])`` to a dense ``array<double>`` of length n."""
    parts = r"\[([^\]]*)\]\s*,\s*\[([^\]]*)\]"
    indices = _numbers(F.regexp_extract(text, parts, 1), "int")
    values = _numbers(F.regexp_extract(text, parts, 2), "double")
    return dense(_sparse_width(text), indices, values)


def parse_vector(text: Column) -> Column:
    """Either text form to ``array<double>``."""
    return F.when(F.ltrim(text).startswith("("), parse_sparse(text)).otherwise(parse_dense(text))


def vector_width(text: Column) -> Column:
    """Number of slots of a vector in either text form."""
    dense = F.size(F.filter(F.split(strip_brackets(F.trim(text)), ","), lambda p: F.trim(p) != ""))
    return F.when(F.ltrim(text).startswith("("), _sparse_width(text)).otherwise(dense)


def vector_to_text(vector: Column, digits: int | None = None) -> Column:
    """``array<double>`` to ``[a,b,c]``; ``digits`` fixes the number of decimals."""
    if digits is None:
        pieces = F.transform(vector, lambda x: x.cast("string"))
    else:
        pieces = F.transform(vector, lambda x: F.format_string(f"%.{digits}f", x))
    return F.concat(F.lit("["), F.concat_ws(",", pieces), F.lit("]"))


def merge_features(*vectors: Column) -> Column:
    """One array with the slots of all arrays, in argument order."""
    return F.concat(*vectors)


def merge_feature_texts(*texts: Column) -> Column:
    """One ``[..]`` text with the slots of all dense texts, in argument order."""
    inner = F.concat_ws(",", *[strip_brackets(text) for text in texts])
    return F.concat(F.lit("["), inner, F.lit("]"))


def common_width(df: DataFrame, vector: str) -> int:
    """The slot count shared by every vector of an array column; raises if it varies."""
    low, high = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low is None:
        raise ValueError(f"no vectors in column {vector!r}")
    if low != high:
        raise ValueError(f"vectors in {vector!r} have between {low} and {high} slots")
    return int(low)


def vector_columns(df: DataFrame, *vectors: str, prefix: str = "f") -> DataFrame:
    """Array columns spread to ``f1..fn``, numbered on across all of them."""
    rest = [name for name in df.columns if name not in vectors]
    slots = []
    for name in vectors:
        for i in range(common_width(df, name)):
            slots.append(F.col(name)[i].alias(f"{prefix}{len(slots) + 1}"))
    return df.select(*rest, *slots)
