"""Copies hidden by formatting, by progressive partition refinement.

Records are first divided by cheap invariants of the stripped fields: their lengths and a
coarse letter histogram. Classes of one record are done. Only records of the other classes
get the costlier key, a 128-bit digest of the stripped fields, and are divided by it; what
is left together is one record. Counts and least ids come from aggregations with map-side
combine, so a group with a third of all rows is folded before it is shuffled; the copies
are then joined to their group by the digest, a join that adaptive execution splits where
one digest is hot.

Defined results: a record with a null field, or one without any letter or digit, is no
record; repeated ids of one record count as one copy; accents count; empty tables give
empty results; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import alnum_key
from factloom.plans.session import cut

#: The letters whose counts make the coarse histogram.
HISTOGRAM = "aeiourst"


def parse_json_records(df: DataFrame, payload: str, fields: list[str], keep: list[str]) -> DataFrame:
    """The named string fields of whole JSON objects; rows with null or damaged payloads are dropped."""
    schema = ", ".join(f"`{f}` string" for f in fields) + ", _damaged string"
    parsed = F.from_json(F.col(payload), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"})
    return df.select(*keep, parsed.alias("j")).filter("j is not null and j._damaged is null").select(*keep, *[F.col(f"j.{f}").alias(f) for f in fields])


def _histogram(text: Column) -> Column:
    return F.array(*[F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in HISTOGRAM])


def stripped_records(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """id, invariants and the stripped fields of every record with all fields."""
    keys = [f"k{n}" for n in range(len(fields))]
    out = df.select(F.col(id_col).cast("long").alias("id"), *[alnum_key(F.col(f)).alias(k) for f, k in zip(fields, keys)])
    for k in keys:
        out = out.filter(F.col(k) != "")
    cheap = [F.length(k) for k in keys] + [_histogram(F.col(keys[-1]))]
    return out.filter("id is not null").select("id", F.xxhash64(*cheap).alias("invariant"), *keys)


def copy_groups(df: DataFrame, id_col: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(groups, copies): groups of several copies, and every copy with its group's first id.

    groups: first_id, n_copies. copies: first_id, copy_id (without the first itself).
    """
    keys = [f"k{n}" for n in range(len(fields))]
    records = stripped_records(df, id_col, fields)
    several = records.groupBy("invariant").agg(F.count("*").alias("n")).filter("n > 1").select("invariant")
    digest = F.unhex(F.md5(F.concat_ws("\x00", *keys)))
    refined = cut(records.join(several, "invariant", "left_semi").select("id", digest.alias("digest")).distinct())
    groups = refined.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    copies = refined.join(groups, "digest").filter("id != first_id").select("first_id", F.col("id").alias("copy_id"))
    return groups.select("first_id", F.col("n").alias("n_copies")), copies
