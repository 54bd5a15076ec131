"""Exact deduplication by progressive refinement.

Rows are told apart by the cheapest key that does so: first the length of the text, then a
hash of its prefix, and only what still collides is compared by a hash of the whole text.
Which rows that are is looked up in a broadcast table of marks of fixed size, so no text is
shuffled and no other text is hashed; a row that is marked by chance is alone in its group.
Every step counts groups with map-side aggregation and then joins the counts back, so a
group that holds a third of all rows is never gathered in one task: AQE splits its join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop_table, fresh, marks, materialize, with_mark

PREFIX_CHARS = 64


def _normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _repeated(keys: DataFrame, by: list[str]) -> DataFrame:
    """The values of ``by`` that more than one row has."""
    return keys.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").select(*by)


def _keys(text: Column) -> list[Column]:
    """Length in bytes and prefix hash. Lower-casing A-Z changes no length."""
    text = F.coalesce(text, F.lit(""))
    return [F.octet_length(text).alias("length"), F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS))).alias("prefix")]


def colliding(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``length, prefix`` (of the normalised text) that more than one row has."""
    keys = materialize(docs.select(*_keys(F.col(text_col))), "exact-keys")
    lengths = materialize(_repeated(keys, ["length"]), "exact-lengths")
    found = materialize(_repeated(keys.join(lengths, "length", "left_semi"), ["length", "prefix"]), "exact-prefixes")
    drop_table(keys)
    drop_table(lengths)
    return found


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, sha256``.

    Texts are equal when they are identical after lower-casing A-Z; a null text counts as
    empty, and long texts count whole. Of equal texts the row with the largest id stays.
    Repeated rows (equal text and equal id) count one by one and exactly one of them stays. A
    null id sorts below all others, so it stays only in a group whose ids are all null. An
    empty table gives no row. Other columns aren't read, so they can't clash.

    ``sha256`` is null for rows that the length or the prefix already showed to be alone:
    their whole text is not read, unless ``digest_all`` asks to report it.
    """
    prefixes = colliding(docs, text_col)
    rows = docs.select(F.col(id_col).alias("id"), *_keys(F.col(text_col)), F.col(text_col).alias("text"))
    digest = F.sha2(_normalised(F.col("text")), 256)
    rows = with_mark(rows, marks(prefixes, "length", "prefix"), "collides", "length", "prefix")
    rows = rows.select("id", "collides", (digest if digest_all else F.when(F.col("collides"), digest)).alias("sha256"))
    rows = materialize(rows, "exact-rows")
    drop_table(prefixes)
    alone = rows.where("not collides")
    return group_by_digest(rows.where("collides").select("id", "sha256")).unionByName(
        alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha256")
    )


def group_by_digest(hashed: DataFrame) -> DataFrame:
    """Give each row of ``id, sha256`` its group: ``id, keep_id, group_size, kept, sha256``."""
    cells = materialize(hashed.groupBy("sha256", "id").agg(F.count("*").alias("_c")), "exact-cells")
    groups = materialize(
        cells.groupBy("sha256").agg(F.max("id").alias("keep_id"), F.sum("_c").alias("group_size")),
        "exact-groups",
    )
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))).alias("_i")
    return (
        cells.join(groups, "sha256")
        .select("id", "keep_id", "group_size", "sha256", copies)
        .select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"), "sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns.

    Only rows that may have to go are shuffled: those whose id has a mark of a dropped one.
    """
    gone_id, gone_sha, stays, copies, marked = fresh(docs, "_gone_id", "_gone_sha", "_stays", "_copies", "_marked")
    dropped = materialize(
        exact_groups(docs, id_col, text_col)
        .where("group_size > 1")
        .groupBy(F.col("sha256").alias(gone_sha), F.col("id").alias(gone_id))
        .agg(F.max(F.col("kept").cast("int")).alias(stays), F.count("*").alias(copies))
        .where((F.col(stays) == 0) | (F.col(copies) > 1)),
        "exact-dropped",
    )
    own = docs.columns
    flagged = with_mark(docs, marks(dropped, gone_id), marked, id_col)
    maybe = flagged.where(F.col(marked)).drop(marked)
    # A dropped row is known by id and digest; ids alone could repeat over different texts.
    sha = fresh(maybe, "_sha")[0]
    digested = maybe.withColumn(sha, F.sha2(_normalised(F.col(text_col)), 256))
    tagged = digested.join(dropped.hint("merge"), digested[id_col].eqNullSafe(dropped[gone_id]) & (digested[sha] == dropped[gone_sha]), "left")
    single = tagged.where(F.col(gone_sha).isNull()).select(*[digested[c] for c in own])
    repeated = tagged.where(F.col(stays) == 1).select(*[digested[c] for c in own], gone_sha).dropDuplicates([gone_sha, id_col]).drop(gone_sha)
    return flagged.where(~F.col(marked)).drop(marked).unionByName(single).unionByName(repeated)
