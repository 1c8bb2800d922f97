"""Exact deduplication in two Bloom passes: rows that are surely unique never meet a shuffle.

Pass 1 hashes every text and sets two bits for it in a Bloom bitmap; a bit that a second row sets
again is noted in a second bitmap, of bits set more than once. Tasks send only bit positions (a few
bytes a row), which are merged per block of the bitmap. Pass 2 tests each row: a row with a bit that
was set once only has a text of its own and goes straight through. The others are possibly repeated;
only they are shuffled, by their full SHA-256, and counted exactly.

The bitmap is bounded (bloom.MAX_BITS); a fuller one lets more rows through to the exact step, which
decides alone.

Texts are equal when identical after lowering A-Z; null counts as empty. Of equal texts the row with
the largest id stays (a null id counts as smallest); of rows that tie there too, one stays. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import possibly_repeated
from .shared import fresh, lower_ascii, stored


def normal_text(text: str | Column) -> Column:
    return lower_ascii(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256 (see the module's rules).

    Texts are read once, for their digests; the digests are stored and all later work is on them.
    """
    normal = normal_text(text_col)
    digests = stored(
        df.select(
            F.col(id_col).alias("doc_id"), F.sha2(normal, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    spread = digests.withColumn("h", F.xxhash64("text_sha256"))
    flagged = stored(spread.withColumn("maybe", possibly_repeated(spread, "h")), "flagged")
    maybe = flagged.filter("maybe")
    # (id, row) orders the rows of a group: null ids first, the row number settles ties
    # stored, so that the join's own shuffle can split a group that holds a third of all rows
    groups = stored(maybe.groupBy("text_sha256").agg(
        F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row")).alias("best"), F.count("*").alias("group_size"),
    ), "groups")
    shared = maybe.join(groups, "text_sha256").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256",
    )
    alone = flagged.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256",
    )
    return alone.unionByName(shared)


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows whose text another row of a larger id has; all columns are kept as they are.

    Rows that pass 2 lets through keep their place; only possibly repeated rows are shuffled whole.
    """
    sha, h, pick, best, n = fresh(df.columns, "text_sha", "text_hash", "id_known", "best_row", "best_rows")
    hashed = df.withColumn(sha, F.sha2(normal_text(df[text_col]), 256)).withColumn(h, F.xxhash64(sha))
    flags = possibly_repeated(hashed, h)
    alone = hashed.filter(~flags)
    maybe = hashed.filter(flags).withColumn(pick, F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id")))
    # count rows of a (text, id) first: a text that a third of all rows share is summed up in every task
    ties = maybe.groupBy(sha, pick).agg(F.count("*").alias(n))
    winners = stored(ties.groupBy(sha).agg(F.max(F.struct(F.col(pick), F.col(n))).alias(best)).select(sha, F.col(f"{best}.{pick}").alias(pick), F.col(f"{best}.{n}").alias(n)), "winners")
    won = maybe.join(winners, [sha, pick])
    one = won.filter(F.col(n) == 1).unionByName(won.filter(F.col(n) > 1).dropDuplicates([sha, pick]))
    return alone.select(*df.columns).unionByName(one.select(*df.columns))
