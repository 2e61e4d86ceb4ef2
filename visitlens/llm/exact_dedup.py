"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

DataFrame functions only. Rows that share their byte length with no other row are settled
by the first step, rows that share length and prefix hash with no other row by the second,
and only the rest are grouped by a digest of their whole text. A column of texts can only be
read whole, so one scan takes length, prefix hash and digest together; what the steps spare is
the grouping, and no step moves a text. Keys that hold more than a thousandth of all rows, of
which there are fewer than a thousand, are met by broadcast, so no task gets all their rows.

Defined cases: a null text counts as empty. Empty texts equal each other. Lower-casing
touches A-Z only. Of equal texts the largest id stays; a null id loses to any other. Rows
that repeat both id and text are all counted and all called kept; ``deduplicated`` leaves the
one with the smallest hash over its columns, and one row where all columns are equal. An empty
table gives an empty result. Other columns of the input only enter that hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import UPPER, stored, whole_text

PREFIX_CHARS = 256
#: A key with more than this share of all rows is hot.
HOT_SHARE = 1000
#: Ids of dropped rows are broadcast up to this number; beyond it texts are shuffled to them.
BROADCAST_ROWS = 1_000_000


def lowered(text):
    return F.translate(text, UPPER, UPPER.lower())


def row_hash(docs: DataFrame, id_col: str, text_col: str):
    """A hash over the text as it is and all other columns that have one."""
    others = [f.name for f in docs.schema if f.name not in (id_col, text_col)]
    others = [c for c in others if "map<" not in docs.schema[c].dataType.simpleString()]
    return F.xxhash64(whole_text(text_col), *[F.col(f"`{c}`") for c in others])


def _met(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """A left join with ``keys``, whose column ``n`` counts the rows of each."""
    is_hot = F.col("n") * HOT_SHARE > total
    hot, cold = F.broadcast(keys.where(is_hot)), keys.where(~is_hot)
    rest = rows.join(hot, on, "left_anti").join(cold, on, "left")
    return rows.join(hot, on).unionByName(rest)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False
) -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, settled_by, text_sha256,
    row_hash``.

    The digest is that of the normalised text; rows settled by length or prefix have none
    unless ``digest_all`` asks for it.
    """
    text = whole_text(text_col)
    narrow = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.xxhash64(lowered(F.substring(text, 1, PREFIX_CHARS))).alias("prefix"),
            F.unhex(F.sha2(lowered(text), 256)).alias("digest"),
            row_hash(docs, id_col, text_col).alias("row_hash"),
        ),
        "dedup-narrow",
    )
    total = narrow.count()
    prefixes = narrow.groupBy("n_bytes", "prefix").agg(F.count("*").alias("n"))
    lengths = prefixes.groupBy("n_bytes").agg(F.sum("n").alias("n")).where("n > 1").drop("n")
    prefixes = prefixes.where("n > 1").join(lengths, "n_bytes", "left_semi")
    flagged = _met(narrow, prefixes, ["n_bytes", "prefix"], total).drop("n_bytes", "prefix")
    flagged = stored(flagged.withColumn("open", F.col("n").isNotNull()).drop("n"), "dedup-open")
    is_open = flagged.where("open")
    groups = is_open.groupBy("digest").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    # Settled rows pass the join by: no other row can have their digest.
    settled = flagged.where("NOT open").select(
        "*", F.lit(None).cast("long").alias("n"), F.col("doc_id").alias("top")
    )
    found = _met(is_open, groups.where("n > 1"), ["digest"], total).unionByName(settled)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    shown = F.lower(F.hex("digest"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.when(F.col("open"), "content").otherwise("length or prefix").alias("settled_by"),
        (shown if digest_all else F.when(F.col("open"), shown)).alias("text_sha256"),
        "row_hash",
    )


def deduplicated(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The ids and hashes of the rows that go are counted: up to ``broadcast_rows`` they are
    broadcast and no text moves, beyond that texts are shuffled once to meet them.
    """
    groups = stored(exact_groups(docs).where("group_size > 1"), "dedup-groups")
    same_row = ["doc_id", "row_hash"]
    # Kept rows of one text are one row, but for ids that repeat.
    kept = groups.where("kept").groupBy("doc_id", "text_sha256", "row_hash").agg(F.count("*").alias("m"))
    chosen = kept.groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).agg(
        F.min("row_hash").alias("chosen"), F.sum("m").alias("n")
    )
    same_text = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha"))
    repeated = stored(
        kept.join(chosen.where("n > 1"), same_text).select(
            *same_row, (F.col("row_hash") == F.col("chosen")).alias("stays")
        ),
        "dedup-repeated",
    )
    gone = groups.where("NOT kept").select(*same_row).distinct().unionByName(repeated.select(*same_row))
    gone = stored(gone, "dedup-gone")
    hashed = docs.withColumn("_row_hash", row_hash(docs, "doc_id", "text"))

    def on(keys: DataFrame):
        return hashed["doc_id"].eqNullSafe(keys["doc_id"]) & (hashed["_row_hash"] == keys["row_hash"])

    def sized(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.count() <= broadcast_rows else keys

    kept = hashed.join(sized(gone), on(gone), "left_anti")
    if not repeated.isEmpty():
        one = repeated.where("stays")
        again = hashed.join(sized(one), on(one), "left_semi").dropDuplicates(["doc_id", "_row_hash"])
        kept = kept.unionByName(again)
    return kept.drop("_row_hash")
