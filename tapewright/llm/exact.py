"""Exact deduplication: 128-bit content hash first, then a comparison of bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def content_hash(body: Column) -> Column:
    """128 bits of MD5 over the UTF-8 bytes."""
    return F.unhex(F.md5(body.cast("binary")))


def _best(keep: str) -> Column:
    """Aggregate that picks the row to keep: by id, then by place in the scratch table."""
    known = F.col("id").isNotNull()
    if keep == "max":
        return F.max(F.struct(known.alias("known"), "id", "tie"))
    return F.min(F.struct((~known).alias("known"), "id", "tie"))


def _judge(docs: DataFrame, id_col: str, text_col: str, keep: str, hash_fn: Callable[[Column], Column], payload: Column) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, sha, payload."""
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), payload.alias("payload"))
    rows = rows.withColumn("h", hash_fn(F.col("body")))
    # The hashes are counted first: only rows whose hash recurs have anything to compare.
    # Written out, so that both sides of the join are plain shuffles and a hot hash can be split.
    sizes = materialize(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "exact-sizes")
    located = rows.join(sizes, "h", "left").select(
        "id", "payload", "h",
        F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha"),
        F.when(F.col("n") > 1, F.col("body")).alias("body"),
        F.monotonically_increasing_id().alias("tie"),
    )
    located = materialize(located, "exact-located")
    singles = located.where(F.col("body").isNull()).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "payload"
    )
    twins = located.where(F.col("body").isNotNull())
    first = twins.groupBy("h").agg(_best("min").alias("b")).select("h", F.col("b.tie").alias("tie"))
    model = twins.select("h", "tie", F.col("body").alias("model")).join(first, ["h", "tie"]).select("h", "model")
    # A row whose bytes differ from its hash's model is a collision; its own text then tells its group.
    judged = twins.join(model, "h").select("id", "tie", "h", "sha", "payload", F.when(F.col("body") != F.col("model"), F.col("body")).alias("odd"))
    judged = materialize(judged, "exact-judged")
    groups = judged.groupBy(F.col("h").alias("gh"), F.col("odd").alias("godd")).agg(F.count(F.lit(1)).alias("group_size"), _best(keep).alias("b"))
    groups = materialize(groups, "exact-groups")
    settled = judged.join(groups, (F.col("h") == F.col("gh")) & F.col("odd").eqNullSafe(F.col("godd"))).select(
        "id", F.col("b.id").alias("keep_id"), "group_size", (F.col("tie") == F.col("b.tie")).alias("kept"), "sha", "payload"
    )
    return singles.unionByName(settled)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """For every row: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are equal; ``keep`` says whether the
    smallest or the largest id of a group stays. Null text counts as empty. A
    null id is kept only if its group has no other; of rows that repeat both id
    and text exactly one is kept. An empty table gives an empty result; other
    columns are not looked at, whatever their names.

    Hash counts are combined before the shuffle. The joins carry single rows,
    never a gathered group, so a hot hash is split by the adaptive skew join.
    """
    out = _judge(docs, id_col, text_col, keep, hash_fn, F.lit(0))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns."""
    out = _judge(docs, id_col, text_col, keep, hash_fn, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return out.where("kept").select("payload.*")
