"""Filling containers of fixed capacity (problem 8) by vector bin packing.

Each container has limits on tokens, segments and loss-bearing tokens at once. Items are hashed
into blocks of a bounded number and every block is packed on its own by the dot-product rule: of
the items that fit, the one whose demand points most in the direction of what is left. Only counts
are shuffled, never texts; each block wastes space in its last container at most. What is packed with
what follows from the rows alone, not from how they are partitioned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.session import materialize

#: Items of a block on average. A block is packed in one task; hashing keeps it near this number.
BLOCK_ITEMS = 40_000


def pack_block(
    tokens: np.ndarray, loss: np.ndarray, capacity: int, max_segments: int, max_loss: int
) -> np.ndarray:
    """The container number of each item; items of one block, none larger than a container."""
    demand, kind, count = np.unique(
        np.stack([tokens, loss], 1), axis=0, return_inverse=True, return_counts=True
    )
    kind = kind.ravel()
    t, s = demand[:, 0].astype(float) / capacity, demand[:, 1].astype(float) / max_loss
    seg = 1.0 / max_segments
    # a limit weighs as much as the items together ask of it
    w_t, w_s, w_n = (t * count).sum(), (s * count).sum(), seg * count.sum()
    left = count.copy()
    queue: list[list[int]] = []
    room_t, room_s, room_n = 1.0, 1.0, max_segments
    order: list[int] = []
    eps = 1e-12
    remaining = int(count.sum())
    while remaining:
        fits = (left > 0) & (t <= room_t + eps) & (s <= room_s + eps)
        if room_n == 0 or not fits.any():
            queue.append(order)
            order, room_t, room_s, room_n = [], 1.0, 1.0, max_segments
            continue
        score = np.where(fits, w_t * t * room_t + w_s * s * room_s + w_n * seg * room_n / max_segments, -1.0)
        i = int(score.argmax())
        order.append(i)
        left[i] -= 1
        remaining -= 1
        room_t, room_s, room_n = room_t - t[i], room_s - s[i], room_n - 1
    if order:
        queue.append(order)
    by_kind = np.argsort(kind, kind="stable")
    nxt = np.r_[0, np.cumsum(count)[:-1]]
    out = np.empty(len(tokens), np.int64)
    for c, members in enumerate(queue):
        for i in members:
            out[by_kind[nxt[i]]] = c
            nxt[i] += 1
    return out


def fill_containers(
    sizes: DataFrame, id_col: str, size_col: str, capacity: int = 2048,
    max_segments: int = 256, max_loss: int | None = None, loss_col: str | None = None,
) -> DataFrame:
    """``<id_col>, piece_no, n_pieces, start_token, n_tokens, n_loss, container_id`` of every row.

    A row is one segment, whole, unless its size exceeds the capacity: then it comes out in
    pieces of ``capacity``, each filling a container alone, and a last piece packed like any
    other row. ``loss_col`` has the loss-bearing tokens of a row, at most its size; without it, or
    where it is null, they are all but the first of a segment, which nothing predicts. Any piece may
    hold all of its row's. Rows with more of them than ``max_loss`` (the capacity, if not given) are
    never cut for it, but get a container alone; no container of several rows has more.
    A row of size 0 or less or null takes no room: one piece of 0 tokens, container null. Ids need not be
    unique: every row is packed. Containers are numbered from 0 without gaps.
    """
    max_loss = max_loss or capacity
    n = F.greatest(F.coalesce(F.col(size_col), F.lit(0)).cast("long"), F.lit(0))
    all_but_one = F.greatest(n - 1, F.lit(0))
    bounded = F.least(F.greatest(F.col(loss_col or size_col).cast("long"), F.lit(0)), n)
    given = F.when(F.col(loss_col).isNotNull(), bounded).otherwise(all_but_one) if loss_col else all_but_one
    # equal rows are counted and numbered, so that the order in which they come does not matter
    counted = sizes.select(F.col(id_col), n.alias("__n"), given.alias("__loss")).groupBy(id_col, "__n", "__loss").agg(F.count(F.lit(1)).alias("__copies"))
    pieces = (
        counted.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
        .withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("__n") / capacity)).cast("int"))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .withColumn("start_token", F.col("piece_no").cast("long") * capacity)
        .withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("__n") - F.col("start_token")))
        .withColumn("n_loss", F.least("__loss", "n_tokens"))
        .withColumn("__h", F.xxhash64(id_col, "__copy", "piece_no", "__n"))
    )
    columns = [id_col, "piece_no", "n_pieces", "start_token", "n_tokens", "n_loss"]
    pieces = materialize(pieces.select(*columns, "__h"), "pieces")
    shared = (F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity) & (F.col("n_loss") <= max_loss)
    alone = (F.col("n_tokens") > 0) & ~shared
    total = pieces.agg(F.count_if(shared).alias("s"), F.count_if(alone).alias("a")).first()
    blocks, own_blocks = (max(1, -(-total[c] // BLOCK_ITEMS)) for c in "sa")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*columns).schema)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__h", "n_tokens", "n_loss"], ignore_index=True)
        box = pack_block(pdf["n_tokens"].to_numpy(np.int64), pdf["n_loss"].to_numpy(np.int64), capacity, max_segments, max_loss)
        return pdf.drop(columns="__h").assign(__box=box)

    packed = (
        pieces.where(shared).withColumn("__block", F.pmod("__h", F.lit(blocks))).groupBy("__block")
        .applyInPandas(pack, f"{fields}, __block long, __box long")
    )
    rank = F.row_number().over(Window.partitionBy("__block").orderBy("__h")).cast("long") - 1
    lone = pieces.where(alone).withColumn("__block", F.pmod("__h", F.lit(own_blocks)) + blocks).withColumn("__box", rank).drop("__h")
    boxed = materialize(packed.select(*columns, "__block", "__box").unionByName(lone), "boxed")
    # one row a block of BLOCK_ITEMS items
    used = boxed.groupBy("__block").agg((F.max("__box") + 1).alias("__used"))
    before = F.sum("__used").over(Window.orderBy("__block")) - F.col("__used")
    numbered = boxed.join(used.select("__block", before.alias("__before")), "__block")
    nothing = pieces.where("n_tokens = 0").select(*columns, F.lit(None).cast("long").alias("container_id"))
    return numbered.select(*columns, (F.col("__before") + F.col("__box")).alias("container_id")).unionByName(nothing)


def limits_report(packed: DataFrame, capacity: int, max_segments: int, max_loss: int) -> DataFrame:
    """One row: ``n_rows`` (pieces of one row counted once), containers over each limit (``over_tokens,
    over_segments, over_loss``, the last among those of several segments), pieces with tokens and no
    container (``unplaced``), and container numbers left out (``gaps``)."""
    used = packed.where("container_id is not null").groupBy("container_id").agg(
        F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("s"), F.sum("n_loss").alias("l")
    )
    limits = used.agg(
        F.count_if(F.col("t") > capacity).alias("over_tokens"), F.count_if(F.col("s") > max_segments).alias("over_segments"),
        F.count_if((F.col("l") > max_loss) & (F.col("s") > 1)).alias("over_loss"),
        (F.coalesce(F.max("container_id") + 1, F.lit(0)) - F.count(F.lit(1))).alias("gaps"),
    )
    rows = packed.agg(F.count_if(F.col("piece_no") == 0).alias("n_rows"), F.count_if((F.col("n_tokens") > 0) & F.col("container_id").isNull()).alias("unplaced"))
    return rows.crossJoin(limits)


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row ``n_containers, n_tokens, fill``: the share of all container space in use."""
    used = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    return used.agg(
        F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"),
        F.try_divide(F.sum("t"), F.count(F.lit(1)) * capacity).alias("fill"),
    )
