"""Change feed of the leaderboards of nations, from batches of sale lines that arrive late and out of order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..runtime import ship
from .common import delete, discard, materialize, new_path

#: The first arrival day, the days that the batches share, and how many batches.
FIRST_DAY, DAYS, BATCHES = 19723, 180, 8
#: Days that a line may lie behind the latest seen before its batch; places on a board.
LATE_DAYS, PLACES = 15, 10
#: A nation's items are dealt to so many states by a hash; each keeps the board of its own items.
SLICES = 8
#: A day of event time is a second of Spark's clock, so many seconds after its start: any date fits, those before 1970 too.
AHEAD, DAY_MS = 1_000_000, 1000
#: Event time of the sentinels, in days: beyond all dates.
END = 9_000_000
#: While the stream runs: no batches without data; of old states only what a restart needs.
SETTINGS = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.minBatchesToRetain": "2"}


def batch_of(day: Column) -> Column:
    """The batch in which an arrival day's lines come; 1 for days before the first."""
    return F.greatest(F.lit(1), F.least(F.lit(BATCHES), 1 + F.floor((day - FIRST_DAY) * BATCHES / DAYS))).cast("int")


def lines(sale_lines: DataFrame, vendors: DataFrame, items: DataFrame) -> DataFrame:
    """(nation_id, item_id, day, arrival_day, cents, batch) of every line. nation_id is null where the line is ignored: no nation or no item.

    A vendor or item that stands several times counts once: its least nation, its least price.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    h = F.crc32(F.concat_ws(",", *map(text, ("sale_id", "item_id", "vendor_id", "line_no"))).cast("binary"))
    day = F.coalesce(F.datediff(F.col("shipped_at").cast("date"), F.lit("1970-01-01").cast("date")).cast("long"), FIRST_DAY + h % 150)
    sign = F.when(F.col("flag") == "swapped", -1.0).otherwise(1.0)
    own = sale_lines.select(
        F.col("item_id").cast("long"), F.col("vendor_id").cast("long"), day.cast("int").alias("day"), (day + h % 7 + F.when(h % 5 == 0, 20).otherwise(0)).cast("int").alias("arrival_day"),
        (sign * F.floor(100 * F.col("amount").cast("double") + 0.5)).alias("cents"), F.when(F.col("amount").isNull(), sign * F.col("quantity")).alias("units"),
    )
    nations = vendors.where("vendor_id is not null").groupBy(F.col("vendor_id").cast("long").alias("vendor_id")).agg(F.min(F.col("nation_id").cast("int")).alias("nation"))
    prices = items.where("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min(F.col("price").cast("double")).alias("price"), F.lit(True).alias("listed"))
    cents = F.coalesce("cents", F.col("units") * F.floor(100 * F.col("price") + 0.5), F.lit(0.0))
    return (
        own.join(nations, "vendor_id", "left").join(prices, "item_id", "left")
        .select(F.when(F.col("listed"), F.col("nation")).alias("nation_id"), "item_id", "day", "arrival_day", cents.alias("cents"), batch_of(F.col("arrival_day")).alias("batch"))
    )


_SUMMED = "nation_id int, slice int, item_id long, day int, arrival_day int, end boolean, cents double"
_STATE = "days binary, items binary, cents binary, known binary, revenues binary, board binary"
_LOCAL = "nation_id int, slice int, arrival_day long, item_id long, revenue long"


def _names(schema: str) -> list[str]:
    return [f.split(" ")[0] for f in schema.split(", ")]


def _partly_summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's lines summed by item, day and arrival day: what a hot item adds to the shuffle doesn't grow with its lines.

    Of ignored lines only the days stay, which move the watermark.
    """
    for batch in batches:
        summed = pa.Table.from_batches([batch]).group_by(_names(_SUMMED)[:-1], use_threads=False).aggregate([("cents", "sum")]).rename_columns(_names(_SUMMED))
        yield from summed.combine_chunks().to_batches()


def _fold(days: np.ndarray, items: np.ndarray, cents: np.ndarray, known: np.ndarray, revenues: np.ndarray, board: np.ndarray, until: float) -> tuple[list[tuple], list[np.ndarray]]:
    """Folds buffered deltas of the days up to until, in order; the rows of each day's local board, with those who left it, and the state after it."""
    due = days <= until
    out = []
    if due.any():
        fresh = np.setdiff1d(items[due], known)
        if len(fresh):
            order = np.argsort(merged := np.concatenate([known, fresh]), kind="stable")
            known, revenues = merged[order], np.concatenate([revenues, np.zeros(len(fresh))])[order]
        for day in np.unique(days[due]):
            now = due & (days == day)
            np.add.at(revenues, np.searchsorted(known, items[now]), cents[now])
            top = np.lexsort((known, -revenues))[:PLACES] if len(known) <= 4 * PLACES else _top(known, revenues)
            top = known[top[revenues[top] > 0]]
            for item in np.union1d(top, board):
                out.append((int(day), int(item), int(revenues[np.searchsorted(known, item)])))
            board = top
    return out, [days[~due], items[~due], cents[~due], known, revenues, board]


def _top(known: np.ndarray, revenues: np.ndarray) -> np.ndarray:
    """Positions of the highest revenues, ties to smaller items."""
    least = np.partition(revenues, len(revenues) - PLACES)[len(revenues) - PLACES]
    at = np.flatnonzero(revenues >= least)
    return at[np.lexsort((known[at], -revenues[at]))][:PLACES]


_KINDS = (np.int64, np.int64, np.float64, np.int64, np.float64, np.int64)


def local_boards(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps a nation's slice: buffers accepted deltas by arrival day, with a timer at the earliest; when it fires, folds the days that are over, in order.

    Accepted means above the watermark as of the batches before: Spark itself would drop by the one of a batch earlier
    where no batch without data comes between. A sentinel ends all days.
    """
    held = [np.frombuffer(zlib.decompress(x), kind) for x, kind in zip(state.get, _KINDS, strict=True)] if state.exists else [np.empty(0, kind) for kind in _KINDS]
    watermark = state.getCurrentWatermarkMs()
    until = watermark / DAY_MS - AHEAD - 1 if watermark > 0 else -np.inf
    if not state.hasTimedOut:
        whole = pd.concat(list(parts))
        if whole["end"].any():
            until = np.inf
        fresh = whole[~whole["end"] & ((whole["day"].astype("int64") + AHEAD) * DAY_MS > watermark)]
        days = np.concatenate([held[0], fresh["arrival_day"].to_numpy(np.int64)])
        items = np.concatenate([held[1], fresh["item_id"].to_numpy(np.int64)])
        cents = np.concatenate([held[2], fresh["cents"].to_numpy(np.float64)])
        pairs, at = np.unique(np.stack([days, items]), axis=1, return_inverse=True)
        held[:3] = [pairs[0], pairs[1], np.bincount(at.reshape(-1), cents, pairs.shape[1])] if len(days) else [days, items, cents]
    rows, held = _fold(*[np.array(x) for x in held], until)
    state.update(tuple(zlib.compress(np.ascontiguousarray(x, kind).tobytes(), 1) for x, kind in zip(held, _KINDS, strict=True)))
    if len(held[0]):
        state.setTimeoutTimestamp(max(int(held[0].min() + AHEAD + 1) * DAY_MS, watermark + 1))
    if rows:
        found = pd.DataFrame(rows, columns=["arrival_day", "item_id", "revenue"])
        found.insert(0, "slice", np.int32(key[1]))
        found.insert(0, "nation_id", np.int32(key[0]))
        yield found


def changes(local: DataFrame) -> DataFrame:
    """The feed from local boards: a nation's board is the best of its slices', each as of its last day so far.

    There are PLACES rows or a few more for each slice and day, however many lines and items stand behind them.
    """
    own = local.select("nation_id", "slice", "arrival_day").distinct().withColumn("since", F.col("arrival_day"))
    days = own.select("nation_id", "arrival_day").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("nation_id").orderBy("arrival_day")))
    latest = F.last("since", ignorenulls=True).over(Window.partitionBy("nation_id", "slice").orderBy("nth"))
    spans = own.select("nation_id", "slice").distinct().join(days, "nation_id").join(own, ["nation_id", "slice", "arrival_day"], "left").withColumn("since", latest)
    seen = spans.join(local.withColumnRenamed("arrival_day", "since"), ["nation_id", "slice", "since"])
    place = F.row_number().over(Window.partitionBy("nation_id", "nth").orderBy(F.desc("revenue"), "item_id"))
    ranked = seen.select("nation_id", "nth", "arrival_day", "item_id", "revenue", F.when((F.col("revenue") > 0) & (place <= PLACES), place).alias("new_rank"))
    before = Window.partitionBy("nation_id", "item_id").orderBy("nth")
    # an item that has no row on a nation's day wasn't on its board then, nor on the local board
    was = F.when(F.lag("nth").over(before) == F.col("nth") - 1, F.lag("new_rank").over(before))
    change = F.when(F.col("old_rank").isNull(), "enter").when(F.col("new_rank").isNull(), "exit").otherwise("move")
    return ranked.withColumn("old_rank", was).where(~F.col("old_rank").eqNullSafe(F.col("new_rank"))).select("nation_id", "arrival_day", "item_id", batch_of(F.col("arrival_day")).alias("batch"), change.alias("change"), "old_rank", "new_rank", "revenue")


def feed(sale_lines: DataFrame, vendors: DataFrame, items: DataFrame, slices: int = SLICES) -> DataFrame:
    """Runs the lines through a stateful stream, batch by batch, and returns every change of a nation's board.

    The lines are cut into batches in the shared folder; for each the same query starts anew on one checkpoint and takes
    what has come. State is kept by nation and slice of items, so neither a nation nor an item with a third of all lines
    meets in one task: tasks sum what they read by item and day before the shuffle. A last batch of sentinels, one for each state, ends
    the days whose timers have not fired.

    Null keys: the line is ignored but moves the watermark. Null amounts and prices: see lines(). Repeated lines
    count each. Empty table: no rows. Other columns are ignored. An item of revenue 0 or less is on no board.
    """
    spark = sale_lines.sparkSession
    ship(spark)
    path = new_path(spark, "leaderboard")
    cut = materialize(lines(sale_lines, vendors, items), "lines", "batch")
    part = F.pmod(F.xxhash64("item_id"), F.lit(slices)).cast("int")
    fed = cut.select("nation_id", part.alias("slice"), F.when(F.col("nation_id").isNotNull(), F.col("item_id")).alias("item_id"), "day", F.when(F.col("nation_id").isNotNull(), F.col("arrival_day")).alias("arrival_day"), F.lit(False).alias("end"), "cents", "batch")
    keys = cut.where("nation_id is not null").select("nation_id").distinct().withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    ends = keys.select("*", F.lit(None).cast("long").alias("item_id"), F.lit(END).alias("day"), F.lit(None).cast("int").alias("arrival_day"), F.lit(True).alias("end"), F.lit(0.0).alias("cents"))
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        for n in range(1, BATCHES + 2):
            part = fed.where(F.col("batch") == n).drop("batch") if n <= BATCHES else ends
            part.write.mode("append").parquet(f"{path}/in")
            boards = stream(spark.readStream.schema(_SUMMED).parquet(f"{path}/in"))
            boards.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    local = spark.read.schema(_LOCAL).parquet(f"{path}/out")
    out = materialize(changes(local), "changes")
    delete(spark, path)
    discard(cut)
    return out


def stream(fed: DataFrame) -> DataFrame:
    """The rows of local boards from a stream of lines and sentinels, as they become final."""
    summed = fed.mapInArrow(_partly_summed, _SUMMED)
    # a line as late as allowed is still above the watermark, hence the half day more
    timed = summed.withColumn("seen", F.timestamp_millis((F.col("day") + AHEAD).cast("long") * DAY_MS)).withWatermark("seen", f"{LATE_DAYS * DAY_MS + DAY_MS // 2} milliseconds")
    return timed.where("nation_id is not null").groupBy("nation_id", "slice").applyInPandasWithState(local_boards, _LOCAL, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
