"""A crawl's sliding memory of SimHashes, as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..runtime import ship

#: State variables need a store with column families.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Hashes in an element of the list state; the memory is appended to and cut at its old end in such pieces.
PIECE = 512


class SlidingMemory(StatefulProcessor):
    """Marks rows whose hash differs in at most distance bits from one of the last `memory` rows of its key, and remembers every row.

    The state is a list of pieces, oldest first: packed hashes, and which places hold one. It is bounded by count: a piece goes once
    all of it is out of memory.
    """

    def __init__(self, key: str, distance: int, memory: int):
        self.key, self.distance, self.memory = key, distance, memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getListState("pieces", "hashes binary, held binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows)).sort_values("seq", kind="stable")
        held = whole["held"].to_numpy(bool)
        fresh = whole["bits"].to_numpy(np.int64).view(np.uint64)
        old = list(self.pieces.get()) if self.pieces.exists() else []
        before = np.concatenate([np.frombuffer(h, np.uint64) for h, _ in old]) if old else np.empty(0, np.uint64)
        known = np.concatenate([np.frombuffer(k, bool) for _, k in old]) if old else np.empty(0, bool)
        hashes, known = np.concatenate([before, fresh]), np.concatenate([known, held])
        duplicate = np.zeros(len(fresh), bool)
        for i in range(len(fresh)):
            at = len(before) + i
            lo = max(0, at - self.memory)
            if held[i]:
                near = np.bitwise_count(hashes[lo:at] ^ hashes[at]) <= self.distance
                duplicate[i] = bool((near & known[lo:at]).any())
        full = len(hashes) // PIECE * PIECE
        first = max(0, (len(hashes) - self.memory) // PIECE * PIECE)
        cut = lambda lo, hi: (hashes[lo:hi].tobytes(), known[lo:hi].tobytes())
        pieces = [cut(lo, lo + PIECE) for lo in range(first, full, PIECE)] + ([cut(full, len(hashes))] if full < len(hashes) else [])
        self.pieces.put(pieces)
        yield pd.DataFrame({self.key: [key[0]] * len(whole), "seq": whole["seq"].to_numpy(), "duplicate": duplicate})

    def close(self) -> None:
        pass


def sliding_duplicates(rows: DataFrame, key: str, seq: str, bits: str, distance: int = 3, memory: int = 8192) -> DataFrame:
    """(key, seq, duplicate) of a stream of crawls' rows, as dedupe.sliding_duplicates() gives for a table; rows of a batch go in order of seq.

    Start it with the settings in STORE. Rows must come in order of seq from batch to batch: what came is what is remembered.
    """
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    schema = f"{key} {kinds[key]}, seq {kinds[seq]}, duplicate boolean"
    # without nulls, since pandas would make fractions of whole numbers beside them
    own = rows.select(key, F.col(seq).alias("seq"), F.coalesce(F.col(bits).cast("long"), F.lit(0)).alias("bits"), F.col(bits).isNotNull().alias("held"))
    return own.groupBy(key).transformWithStateInPandas(SlidingMemory(key, distance, memory), schema, "Append", "None")
