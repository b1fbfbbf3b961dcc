"""Ratings as a stateful stream: each member's rating is an entry of its pool's map state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ratings import COLUMNS, Ladder, _rows, play

OUTPUT = "pool string, gameid long, p double, diff double, target int, late boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Map state needs this store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rate(StatefulProcessor):
    """Reads and writes the ratings of those who play in the batch, and no others."""

    def __init__(self, ladder: Ladder):
        self.ladder = ladder

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ratings = handle.getMapState("ratings", "kind string, name string", "rating double")
        self.mark = handle.getValueState("mark", "date string, gameid long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf, games = _rows(pd.concat(list(rows)))
        mark = tuple(self.mark.get()) if self.mark.exists() else ("", -1)
        late = [(d, int(g)) <= mark for d, g in zip(pdf["date"], pdf["gameid"], strict=True)]
        applied = [g for g, x in zip(games, late, strict=True) if not x]
        names = {"member": {str(m) for g in applied for m in (*g[0], *g[1])}, "region": {r for g in applied for r in g[2:4]}}
        held = tuple({n: self.ratings.getValue((kind, n))[0] for n in names[kind] if self.ratings.containsKey((kind, n))} for kind in ("member", "region"))
        *seen, after = play(applied, self.ladder, held)
        for kind, before, now in zip(("member", "region"), held, after, strict=True):
            for name, rating in now.items():
                if before.get(name) != rating:
                    self.ratings.updateValue((kind, name), (float(rating),))
        if applied:
            last = max(k for k, x in enumerate(late) if not x)
            self.mark.update((pdf["date"].iloc[last], int(pdf["gameid"].iloc[last])))
        given = iter(seen)
        out = [(None, None) if x else next(given) for x in late]
        yield pd.DataFrame({"pool": key[0], "gameid": pdf["gameid"].to_numpy(), "p": [o[0] for o in out], "diff": [o[1] for o in out], "target": pdf["target"].to_numpy(), "late": late})

    def close(self) -> None:
        pass


def stream_ratings(games: DataFrame, ladder: Ladder) -> DataFrame:
    """Predict, then update, per micro-batch in (date, gameid) order.

    A game not after the last one that its pool has applied is given out as ``late`` without a
    prediction and leaves the state alone; a batch replay, or the store of ratings, settles it. A
    batch costs the state entries of its own players, however many members the pool has.
    """
    ready = games.select(*COLUMNS).withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return ready.groupBy("pool").transformWithStateInPandas(statefulProcessor=Rate(ladder), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def replay_stream(games: DataFrame, ladder: Ladder, path: str, files_per_trigger: int | None = None, resume: bool = False) -> DataFrame:
    """Run the stream over a written table until its input is used up; the sink as a table.

    With ``resume`` the games come on top of those of earlier calls, whose state goes on."""
    spark = games.sparkSession
    source, sink = f"{path}/games", f"{path}/rated"
    games.write.mode("append" if resume else "overwrite").parquet(source)
    read = spark.readStream.schema(games.schema)
    read = read.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else read
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = stream_ratings(read.parquet(source), ladder).writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    spark.streams.resetTerminated()
    out = spark.read.schema(OUTPUT).parquet(sink)
    out.progress = query.recentProgress
    return out
