"""State of each site carried from batch to batch: fills over the edges of batches, and running facts of a site."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

_FACTS = T.StructType([T.StructField("last_hh", T.TimestampType()), T.StructField("last_kva", T.DoubleType()), T.StructField("first_hh", T.TimestampType()), T.StructField("points", T.LongType()), T.StructField("present", T.LongType())])
FILLED = "tx_id string, hh timestamp, kva double, filled double, time_idx long"
FACTS = "tx_id string, first_hh timestamp, last_hh timestamp, total_points long, non_nan_points long, fraction_non_nan double, last_kva double"


class _Site(StatefulProcessor):
    """Last reading with a value, extent and counts of one site."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("site", _FACTS)

    def _facts(self) -> list:
        return list(self.state.get()) if self.state.exists() else [None, None, None, 0, 0]

    def _take(self, facts: list, rows: pd.DataFrame) -> list:
        """The facts after these rows, which are in time order."""
        last_hh, last_kva, first_hh, points, present = facts
        times, values = rows["hh"].dropna(), rows["kva"].dropna()
        if len(times):
            last_hh = times.max() if last_hh is None else max(pd.Timestamp(last_hh), times.max())
            first_hh = times.min() if first_hh is None else min(pd.Timestamp(first_hh), times.min())
        if len(values):
            last_kva = float(values.iloc[-1])
        out = [None if x is None else pd.Timestamp(x).to_pydatetime() for x in (last_hh, first_hh)]
        return [out[0], last_kva, out[1], points + len(rows), present + len(values)]

    def close(self) -> None:
        pass


class _Fill(_Site):
    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        facts = self._facts()
        d = pd.concat(list(rows)).sort_values("hh", kind="stable", na_position="last")
        filled = d["kva"].ffill()
        yield pd.DataFrame({"tx_id": key[0], "hh": d["hh"], "kva": d["kva"], "filled": filled if facts[1] is None else filled.fillna(facts[1]), "time_idx": range(facts[3], facts[3] + len(d))})
        self.state.update(tuple(self._take(facts, d)))


class _Facts(_Site):
    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        facts = self._facts()
        for part in rows:  # a chunk at a time: only the last value depends on the order
            facts = self._in_any_order(facts, part)
        self.state.update(tuple(facts))
        last_hh, last_kva, first_hh, points, present = facts
        yield pd.DataFrame({"tx_id": [key[0]], "first_hh": [first_hh], "last_hh": [last_hh], "total_points": [points], "non_nan_points": [present], "fraction_non_nan": [present / points], "last_kva": [last_kva]})

    def _in_any_order(self, facts: list, part: pd.DataFrame) -> list:
        known, newest = facts[1], part.dropna(subset=["kva", "hh"])
        out = self._take(facts, part)
        late = len(newest) and facts[0] is not None and newest["hh"].max() < pd.Timestamp(facts[0])
        out[1] = known if late or not len(newest) else float(newest.loc[newest["hh"].idxmax(), "kva"])
        return out


def _stateful(readings: DataFrame, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    d = readings.where(F.col("tx_id").isNotNull()).select("tx_id", "hh", F.when(~F.isnan("kva"), F.col("kva")).alias("kva"))
    return d.groupBy("tx_id").transformWithStateInPandas(processor, schema, mode, "None")


def fill_forward(readings: DataFrame) -> DataFrame:
    """Streaming forward fill and running index of each site (append mode): tx_id, hh, kva, filled, time_idx.

    The state of a site is its last value and its counts, so a gap at the start of a batch takes the value that an earlier batch
    ended with. Files must come in time order by site, as half-hour files do; rows of one batch may be in any order.
    A batch's rows of one site are in memory together (a batch is what arrived since the last one). Rows without a site are
    dropped; equal times keep their order of arrival. Needs the RocksDB state store (``with_state_store``).
    """
    return _stateful(readings, _Fill(), FILLED, "append")


def site_facts(readings: DataFrame) -> DataFrame:
    """Streaming completeness, extent and last value of each site (update mode): a row for every site that a batch touches."""
    return _stateful(readings, _Facts(), FACTS, "update")


def with_state_store(spark) -> None:
    """State that outgrows memory: RocksDB, kept in the query's checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_facts(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; every batch appends the rows of the sites it touched, with its number, to ``out``. The newest
    row of a site (``latest``) is its state; a batch that is run again after a failure overwrites its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return df.writeStream.trigger(availableNow=True).outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()


def latest(facts: DataFrame) -> DataFrame:
    """The newest row of each site."""
    best = facts.groupBy("tx_id").agg(F.max_by(F.struct(*[c for c in facts.columns if c not in ("tx_id", "batch")]), "batch").alias("_b"))
    return best.select("tx_id", "_b.*")
