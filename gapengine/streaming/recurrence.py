"""Running recurrence on a stream: how many earlier incidents each incident's implied families already hit.

Two stateful steps.  The first is keyed by incident: it lets an incident ask
once and count once per family, however often it returns.  The second is keyed
by (family, slice) and holds the incidents seen and their number.  There are few
families, so each is dealt over slices: a gap goes to one slice of its family, a
question to all of them, and the answers are added up behind.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gapengine.operators.history import implied_families
from gapengine.streaming.intake import append_batch

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Parts of one family: as many tasks can work on a family that all incidents hit.
SLICES = 16


class FirstTimes(StatefulProcessor):
    """Keyed by incident: its questions when it is first seen, and its first gap in each family."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.asked = handle.getValueState("asked", "asked boolean")
        self.families = handle.getMapState("families", "family_key string", "arrival bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        out = []
        first = frame.iloc[0]
        if not self.asked.exists():
            self.asked.update((True,))
            # No implied family: one question that nothing answers, so that the incident has its row.
            families = [str(f) for f in first["asks"]] if first["asks"] is not None else []
            out += [(f, int(first["arrival"]), 0) for f in families or [""]]
        for family, arrival in zip(frame["family_key"], frame["arrival"]):
            if family and not self.families.containsKey((family,)):
                self.families.updateValue((family,), (int(arrival),))
                out.append((str(family), int(arrival), 1))
        if out:
            families, arrivals, gaps = zip(*out)
            yield pd.DataFrame({"incident_id": key[0], "family_key": families, "arrival": arrivals, "is_gap": gaps})


class SeenBefore(StatefulProcessor):
    """Keyed by (family, slice): for each question the incidents of the slice seen before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n bigint, latest bigint")
        self.seen = handle.getMapState("seen", "incident_id string", "arrival bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["arrival", "incident_id", "is_gap"], ignore_index=True)
        n, latest = self.total.get() if self.total.exists() else (0, None)
        gaps, arrivals = frame["is_gap"].to_numpy(), frame["arrival"].to_numpy()
        before = np.full(len(frame), n)
        late = arrivals <= latest if n else np.zeros(len(frame), dtype=bool)
        if (late & (gaps == 0)).any():
            # Only questions older than something seen look at the incidents one by one.
            known = sorted((value[0], name[0]) for name, value in self.seen.iterator())
            for at in np.flatnonzero(late & (gaps == 0)):
                before[at] = bisect_left(known, (arrivals[at], frame["incident_id"].iloc[at]))
        before = before + np.cumsum(gaps) - gaps
        for name, arrival in frame.loc[gaps == 1, ["incident_id", "arrival"]].itertuples(index=False):
            self.seen.updateValue((name,), (int(arrival),))
        if gaps.any():
            newest = int(arrivals[gaps == 1].max())
            self.total.update((int(n + gaps.sum()), newest if latest is None else max(newest, int(latest))))
        asks = gaps == 0
        yield pd.DataFrame({"incident_id": frame["incident_id"][asks], "family_key": key[0], "n": before[asks].astype("int64")})


def seen_before(stream: DataFrame, slices: int = SLICES) -> DataFrame:
    """STR-3: (incident_id, family_key, n), one row for each slice of each family an incident asks about.

    ``stream``: incident_id string, arrival bigint, family_key (null without gap)
    and signals.  An incident asks when it is first seen; gaps that arrive later
    count from then on, at their own place in (arrival, incident)."""
    facts = stream.select("incident_id", F.col("arrival").cast("bigint").alias("arrival"), "family_key", implied_families(F.col("signals")).alias("asks"))
    firsts = facts.filter("incident_id is not null and arrival is not null").groupBy("incident_id").transformWithStateInPandas(
        FirstTimes(), "incident_id string, family_key string, arrival bigint, is_gap int", "Append", "None"
    )
    own = F.array(F.pmod(F.xxhash64("incident_id"), F.lit(slices)).cast("int"))
    every = F.when(F.col("family_key") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(slices - 1)))
    dealt = firsts.withColumn("slice", F.explode(F.when(F.col("is_gap") == 1, own).otherwise(every)))
    return dealt.groupBy("family_key", "slice").transformWithStateInPandas(
        SeenBefore(), "incident_id string, family_key string, n bigint", "Append", "None"
    )


def start_recurrence(stream: DataFrame, path: str, checkpoint: str, slices: int = SLICES, available_now: bool = True):
    """STR-3: append (incident_id, similar_incidents), as each incident arrives, to ``path``.

    All answers to a question come in its own batch, so they are added up there.
    State lives in RocksDB and is restored from ``checkpoint`` after a restart.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        per_family = batch.groupBy("incident_id", "family_key").agg(F.sum("n").alias("n"))
        append_batch(per_family.groupBy("incident_id").agg(F.max("n").alias("similar_incidents")), batch_id, path)

    writer = seen_before(stream, slices).writeStream.foreachBatch(on_batch).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def recurrence_so_far(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("incident_id", "similar_incidents")
