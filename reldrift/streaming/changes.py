"""Version changes on a stream of polls, in two forms.

:func:`stream_changes_by_batch` runs the batch operators on each micro-batch and keeps the
last-seen table as runs that only moved packages are written to: no package's polls are
gathered, whatever its share.  :func:`stream_version_changes` keeps the last version as
operator state and answers sooner; a package's polls of a micro-batch are taken in time
order one after the other, and beyond ``HOLD`` of them wait in the operator's state store.
"""

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import changes
from ..operators.changes import KEY
from ..session import materialize, work_folder
from ..sources import tables
from ..sources.lastseen import LastSeen

# tasks carry this module's code with them
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOLD = 20_000  # polls of one package a task holds at a time
_OUTPUT = (
    "ecosystem string, name string, version string, prev_version string, "
    "polled_at timestamp_ntz, event_id bigint"
)
#: Places are told apart by ever finer pieces of (microsecond, event).
_TIME_SHIFTS, _EVENT_SHIFTS = (40, 32, 24, 16, 8, 0), (48, 32, 16, 0)


def _slots(polls, level: int):
    """The stretch of time, or of events of one microsecond, each poll falls into."""
    if level < len(_TIME_SHIFTS):
        return polls["at"].to_numpy() >> _TIME_SHIFTS[level]
    return polls["event_id"].to_numpy() >> _EVENT_SHIFTS[level - len(_TIME_SHIFTS)]


class ChangesOfPackage(StatefulProcessor):
    """Compares the polls of a package in order of (time, event), starting from its stored version.

    Up to ``HOLD`` polls are sorted as they are.  More are laid into stretches of time kept in
    a state map, by pieces of ``HOLD`` at most; the stretches are then taken in order, and one
    of more than ``HOLD`` polls is laid into finer ones first.  The map is empty again when a
    batch ends.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last_version", "version string")
        self._pieces = handle.getMapState("pieces", "level int, slot bigint, piece int", "polls binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        # a package has few polls in most batches, so they are arrays: a frame costs more than its rows
        stored = self._last.get()
        last = first = stored[0] if stored is not None else None
        for at, event_id, latest in self._in_order(rows):
            previous = np.empty(len(latest), dtype=object)
            previous[0], previous[1:] = last, latest[:-1]
            last = latest[-1]
            changed = np.flatnonzero((previous != latest) & (previous != np.array(None)))
            if len(changed):
                yield pd.DataFrame({
                    "ecosystem": key[0], "name": key[1], "version": latest[changed], "prev_version": previous[changed],
                    "polled_at": at[changed].view("datetime64[us]"), "event_id": event_id[changed],
                })
        if last != first:
            self._last.update((last,))

    def close(self) -> None:
        pass

    def _in_order(self, rows) -> Iterator:
        """Arrays of polls (time, event, version), one after the other in order, of some ``HOLD`` rows at most."""
        import numpy as np
        import pandas as pd

        def frame():
            return pd.DataFrame({name: np.concatenate([h[k] for h in held]) for k, name in enumerate(("at", "event_id", "latest"))})

        held, n, known = [], 0, {}
        for frame_ in rows:
            cells = [frame_[c].to_numpy() for c in ("polled_at", "event_id", "latest")]
            there = ~(pd.isna(cells[0]) | pd.isna(cells[1]) | pd.isna(cells[2]))
            at, event_id, latest = cells if there.all() else [c[there] for c in cells]
            held.append((at.astype("datetime64[us]").view("int64"), event_id.astype("int64"), latest))
            n += len(latest)
            if n > HOLD:
                self._lay(frame(), 0, known)
                held, n = [], 0
        if not known:
            if n:
                yield _sorted(*(np.concatenate([h[k] for h in held]) for k in range(3)))
            return
        if n:
            self._lay(frame(), 0, known)
        yield from self._taken(0, known)

    def _lay(self, polls, level: int, known: dict) -> None:
        """Put polls into the stretches of a level; ``known`` has the pieces and rows of each."""
        for slot, part in polls.groupby(_slots(polls, level), sort=False):
            pieces, n = known.get(slot, (0, 0))
            self._pieces.updateValue((level, int(slot), pieces), (_packed(part),))
            known[slot] = (pieces + 1, n + len(part))

    def _taken(self, level: int, known: dict) -> Iterator:
        import pandas as pd

        for slot in sorted(known):
            pieces, n = known[slot]
            finest = level + 1 == len(_TIME_SHIFTS) + len(_EVENT_SHIFTS)
            parts = (self._take(level, int(slot), i) for i in range(pieces))
            if n <= HOLD or finest:
                polls = pd.concat(list(parts), ignore_index=True)
                yield _sorted(*(polls[c].to_numpy() for c in ("at", "event_id", "latest")))
                continue
            finer = {}
            for part in parts:
                self._lay(part, level + 1, finer)
            yield from self._taken(level + 1, finer)

    def _take(self, level: int, slot: int, piece: int):
        place = (level, slot, piece)
        polls = _unpacked(self._pieces.getValue(place)[0])
        self._pieces.removeKey(place)
        return polls


def _sorted(at, event_id, latest):
    import numpy as np

    order = np.lexsort((event_id, at))
    return at[order], event_id[order], latest[order]


def _packed(polls) -> bytes:
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(polls[["at", "event_id", "latest"]], preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(bytes(data)).read_pandas()


def stream_version_changes(polls: DataFrame) -> DataFrame:
    """Streaming polls -> changes; the first sight of a package is silent.

    State is one version per package, and between batches nothing else.  The session must
    use the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    if polls.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    return polls.groupBy(*KEY).transformWithStateInPandas(ChangesOfPackage(), _OUTPUT, "append", "none")


def batch_name(batch_id: int) -> str:
    """The cycle name of a micro-batch; names ascend with the ids."""
    return f"batch-{batch_id:012d}"


def stream_changes_by_batch(polls: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Streaming polls -> ``<root>/changes``, with the last-seen table under ``<root>/watched``.

    A batch looks up the packages it polled in the table as of the batch before it, and
    writes its changes and the packages that moved; so a repeated batch gives the same
    result, and a batch costs what it moves.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, batch_name(batch_id)
        watched = LastSeen(spark, root)
        with work_folder(spark, f"{root}/_work/{name}"):
            seen = materialize(changes.with_last_seen(batch), "polls")
            known = watched.look_up(seen, batch_name(batch_id - 1)) if batch_id else tables.read_watched(spark, root, None)
            first = seen.where(F.col("prev_version").isNull())
            first = changes.look_up_last_seen(first.drop("prev_version"), known)
            first = first.withColumn("prev_version", F.nullif("last_seen", F.lit(""))).drop("last_seen")
            found = materialize(seen.where(F.col("prev_version").isNotNull()).unionByName(first), "compared")
            new = F.col("latest") != F.col("prev_version")
            changed = found.where(new).select(*KEY, F.col("latest").alias("version"), "prev_version", "polled_at", "event_id")
            tables.write_cycle(changed, root, "changes", name)
            newest = found.where(F.col("prev_version").isNull() | new).groupBy(*KEY).agg(F.max(F.struct("polled_at", "event_id", "latest")).alias("m"))
            moved = newest.select(*KEY, F.col("m.latest").alias("last_version"), F.col("m.polled_at").cast("timestamp").alias("updated_at"))
            watched.record(materialize(moved, "moved"), name)

    return (
        polls.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
