"""A continuous stream of findings: release pairs in, stored findings out."""

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import jobs
from ..session import materialize, work_folder
from ..sources.archives import wanted_archives
from .changes import batch_name


def stream_findings(
    pairs: DataFrame,
    archive_tokens: Callable[[DataFrame], DataFrame],
    root: str,
    checkpoint: str,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    **trigger,
) -> StreamingQuery:
    """Diff each micro-batch of release pairs and store what it finds.

    ``archive_tokens`` gives a token table for a batch of pairs, of which only the rows of
    the batch's addresses are used.  The batch id names
    the folder a batch writes, so a repeated batch replaces its own rows: every finding
    is stored exactly once.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        with work_folder(batch.sparkSession, f"{root}/_work/batch={batch_id}"):
            kept = materialize(batch, "pairs")
            found = wanted_archives(archive_tokens(kept), kept)
            jobs.publish(jobs.diff_pairs(kept, found), root, batch_name(batch_id), clock())

    return (
        pairs.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
