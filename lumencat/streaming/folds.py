"""Stream forms of the counts and the work queue.

Each micro-batch is a step from one committed version of a small table to the next. The batch
number is the version, so a batch that runs again after a failure reads the same prior version and
replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lumencat.operators import counts, work_queue
from lumencat.sources.storage import SnapshotTable
from lumencat.streaming.age_parts import AgeParts


def _start(
    source: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None,
) -> StreamingQuery:
    return (
        source.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _before(table: SnapshotTable, batch_id: int) -> DataFrame:
    return table.read(table.current_version(before=batch_id))


def maintain_counts(
    changes: DataFrame, table: SnapshotTable, checkpoint: str, trigger: dict | None = None,
) -> StreamingQuery:
    """Counts per type kept up to date from a stream of change rows."""

    def step(batch: DataFrame, batch_id: int) -> None:
        table.commit(counts.apply_count_changes(_before(table, batch_id), batch), batch_id)

    return _start(changes, step, checkpoint, trigger)


def hand_out(
    messages: DataFrame, pending: AgeParts, claims_path: str, checkpoint: str,
    per_worker: int, workers: int, trigger: dict | None = None,
) -> StreamingQuery:
    """H1 + H2: every micro-batch enqueues its messages and hands the oldest pending ones out.

    A micro-batch writes its messages, its claims and the state of the open parts, and reads the
    oldest parts only; the rest of the backlog is not touched.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        open_parts = pending.add(batch, batch_id)
        queue = pending.oldest(open_parts, per_worker * workers)
        folder = f"{claims_path}/batch={batch_id}"
        none = queue.select("id").limit(0)
        work_queue.claim(queue, none, per_worker, workers, batch_id).drop("batch_id").write.mode("overwrite").parquet(folder)
        pending.taken(open_parts, queue, queue.sparkSession.read.parquet(folder), batch_id)

    return _start(messages, step, checkpoint, trigger)
