"""Linking of newly arriving records against a static target as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from geoweft.operators.linking import linked_output, place_candidates, user_records
from geoweft.options import LinkOptions


def link_stream(records: DataFrame, targets: DataFrame, out: str, checkpoint: str, options: LinkOptions | None = None, once: bool = True) -> StreamingQuery:
    """Each micro-batch of records is linked as a table is and written to out/batch=N. A batch that is run again after a
    failure overwrites its own folder, so every record is written once. targets: place_targets()."""
    o = options or LinkOptions()

    def write(batch: DataFrame, number: int) -> None:
        users = user_records(batch)
        linked_output(users, place_candidates(users, targets, o), o).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
