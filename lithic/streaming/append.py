"""Streams into snapshot tables: one commit a micro-batch, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mutations import merge
from ..sources.table import Table


def append_stream(stream: DataFrame, table: Table, checkpoint: str, upsert_key: str | None = None, **trigger):
    """Start a query that appends each micro-batch, or upserts it by a unique key.

    The manifest that holds a batch's rows also names the batch, so rows and number become
    visible together and a batch that is replayed after a failure isn't stored twice.  If
    another writer commits in between, the batch fails and is tried again by the stream's
    restart.  Returns the streaming query.
    """

    def store(batch: DataFrame, number: int) -> None:
        if number <= table.manifest().get("streams", {}).get(checkpoint, -1):
            return
        if upsert_key:
            merge(table, batch, upsert_key, stream={checkpoint: number})
        else:
            table.insert(batch, {checkpoint: number})

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def changes(table: Table, since: int, until: int | None = None) -> DataFrame:
    """Rows that differ between two snapshots, with ``_change`` insert or delete and ``_rowid``.

    Only fragments that were added, dropped or lost rows are read; an updated row
    is a delete and an insert of one id.
    """
    old, new = table.manifest(since), table.manifest(until)
    kept = {(f["id"], f["deleted"]) for f in old["fragments"]} & {(f["id"], f["deleted"]) for f in new["fragments"]}
    before, after = (table.scan(m, [f for f in m["fragments"] if (f["id"], f["deleted"]) not in kept], rows=True).drop("_rowaddr") for m in (old, new))
    both = before.columns if before.columns == after.columns else [c for c in after.columns if c in before.columns]
    gone = before.select(both).exceptAll(after.select(both)).withColumn("_change", F.lit("delete"))
    come = after.select(both).exceptAll(before.select(both)).withColumn("_change", F.lit("insert"))
    return gone.unionByName(come)
