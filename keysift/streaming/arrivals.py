"""Scanning files as they arrive.

Detection needs no state.  Which fingerprints are new does: they are kept in a store
beside the findings, one segment per stream and micro-batch.  A batch compares with
the fingerprints of all *other* batches, of other streams into the same folder too, and
replaces its own.  So a repeated batch (after a lost executor or a restart) writes the
same result again, and a stream that starts over with a new state finds nothing new in
files that were scanned before.  Segments are merged as they add up; a batch reads those hash
buckets that its own fingerprints fall into.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keysift.catalog import Rule
from keysift.operators.detect import detect, explode_secrets
from keysift.operators.findings import first_seen, new_secrets_by_file
from keysift.sources.fingerprints import FingerprintStore

# Segments of the store that are merged at a time.
COMPACT_EVERY = 16


def scan_arrivals(files: DataFrame, out_dir: str, state_dir: str, rules: Sequence[Rule] | None = None,
                  trigger: dict | None = None) -> StreamingQuery:
    """Write the findings of each micro-batch to ``out_dir/findings``.

    ``out_dir/seen`` is the store of fingerprints seen so far, which batch runs may share; ``state_dir`` is the stream's
    own checkpoint, whose lasting id names the stream.  Both belong on storage shared by
    the cluster, and one stream at a time may write there.  The first batch that brings a
    fingerprint owns it; within a batch the first file does.
    """
    found_dir = f"{out_dir}/findings"

    def scan_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        store = FingerprintStore(spark, f"{out_dir}/seen")
        new = store.take(first_seen(explode_secrets(detect(batch, rules=rules))), f"{stream}/{batch_id}")
        found = new_secrets_by_file(new).withColumn("key_count", F.size("secrets"))
        found.write.mode("overwrite").parquet(f"{found_dir}/stream={stream}/batch_id={batch_id}")
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            store.compact()

    return (files.writeStream.foreachBatch(scan_batch).option("checkpointLocation", state_dir)
            .trigger(**(trigger or {"availableNow": True})).start())
