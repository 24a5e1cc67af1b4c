"""The per-stream log as a streaming state processor: appends and exact, idempotent releases in one keyed state.

The input is one stream of commands (stream_id, kind, order, seq, payload_len), ``kind`` being append or release.
Rows of a micro-batch come unordered, so the processor sorts by ``order``.  An append gets the next sequence; a
release of a sequence above the highwater is rejected, a release of one that is gone already succeeds without effect.
State: highwater, pending bytes, and a map of pending sequences to payload lengths, kept by the state store, so a
restart from the checkpoint replays nothing that was committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.storage import shared_dir

OUTPUT = "stream_id long, highwater long, pending_records long, pending_payload_bytes long, released long, ignored long, rejected long"


class StreamLog(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "highwater long, records long, bytes long, released long, ignored long, rejected long")
        self.pending = handle.getMapState("pending", "seq long", "payload_len long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        high, records, size, released, ignored, rejected = self.head.get() if self.head.exists() else (-1, 0, 0, 0, 0, 0)
        # a trigger is bounded (``cut``), and so is what a stream has in it
        frame = pd.concat(list(rows)).sort_values("order", kind="stable")
        fresh: dict[int, int] = {}  # what this batch appends and has not released: one state call a row, or none
        for kind, seq, length in zip(frame["kind"].tolist(), frame["seq"].tolist(), frame["payload_len"].tolist()):
            if kind == "append":
                high += 1
                fresh[high] = length
                records, size = records + 1, size + length
            elif seq > high or seq < 0:
                rejected += 1
            else:
                gone = fresh.pop(seq, None)
                if gone is None:
                    held = self.pending.getValue((seq,)) if self.pending.containsKey((seq,)) else None
                    if held is None:
                        ignored += 1
                        continue
                    gone = held[0]
                    self.pending.removeKey((seq,))
                size, records, released = size - gone, records - 1, released + 1
        for seq, length in fresh.items():
            self.pending.updateValue((seq,), (length,))
        self.head.update((high, records, size, released, ignored, rejected))
        yield pd.DataFrame([(key[0], high, records, size, released, ignored, rejected)], columns=["stream_id", "highwater", "pending_records", "pending_payload_bytes", "released", "ignored", "rejected"])

    def close(self) -> None:
        pass


def log_state(commands: DataFrame) -> DataFrame:
    """The state of each touched stream after every micro-batch (update mode).  Needs the RocksDB state store."""
    return commands.groupBy("stream_id").transformWithStateInPandas(StreamLog(), OUTPUT, "Update", "None")


def cut(commands: DataFrame, size: int = 1_000_000) -> list[DataFrame]:
    """Batches of ``size`` orders each, in order: what one trigger takes does not grow with the table."""
    ends = commands.agg(F.min("order").alias("a"), F.max("order").alias("b")).first()
    if ends.a is None:
        return []
    return [commands.where(F.col("order").between(at, at + size - 1)) for at in range(ends.a, ends.b + 1, size)]


def drain(spark: SparkSession, batches: list[DataFrame]) -> DataFrame:
    """The final state after the batches of commands, one after the other, each drained and then restarted from the
    checkpoint.  Source, checkpoint and sink are in the shared folder.  A batch is a
    trigger, so ``cut`` large tables of commands first."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def keep(state: DataFrame, batch: int) -> None:
        state.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    for commands in batches:
        commands.write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(commands.schema).parquet(f"{base}/in")
        log_state(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(f"{OUTPUT}, batch long").parquet(f"{base}/out")
    return out.groupBy("stream_id").agg(F.max_by(F.struct(*(c.split()[0] for c in OUTPUT.split(", ")[1:])), "batch").alias("s")).select("stream_id", "s.*")
