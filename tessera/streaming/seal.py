"""The seal as a stream: log files in, snapshots out, each batch once.

State is the snapshot and the sequence number it is sealed to, in a file of its own that
is written last; the newest whole one holds and none is replaced.  A batch that is
replayed brings only entries that are sealed already, so it changes nothing.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources import changelog
from tessera.sources.table_store import file_system, read_small


class Sealed:
    """Snapshots under a folder; ``current-N`` holds one line: path, sealed_seq and an end mark."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str]):
        self.spark, self.folder, self.schema, self.keys = spark, folder.rstrip("/"), schema, keys

    def _state(self) -> tuple[str | None, int]:
        fs, at = file_system(self.spark, self.folder)
        found = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        for name in sorted((n for n in found if re.fullmatch(r"current-\d{20}", n)), reverse=True):
            parts = (read_small(self.spark, f"{self.folder}/{name}") or b"").decode().split()
            if len(parts) == 3:  # else begun and not ended
                return parts[0], int(parts[1])
        return None, 0

    @property
    def sealed_seq(self) -> int:
        return self._state()[1]

    def read(self) -> DataFrame:
        name, _ = self._state()
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}") if name else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, _batch_id: int = 0) -> None:
        name, sealed = self._state()
        new = batch.where(F.col("seq") > sealed)
        top = new.agg(F.max("seq")).first()[0]
        if top is None:
            return
        fresh = f"snapshot-{top}-{uuid.uuid4().hex[:8]}"
        changelog.merge(self.read(), new, self.keys).write.parquet(f"{self.folder}/{fresh}")
        fs, at = file_system(self.spark, f"{self.folder}/current-{top:020d}")
        stream = fs.create(at, True)  # over one that was begun and not ended, at most
        stream.write(bytearray(f"{fresh} {top} end".encode()))
        stream.close()


def start(spark: SparkSession, log_folder: str, log_schema: str, sealed: Sealed, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Seals whatever log files arrive; without an interval, all that are there now, and ends."""
    stream = spark.readStream.schema(log_schema).parquet(log_folder)
    writer = stream.writeStream.foreachBatch(sealed.apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
