"""New notes as a stream: each batch is parsed and appended; changes are recomputed in batch.

A file source delivers additions only, and a late note rewrites what was
"previous" for its keys, so change detection stays a batch question over the
appended mentions.  The tables have the layout of a built index, one version
folder that grows, so ``open_index`` and every question work on it meanwhile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import index


def stream_notes(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Reads whole Markdown files below ``root`` as they come and appends them to the index ``out``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    files = files.selectExpr("regexp_replace(path, '^file:/+', '/') as file_path", "make_valid_utf8(cast(content as string)) as markdown", "modificationTime as updated_at")

    version = f"{out.rstrip('/')}/v-stream"

    def append(batch: DataFrame, number: int) -> None:
        index.store(batch, root, version, f"/batch={number}")
        index.publish(batch.sparkSession, version, out, root)

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
