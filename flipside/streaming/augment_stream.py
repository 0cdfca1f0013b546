"""H5: incremental augmentation with Structured Streaming.

New sample files arriving in a folder are processed in micro-batches. An id is
augmented once: ids seen are the state of a streaming ``dropDuplicates``, kept
with the checkpoint, so that a late file or a file delivered twice adds
nothing, and a batch costs what its new rows cost. (The state grows by an id a
sample; for many ids the session should name the RocksDB state store.) Of rows
that share an id the first to arrive stays; within one batch, any.

A batch's new samples are written once, and the batch plan (E5) reads them
through ``foreachBatch``. The sink is keyed by ``batch_id``: a batch that is
run again after a failure replaces its own output. The checkpoint folder
records which files were consumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.score import TextModel
from ..params import Params
from ..plans.rounds import augment_rounds
from ..sources.stages import written

SAMPLE_SCHEMA = "id bigint, text string, label int"


def write_batch(batch: DataFrame, batch_id: int, output_dir: str, lexicon: DataFrame, model: TextModel, p: Params) -> None:
    """Augments a batch of new samples and replaces the sink's partition of ``batch_id``."""
    # read by several joins of the plan below, which mustn't each run the stateful part again
    samples = written(batch, "stream-batch")
    res = augment_rounds(samples, lexicon, model, p)
    (res.selected.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(output_dir))


def stream_augment(spark: SparkSession, input_dir: str, output_dir: str, checkpoint: str,
                   lexicon: DataFrame, model: TextModel, p: Params,
                   max_files_per_trigger: int | None = None):
    """Start the stream with an availableNow trigger (drains what is there,
    then stops). Returns the StreamingQuery."""
    reader = spark.readStream.schema(SAMPLE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    samples = reader.parquet(input_dir).dropDuplicates(["id"])
    return (samples.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, output_dir, lexicon, model, p))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
