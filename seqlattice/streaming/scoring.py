"""Seed search and re-alignment over a stream of reads: each micro-batch against a stored index and model, without state between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import loci
from ..operators.model import Model, apply_model
from ..operators.seed_index import SeedIndex, build_index, search_index
from ..plans.realign import records
from ..session import stored, temporary

LONGEST = 256  # bases of a read, where the index is built here


def search_stream(reads: DataFrame, genome: DataFrame | SeedIndex, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that appends the best places of each micro-batch of ``reads`` (read_id, seq) to Parquet at ``path``.

    ``genome`` is a stored index, or a genome whose index is built once here;
    batches scan no sequence and shuffle their own seeds only. A read's places
    depend on that read alone, so batches may be cut anywhere; each batch
    overwrites its own folder, so a batch that runs again after a failure
    leaves the same rows. Read the result with ``path``/batch=*.
    """
    index = genome if isinstance(genome, SeedIndex) else build_index(genome, LONGEST)

    def each(batch: DataFrame, number: int) -> None:
        with temporary():
            search_index(index, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def realign_batch(model: Model, genome, index: SeedIndex, reads: DataFrame) -> DataFrame:
    """SAM lines (chrom_idx, pos, line) of reads (read_id, name, seq, qual): searched, scored by the model, the best hit rendered."""
    reads = stored(reads)
    hits = stored(loci.hits_of(search_index(index, reads)))
    scored = stored(apply_model(model, genome, reads, hits, longest=index.longest))
    return records(scored, genome, reads)


def realign_stream(reads: DataFrame, model: Model, genome, index: SeedIndex, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that writes the SAM lines of each micro-batch of ``reads`` (read_id, name, seq, qual) as Parquet to a folder of its own under ``path``.

    The model was trained before, so a read's line depends on that read alone
    and is the one that realign_batch() gives over all reads at once. A batch
    that runs again overwrites its folder. Read the result with ``path``/batch=*.
    """

    def each(batch: DataFrame, number: int) -> None:
        with temporary():
            realign_batch(model, genome, index, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
