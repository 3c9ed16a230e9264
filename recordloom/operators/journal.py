"""Journals and their checkpoints (M7): which rows a checkpoint covers, the hash of their artifacts, and what does not fit."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canon import canonical_json
from .prefix import last_value, pieced, running_sum, scanned, value_before

ZEROS = "0" * 64
#: The hash of no artifacts.
EMPTY = hashlib.sha256(b"[]").hexdigest()


def covered(artifacts: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """artifacts with `covers`: the sequence of the first checkpoint of their stream at or behind their own, null where none has come yet.

    artifacts: stream, first_sequence and others; checkpoints: stream, sequence.
    Each checkpoint covers the range behind the one before it.  Both tables are
    put in order together and the checkpoints' sequences are carried along by
    prefix, so a stream of any length is read by many tasks and no range is
    compared with all others.
    """
    names = [c for c in artifacts.columns if c != "covers"]
    rows = artifacts.select(*names, (-F.col("first_sequence")).alias("__back"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__at"))
    marks = checkpoints.select("stream", (-F.col("sequence")).cast("long").alias("__back"), F.lit(0).alias("__kind"), F.col("sequence").cast("long").alias("__at"))
    both = rows.withColumn("__back", F.col("__back").cast("long")).unionByName(marks, allowMissingColumns=True)
    out = scanned(pieced(both, ["stream"], ["__back", "__kind"]), ["stream"], [last_value("covers", F.col("__at"))])
    return out.where("__kind = 1").select(*names, "covers")


def set_hashes(rows: DataFrame) -> DataFrame:
    """stream, covers, artifacts (their number), set_hash: the hash of each range's artifacts (artifact_type, artifact_id, seal) as one JSON list in order.

    A list is hashed as it is read, in order, so a range of any length takes no
    memory; each range is a task's own.
    """
    entry = canonical_json({"artifact_id": F.col("artifact_id"), "artifact_type": F.col("artifact_type"), "seal": F.col("seal")})
    lined = rows.where("covers IS NOT NULL").select(F.col("stream").cast("string").alias("stream"), F.col("covers").cast("long").alias("covers"), entry.alias("entry"))
    lined = lined.repartition("stream", "covers").sortWithinPartitions("stream", "covers", "entry")

    def run(batches):
        key, sha, n = None, None, 0

        def done():
            sha.update(b"]")
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([n], pa.int64()), pa.array([sha.hexdigest()])], names=["stream", "covers", "artifacts", "set_hash"])

        for batch in batches:
            for stream, covers, entry in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (stream, covers) != key:
                    if sha is not None:
                        yield done()
                    key, sha, n = (stream, covers), hashlib.sha256(b"["), 0
                sha.update((b"," if n else b"") + entry.encode())
                n += 1
        if sha is not None:
            yield done()

    return lined.mapInArrow(run, "stream string, covers long, artifacts long, set_hash string")


def checkpoint_faults(checkpoints: DataFrame, journal: DataFrame, artifacts: DataFrame) -> DataFrame:
    """stream, sequence, artifacts, set_hash (both as recomputed) and faults of every checkpoint.

    checkpoints: stream, sequence, head_hash, artifact_set_hash,
    checkpoint_hash, previous_checkpoint_hash; journal: stream, sequence,
    record_hash; artifacts: stream, first_sequence, artifact_type, artifact_id,
    seal.  Faults, in this order: GENESIS (the first checkpoint is not at 0,
    with 64 zeros, no artifacts and none before it), SEQUENCE (one sequence
    twice), CHAIN (not the hash of the one before), POSITION (no journal row
    there), HEAD (another row's hash), ARTIFACT_SET.  A stream without
    checkpoints has no rows here.
    """
    order = ["sequence", "checkpoint_hash"]
    c = scanned(pieced(checkpoints.withColumn("stream", F.col("stream").cast("string")), ["stream"], order), ["stream"], [
        running_sum("__number", F.lit(1)), value_before("__hash", F.col("checkpoint_hash")), value_before("__before", F.col("sequence"))])
    rows = journal.select(F.col("stream").cast("string").alias("stream"), "sequence", F.col("record_hash").alias("__head")).dropDuplicates(["stream", "sequence"])
    made = set_hashes(covered(artifacts.withColumn("stream", F.col("stream").cast("string")), c.select("stream", "sequence")))
    out = c.join(rows, ["stream", "sequence"], "left").join(made.withColumnRenamed("covers", "sequence"), ["stream", "sequence"], "left")
    n, found = F.coalesce("artifacts", F.lit(0).cast("long")), F.coalesce("set_hash", F.lit(EMPTY))
    first = F.col("__number") == 1
    genesis = (F.col("sequence") == 0) & F.col("head_hash").eqNullSafe(ZEROS) & F.col("artifact_set_hash").eqNullSafe(EMPTY) & F.col("previous_checkpoint_hash").isNull()
    tests = [
        (first & ~genesis, "GENESIS"), (~first & (F.col("sequence") <= F.col("__before.value")), "SEQUENCE"), (~first & ~F.col("previous_checkpoint_hash").eqNullSafe(F.col("__hash.value")), "CHAIN"),
        (~first & F.col("__head").isNull(), "POSITION"), (~first & F.col("__head").isNotNull() & ~F.col("head_hash").eqNullSafe(F.col("__head")), "HEAD"),
        (~first & ~F.col("artifact_set_hash").eqNullSafe(found), "ARTIFACT_SET"),
    ]
    faults = F.filter(F.array(*[F.when(t, F.lit(f)) for t, f in tests]), lambda f: f.isNotNull())
    return out.select("stream", "sequence", n.alias("artifacts"), found.alias("set_hash"), faults.alias("faults"))
