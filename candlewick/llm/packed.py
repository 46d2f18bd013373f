"""Questions and answers between batches of texts and a partitioned table of hashes.

Some operators look up a number for almost every word or position of the corpus. A row per lookup would be many
times the corpus; here, documents are packed into batches (one compressed row of a few MB each), a batch
asks each partition once, with all its sorted keys in one compressed binary, and gets one binary back:

    staged = batches(docs)                      written once, bucketed by batch
    answers = ask(staged, question, answer, parts)
    staged joined with answers by batch         without another shuffle of the texts

Batches hold whole documents. Every step reads what the one before wrote to the shared folder, so a lost executor
costs its tasks only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.staging import shared_folder, stage
from candlewick.llm.common import narrow_batches, texts

ANSWERS = "batch bigint, part int, answer binary"


def parts(spark: SparkSession) -> int:
    """The cluster's number of shuffle partitions, which its owner sets by the amount of data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_ints(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of non-negative 64-bit integers, byte by byte, compressed."""
    import zstandard

    planes = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def read_ints(data: bytes, width: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def write_parts(*sections: bytes) -> bytes:
    return b"".join([len(sections).to_bytes(4, "little"), *(len(s).to_bytes(8, "little") for s in sections), *sections])


def read_parts(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    at, out = 4 + 8 * n, []
    for i in range(n):
        size = int.from_bytes(data[4 + 8 * i:12 + 8 * i], "little")
        out.append(data[at:at + size])
        at += size
    return out


def _pack(rows: list[tuple]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.large_binary())], names=["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> tuple[list, list[bytes]]:
    """doc_ids and UTF-8 texts of a batch."""
    with pa.ipc.open_stream(data) as r:
        b = r.read_next_batch()
    return b.column("doc_id").to_pylist(), b.column("text").to_pylist()


def batches(docs: DataFrame, batch_bytes: int, sample: Callable[[list[bytes]], bytes] | None = None) -> DataFrame:
    """batch, data and sample of every batch, from a table written to the shared folder and bucketed by batch."""
    spark = docs.sparkSession
    narrow_batches(spark)

    def run(arriving: Iterator[pa.RecordBatch]):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            data = _pack(held)
            mark = sample([t for _, t in held]) if sample else b""
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array([data], pa.binary()), pa.array([mark], pa.binary())],
                                              names=["batch", "data", "sample"])

        for b in arriving:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                held.append((doc_id, (text or "").encode()))
                size += len(held[-1][1]) + 16
                if size >= batch_bytes:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    made = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, "batch bigint, data binary, sample binary")
    n, name = parts(spark), f"llm_batches_{uuid.uuid4().hex}"
    (made.repartition(n, "batch").write.bucketBy(n, "batch").option("path", f"{shared_folder(spark)}/{name}").option("compression", "none")
     .format("parquet").saveAsTable(name))
    return spark.table(name)


def ask(asking: DataFrame, question: Callable, answer: Callable[[list[tuple[int, bytes]]], list[tuple[int, bytes]]]) -> DataFrame:
    """Answers, staged. ``question`` maps a row of ``asking`` to (part, question) pairs; ``answer`` a part's questions to answers."""

    def put(arriving):
        for b in arriving:
            for row in b.to_pylist():
                found = list(question(row))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([row["batch"]] * len(found), pa.int64()),
                                                      pa.array([q for _, q in found], pa.binary())], names=["part", "batch", "question"])

    def give(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        order = np.argsort(table.column("batch").to_numpy(), kind="stable")
        asked = [(table.column("batch")[int(i)].as_py(), table.column("question")[int(i)].as_py()) for i in order]
        got = answer(asked)
        return pa.table({"batch": pa.array([b for b, _ in got], pa.int64()), "part": pa.array([part] * len(got), pa.int32()), "answer": pa.array([a for _, a in got], pa.binary())})

    asked = asking.mapInArrow(put, "part int, batch bigint, question binary")
    return stage(asked.groupBy("part").applyInArrow(give, ANSWERS))


def joined(staged: DataFrame, answers: DataFrame, name: str = "answers") -> DataFrame:
    """Each batch with the list of its answers; both are bounded by the batch."""
    per = answers.where("batch >= 0").groupBy("batch").agg(F.collect_list(F.struct("part", "answer")).alias(name))
    return staged.join(per, "batch", "left")


def by_part(answers: list[dict] | None) -> dict[int, bytes]:
    return {a["part"]: a["answer"] for a in answers or []}
