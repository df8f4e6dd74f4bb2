"""Token counts of flat, unindexed token files by a separator scan.

A token file is a run of little-endian unsigned integers in which an end-of-document identifier closes every
document. The files are cut into blocks; the separators of a block are found in one vectorised comparison. A
prefix scan over one summary row per block carries the open document's tokens across block boundaries, so a
document may span any number of blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footlamp.llm.registry import query, table
from footlamp.plans.storage import cut_lineage, scratch_dir

#: The identifier that ends a document, and the kind of the integers.
END = 50256
KIND = "uint16"
#: Tokens in a block of the scan, and tokens after which the writer begins a new file.
BLOCK_TOKENS = 1 << 18
FILE_TOKENS = 1 << 23


def _scan(kind: str, end: int, block_tokens: int):
    width = np.dtype(kind).itemsize

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                if len(data) % width:
                    raise ValueError(f"{name} ends inside a token")
                tokens = np.frombuffer(data, dtype=np.dtype(kind).newbyteorder("<"))
                for block, at in enumerate(range(0, max(1, len(tokens)), block_tokens)):
                    part = tokens[at : at + block_tokens]
                    ends = np.nonzero(part == end)[0]
                    head = int(ends[0]) if len(ends) else len(part)
                    tail = len(part) - int(ends[-1]) - 1 if len(ends) else len(part)
                    inner = np.diff(ends) - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([head], pa.int64()),
                         pa.array([tail], pa.int64()), pa.array([inner.astype(np.int64)], pa.list_(pa.int64()))],
                        ["file", "block", "ends", "head", "tail", "inner"],
                    )

    return scan


def block_summaries(spark: SparkSession, path: str, kind: str = KIND, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row per block: number of separators, tokens before the first and after the last, and the lengths between."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), "content").mapInArrow(
        _scan(kind, end, block_tokens), "file string, block bigint, ends bigint, head bigint, tail bigint, inner array<bigint>"
    )


def count_tokens(spark: SparkSession, path: str, kind: str = KIND, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``file, doc_no, n_tokens, closed``: a row for every document of the files below ``path``, in file order.

    ``n_tokens`` leaves the separator out; documents without a token count 0. Tokens after the last separator of a
    file are one more document, with ``closed`` false. An empty file has no document; a file that ends inside a token fails.
    A file is read by one task (it is cut only after Spark has read it), so it has to be below 2 GB; its windows
    hold a row per block.
    """
    blocks = cut_lineage(block_summaries(spark, path, kind, end, block_tokens))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Prefix scan: tokens since the last separator before a block are the running sum of tails, less the sum up to that
    # separator. A block without one adds all its tokens; a block with one starts again from its tail.
    whole = F.sum(F.when(F.col("ends") == 0, F.col("tail")).otherwise(0)).over(before)
    scanned = blocks.withColumn("open", F.coalesce(whole, F.lit(0))).withColumn("first_doc", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    last = F.last(F.when(F.col("ends") > 0, F.struct("tail", "open")), ignorenulls=True).over(before)
    scanned = scanned.withColumn("last", last)
    carry = F.when(F.col("last").isNull(), F.col("open")).otherwise(F.col("last.tail") + F.col("open") - F.col("last.open"))
    scanned = scanned.withColumn("carry", carry)
    first = F.array(F.col("carry") + F.col("head"))
    closed = scanned.where("ends > 0").select("file", "first_doc", F.posexplode(F.concat(first, "inner")).alias("i", "n_tokens"))
    closed = closed.select("file", (F.col("first_doc") + F.col("i")).alias("doc_no"), "n_tokens", F.lit(True).alias("closed"))
    left = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    at_end = scanned.groupBy("file").agg(F.max_by(F.struct(left.alias("left"), (F.col("first_doc") + F.col("ends")).alias("doc_no")), "block").alias("e"))
    rest = at_end.where("e.left > 0").select("file", F.col("e.doc_no").alias("doc_no"), F.col("e.left").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def write_token_files(docs: DataFrame, path: str, ranks_path: str, pattern: str, kind: str = KIND, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise documents into flat files below ``path`` and return ``file, doc_no, doc_id``, which is stored.

    A task writes its documents in order and begins a new file at a document's end once ``FILE_TOKENS`` are in it. A file
    gets its name, which carries the task's attempt, when it is whole. A lost task is run again under new names, and
    the result names the files of attempts that finished, so joining with it leaves out all others. Null texts are
    empty documents.
    """
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        task = TaskContext.get()
        encoding, out, name, held, docs_, n_file = None, None, "", 0, [], 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if encoding is None:
                    encoding = tiktoken.Encoding("flat", pat_str=shared.value[1], mergeable_ranks=shared.value[0], special_tokens={})
                if out is None:
                    name = f"part-{task.partitionId():06d}-{n_file:04d}-{task.taskAttemptId()}.bin"
                    store.create_dir(root, recursive=True)
                    out, held, docs_, n_file = store.open_output_stream(f"{root}/{name}.open"), 0, [], n_file + 1
                ids = encoding.encode_ordinary(value.as_py()) if value.is_valid else []
                ids.append(end)
                out.write(np.array(ids, dtype=np.dtype(kind).newbyteorder("<")).tobytes())
                docs_.append(doc_id)
                held += len(ids)
                if held >= FILE_TOKENS:
                    out.close()
                    store.move(f"{root}/{name}.open", f"{root}/{name}")
                    yield _named(name, docs_)
                    out = None
        if out is not None:
            out.close()
            store.move(f"{root}/{name}.open", f"{root}/{name}")
            yield _named(name, docs_)

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    written = cut_lineage(rows.mapInArrow(write, "file string, doc_no bigint, doc_id bigint"))
    return written


def _named(name: str, docs_: list) -> pa.RecordBatch:
    n = len(docs_)
    return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(n)), pa.array(docs_, pa.int64())], ["file", "doc_no", "doc_id"])


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, and the length that the scan finds for every one."""
    import public_tokenizers

    path = scratch_dir(spark, "tokens")
    written = write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = count_tokens(spark, path)
    return written.join(found, ["file", "doc_no"]).select("doc_id", "n_tokens", "closed")
