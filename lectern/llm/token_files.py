"""Token-id files: Arrow files of fixed-size-list batches, equal-length sequences with masks.

One pair of files a task, in ascending id order over the tasks:

* ``<name>.tokens.arrow``: record batches of ``ids fixed_size_list<uint16 or uint32>[L]`` and
  ``mask fixed_size_list<bool>[L]``; the tokens of the task's documents back to back, the last
  sequence filled up with 0 under a false mask. No compression, so a memory map reads any
  sequence and its mask in place: ids as a numpy view, masks as Arrow booleans, a bit a token.
* ``<name>.docs.arrow``: ``id, start, n_tokens`` of each document, start within the file.

A task writes under a name of its own attempt and the manifest lists the names of the attempts that
counted, so a task that is run again, or twice at once, does no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.store import scratch, small_batches, written
from lectern.llm.units import library_ids, slices

#: Sequences in a record batch.
BATCH = 512


def opened(uri: str, write: bool = False):
    """A stream on a file of the shared store, by whatever scheme its address has."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if write else store.open_input_file(path)


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them batch by batch; holds one batch at most."""

    def __init__(self, uri: str, dtype, length: int) -> None:
        import pyarrow as pa

        self.dtype, self.length, self.held, self.size, self.total = dtype, length, [], 0, 0
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = opened(uri, write=True)
        self.file = pa.ipc.new_file(self.sink, self.schema)

    def add(self, ids) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= BATCH * self.length:
            self.flush(False)

    def flush(self, last: bool) -> None:
        import numpy as np
        import pyarrow as pa

        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        step = BATCH * self.length
        for k in range(0, len(ids), step):
            some = ids[k : k + step]
            if len(some) < step and not last:
                break
            fill = -len(some) % self.length
            mask = np.ones(len(some) + fill, dtype=bool)
            mask[len(some) :] = False
            columns = [np.concatenate([some, np.zeros(fill, self.dtype)]) if fill else some, mask]
            self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(c), self.length) for c in columns], schema=self.schema))
        rest = len(ids) % step if not last else 0
        self.held, self.size = ([ids[-rest:].copy()], rest) if rest else ([], 0)

    def close(self) -> None:
        self.flush(True)
        self.file.close()
        self.sink.close()


class TokenFile:
    """Random access to the sequences of one token file, in place where the store has it as a local file; elsewhere a batch is read at a time."""

    def __init__(self, uri: str) -> None:
        import pyarrow as pa

        local = uri.removeprefix("file://") if uri.startswith(("file:", "/")) else None
        self.source = pa.memory_map(local) if local and not local.startswith("file:") else opened(uri)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.batch = None
        self.source.close()

    def held(self, k: int):
        """Batch ``k`` (all but the last hold ``BATCH`` sequences); the one read last is kept."""
        if k != self.at:
            self.at, self.batch = k, self.file.get_batch(k)
        return self.batch

    def sequence(self, i: int):
        """Ids and mask of sequence ``i``: a numpy view and an Arrow boolean array, neither copied from the batch."""
        batch, at = self.held(i // BATCH), i % BATCH * self.length
        return batch.column(0).flatten().slice(at, self.length).to_numpy(), batch.column(1).flatten().slice(at, self.length)

    def tokens(self, start: int, n: int):
        """Yields the ``n`` ids from token ``start`` of the file on, as views, a batch's share at a time."""
        step = BATCH * self.length
        while n:
            some = self.held(start // step).column(0).flatten()
            part = some.slice(start % step, n).to_numpy()
            yield part
            start, n = start + len(part), n - len(part)


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Write the files; returns the manifest ``part, tokens_path, docs_path, n_docs, n_tokens``, stored beside them, and the id's type.

    Documents are dealt by ranges of (id, hash of the text), so a repeated id does not fill one
    task. Order within an id is that of the texts. Null ids come first; null and empty texts
    hold the end id alone; repeated rows are written each; an empty table makes no files.
    """
    import pyarrow as pa

    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        coder, part, writer = library_ids(vocabulary), TaskContext.get().partitionId(), None
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}"
        end, n_docs = coder.dtype.type(end_id), 0
        for batch in batches:
            for some in slices(batch):
                if writer is None:
                    writer = SequenceWriter(f"{name}.tokens.arrow", coder.dtype, length)
                    schema = pa.schema([("id", some.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                    sink = opened(f"{name}.docs.arrow", write=True)
                    index = pa.ipc.new_file(sink, schema)
                flat, ends = coder.encode(some.column(1))
                edges = ends + np.arange(len(ends))  # an end id after each document
                flat = np.insert(flat, ends[1:], end)
                starts = (edges[:-1] + writer.total).tolist()
                sizes = np.diff(edges).tolist()
                writer.add(flat)
                index.write_batch(pa.RecordBatch.from_arrays([some.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=schema))
                n_docs += some.num_rows
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "tokens_path": f"{name}.tokens.arrow", "docs_path": f"{name}.docs.arrow", "n_docs": n_docs, "n_tokens": writer.total}])

    spark = docs.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(conf).mkdirs(place)
    manifest = src.mapInArrow(run, "part bigint, tokens_path string, docs_path string, n_docs bigint, n_tokens bigint")
    return written(manifest, f"{folder}/manifest.parquet"), kind


def read_token_files(manifest: DataFrame, kind: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` of every document, from the files alone; a task a file.

    ``start`` counts the ids of all documents before, over all files. The running sum is over the
    manifest, which has one row a file. A task holds one record batch, however long a document is. Null ids, empty documents
    (their end id alone) and repeated rows come back as they were written; an empty manifest gives an empty result;
    further columns of the manifest are not read.
    """
    import pyarrow as pa

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches):
        import zlib

        for batch in batches:
            for row in batch.to_pylist():
                with TokenFile(row["tokens_path"]) as tokens, opened(row["docs_path"]) as docs:
                    index = pa.ipc.open_file(docs)
                    for b in range(index.num_record_batches):
                        some, sums = index.get_batch(b), []
                        for start, n in zip(some.column(1).to_pylist(), some.column(2).to_pylist()):
                            crc = 0
                            for ids in tokens.tokens(start, n):
                                crc = zlib.crc32(ids.astype("<u4"), crc)
                            sums.append(crc)
                        start = pa.array(some.column(1).to_numpy() + row["base"])
                        yield pa.RecordBatch.from_arrays([some.column(0), start, some.column(2), pa.array(sums, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    # Ranges of ``part``, which is unique, so that no two files meet in one task while the manifest is small enough to be sampled whole.
    spread = files.select("part", "tokens_path", "docs_path", "base").repartitionByRange(max(1, manifest.count()), "part").select("tokens_path", "docs_path", "base")
    return spread.mapInArrow(run, f"`{id_col}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_file_round_trip(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 2, length: int = 2048) -> DataFrame:
    """Write all documents and read them back: ``doc_id, start, n_tokens, ids_crc32``.

    Null and empty texts are their end id alone; null ids come first; repeated rows are written each; an empty table
    gives an empty result; columns other than id and text are not read.
    """
    return read_token_files(*write_token_files(docs, vocabulary, scratch(spark, "token-files"), end_id, length))
