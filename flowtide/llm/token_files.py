"""Token ids in Arrow files of fixed-size lists: any sequence is found by its number, without a copy.

A shard holds the documents of one range partition, in order, as two files: ``*.tokens.arrow``
(``ids`` and ``mask``, 1 or 0, fixed-size lists of ``length``, the same number of them in each batch but the last) and ``*.docs.arrow`` (where each document
lies).  The last sequence of a shard is padded; its mask tells.  Masks are dictionary-encoded: a shard has two at most,
that of a full sequence and that of the last.  Files are uncompressed, so a reader maps them and slices.  A task writes under a name of its own attempt and then renames;
a repeated attempt replaces the file by the same content.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from flowtide.llm.common import text_rows
from flowtide.llm.tokens import encoder, portions

DOCS = pa.schema([("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64())])
SEQUENCES_PER_BATCH = 256


def _store(folder: str):
    """File system and path of a folder named by a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def tokens_schema(length: int, id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(id_type, length)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), length)))])


class _Shard:
    """Two Arrow files being written."""

    def __init__(self, folder: str, name: str, length: int, id_type: pa.DataType) -> None:
        self.fs, self.folder = _store(folder)
        self.name, self.length, self.type = name, length, id_type
        self.attempt = uuid.uuid4().hex
        self.fs.create_dir(self.folder, recursive=True)
        self.out = {k: self.fs.open_output_stream(self._path(k, self.attempt)) for k in ("tokens", "docs")}
        # The mask of the last sequence is known, and added to the dictionary, at the end only.
        options = pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True)
        self.tokens = pa.ipc.new_file(self.out["tokens"], tokens_schema(length, id_type), options=options)
        self.docs = pa.ipc.new_file(self.out["docs"], DOCS)
        self.held: list[np.ndarray] = []
        self.waiting = 0
        self.total = 0

    def _path(self, kind: str, attempt: str = "") -> str:
        return f"{self.folder}/{self.name}.{kind}.arrow{attempt and '.' + attempt}"

    def add(self, doc_ids: pa.Array, found: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        self.docs.write(pa.record_batch([doc_ids, pa.array(self.total + np.cumsum(sizes) - sizes), pa.array(sizes)], schema=DOCS))
        self.held += found
        self.waiting += int(sizes.sum())
        self.total += int(sizes.sum())
        if self.waiting >= SEQUENCES_PER_BATCH * self.length:
            self._flush(final=False)

    def _flush(self, final: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, dtype=np.uint32)
        whole = SEQUENCES_PER_BATCH * self.length
        sequences = -(-len(flat) // self.length) if final else len(flat) // whole * SEQUENCES_PER_BATCH
        used = min(sequences * self.length, len(flat))
        ids = np.zeros(sequences * self.length, dtype=self.type.to_pandas_dtype())
        ids[:used] = flat[:used]
        padded = used < len(ids)
        masks = np.ones((1 + padded) * self.length, dtype=np.uint8)
        if padded:
            masks[self.length :] = np.arange(self.length) < used % self.length
        which = np.zeros(sequences, dtype=np.int8)
        which[-1:] = padded
        lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x), self.length)
        for at in range(0, sequences, SEQUENCES_PER_BATCH):
            end = at + SEQUENCES_PER_BATCH
            mask = pa.DictionaryArray.from_arrays(pa.array(which[at:end]), lists(masks))
            self.tokens.write(pa.record_batch([lists(ids[at * self.length : end * self.length]), mask], schema=tokens_schema(self.length, self.type)))
        self.held, self.waiting = [flat[used:]], len(flat) - used

    def close(self) -> None:
        self._flush(final=True)
        for writer, kind in ((self.tokens, "tokens"), (self.docs, "docs")):
            writer.close()
            self.out[kind].close()
            self.fs.move(self._path(kind, self.attempt), self._path(kind))


def write_token_files(
    docs: DataFrame,
    folder: str,
    path: str,
    cut: str,
    end_id: int,
    length: int = 2048,
    vocabulary: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A lazy table ``shard, name, n_tokens``; running it writes the files, one row per shard.

    Documents are range-partitioned and sorted by id (null first), rows of one id by text, so
    shards follow each other in ascending order.  Ids take 16 bits where ``vocabulary``
    allows, else 32.  A null or empty text is its end id alone; repeated rows are written
    each; an empty table writes no document; other columns are ignored.
    """
    id_type = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokenizer, shard = TaskContext.get().partitionId(), encoder(path, cut), None
        for batch in batches:
            texts = batch.column("text")
            for some in portions(texts):
                shard = shard or _Shard(folder, f"shard-{part:06d}", length, id_type)
                found = tokenizer.encode(texts[some].to_pylist())
                shard.add(batch.column("doc_id")[some], [np.append(x, np.uint32(end_id)) for x in found])
        if shard:
            shard.close()
            yield pa.record_batch({
                "shard": pa.array([part], pa.int32()), "name": [shard.name], "n_tokens": pa.array([shard.total], pa.int64())
            })

    ordered = text_rows(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "shard int, name string, n_tokens long")


class TokenFile:
    """A shard opened for reading; sequences and documents are slices of the mapped file."""

    def __init__(self, folder: str, name: str) -> None:
        from pyarrow import fs

        store, base = _store(folder)

        def opened(kind: str) -> pa.ipc.RecordBatchFileReader:
            where = f"{base}/{name}.{kind}.arrow"
            return pa.ipc.open_file(pa.memory_map(where) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(where))

        self.tokens, self.docs = opened("tokens"), opened("docs")
        self.length = self.tokens.schema.field("ids").type.list_size
        batches = self.tokens.num_record_batches
        self.sequences = (batches - 1) * SEQUENCES_PER_BATCH + self.tokens.get_batch(batches - 1).num_rows if batches else 0

    def batch(self, number: int) -> np.ndarray:
        """Ids of one record batch, end to end."""
        return self.tokens.get_batch(number).column("ids").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence, both views of the mapped file; all batches but the last hold the same count."""
        if not 0 <= number < self.sequences:
            raise IndexError(number)
        batch, row = divmod(number, SEQUENCES_PER_BATCH)
        found = self.tokens.get_batch(batch)
        ids, masks = found.column("ids")[row], found.column("mask")
        mask = masks.dictionary[masks.indices[row].as_py()]
        return ids.values.to_numpy(zero_copy_only=True), mask.values.to_numpy(zero_copy_only=True)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``doc_id``, start in the shard and ids of each document, in order; batches are read as needed."""
        number, first, held = 0, 0, np.zeros(0, dtype=np.uint32)
        for k in range(self.docs.num_record_batches):
            rows = self.docs.get_batch(k).to_pydict()
            for doc_id, start, size in zip(rows["doc_id"], rows["local_start"], rows["n_tokens"]):
                parts = [held[start - first :]]
                have = len(parts[0])
                while have < size:
                    parts.append(self.batch(number))
                    number, have = number + 1, have + len(parts[-1])
                held, first = (np.concatenate(parts) if len(parts) > 1 else parts[0]), start
                yield doc_id, start, held[:size]


def read_token_files(shards: DataFrame, folder: str) -> DataFrame:
    """Per document of the written files: ``doc_id, start, n_tokens, ids_crc32, shard``.

    ``shards`` is the written table of ``write_token_files``; prefix sums over it (a row per
    shard) turn starts within a shard into starts within all documents.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: list[tuple] = []
                for doc_id, start, ids in TokenFile(folder, row["name"]).documents():
                    out.append((doc_id, row["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["shard"]))
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    # One shard per task: a shard is as large as a partition of the write.
    tasks = max(1, shards.count())
    return placed.repartitionByRange(tasks, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard"]
    columns = zip(*rows) if rows else [[]] * len(names)
    types = [pa.int64()] * 4 + [pa.int32()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)
