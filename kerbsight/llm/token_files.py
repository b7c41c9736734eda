"""Token-ID output: documents as token ids in Arrow stream-file format (operator 10).

The ids of all documents, in ascending id order, form one stream that is cut into sequences of
`seq_len` ids. A file holds record batches of `batch_rows` sequences in two columns:

- ``ids``   fixed_size_list<uint16 or uint32>[seq_len]
- ``mask``  fixed_size_list<uint8>[seq_len / 8], one bit per id, lowest bit first: 1 for an id of
  a document, 0 for the padding that fills the last sequence of a file

Both are plain buffers of equal-length rows, so sequence k is at a computed place: batch
k // batch_rows, row k % batch_rows, and is read without copying (`SequenceFile`). Every batch of a
file but the last has exactly `batch_rows` rows.

Each task writes one file under a name of its own and returns the index rows of its documents. A
file counts only if the committed index names it, so a task that is run again after an executor
was lost leaves an unnamed file and no wrong row.

Defined results: a null text is an empty one, and has the end id alone; a null id sorts first;
rows of equal id are ordered by a hash of their text and then by the text, repeated rows are
written once each; an empty table gives an empty index. Other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kerbsight.llm.common import rows_of, table, workspace
from kerbsight.llm.words import Store, coded, Gathered, slices

CACHE_WORDS = 600_000
MARKS = ".,;:!?"
_PARTS = re.compile(r"(?s).{2000,}?\S(?= \S)|.+")


class CachedEncoder:
    """Ids of whole texts from the tokenizers library, which is asked once per distinct word.

    The byte-level pre-tokenizer always cuts before a space, and on both sides of a line feed,
    that stands between two characters that are not white space; and between a letter or digit and a
    full stop, comma and the like. Encoding the parts gives the ids of the whole. A text with
    any other white space is cut at single spaces only.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        top = max([end_id, *vocabulary.values()])
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        # byte-level vocabularies write the space as U+0120 and the line feed as U+010A
        self.opens = np.zeros(top + 1, bool)
        self.opens[[i for x, i in vocabulary.items() if x[0] in "\u0120\u010a"]] = True
        self.end_id = end_id
        self.marks = dict(zip(MARKS, self.raw(list(MARKS)), strict=True))
        self.known = Store(CACHE_WORDS)

    def raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def apart(self, words: list[str]) -> list[bytes]:
        """Ids of words, from one call for all: each word's first token, and no other, begins with
        the space or is the line feed before it."""
        if not words:
            return []
        texts = [x if x[0] == "\n" else " " + x for x in words]
        (found,) = self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)
        ids = np.array(found.ids, self.dtype)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(words):  # a vocabulary that joins words
            return self.raw(texts)
        data, at = ids.tobytes(), (starts * self.dtype.itemsize).tolist()
        return [data[i:j] for i, j in zip(at, [*at[1:], len(data)], strict=True)]

    def learn(self, words: list[str]) -> list[bytes | None]:
        """Ids of words that aren't stored: of what stands before a mark, and of the mark. None for
        a word that can't be encoded apart from its neighbours."""
        stems = [
            (w[:-1] if w[-1] in self.marks and w[-2:-1].isalnum() else w) if self.alone(w) else None
            for w in words
        ]
        found = dict(zip(stems, map(self.known.get, stems), strict=True))
        new = [x for x, ids in found.items() if ids is None and x is not None]
        found.update(zip(new, self.apart(new), strict=True))
        self.known.keep({x: found[x] for x in new})
        return [
            found[x] if x is None or len(w) == len(x) else found[x] + self.marks[w[-1]]
            for w, x in zip(words, stems, strict=True)
        ]

    @staticmethod
    def alone(word: str) -> bool:
        """Whether a word can be encoded apart from its neighbours: white space stands at none of
        its ends. A word follows a space, or begins with the line feed that it follows."""
        head = word[1:2] if word[:1] == "\n" else word[:1]
        return bool(head) and not head.isspace() and not word[-1].isspace()

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        marked = pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n")
        words = coded(pc.split_pattern(marked, " "))
        # the first word of each text is empty; empty words elsewhere are spaces side by side
        ids = self.known.all(words.words, self.learn)
        fit = np.array([x is not None for x in ids])
        found = Gathered([x or b"" for x in ids], self.dtype, words.codes)
        unfit = np.concatenate([[0], np.cumsum(~fit[words.codes])])[words.offsets]
        odd = np.flatnonzero(np.diff(unfit) > 1).tolist()
        starts, ends = found.ends[words.offsets[:-1]], found.ends[words.offsets[1:]]
        out = [found.values[i + 1 : j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        for i in odd:
            out[i] = np.frombuffer(self.spaced(texts[i].as_py()), self.dtype)
        end = np.array([self.end_id], self.dtype)
        sizes = np.fromiter(map(len, out), np.int64, len(out)) + 1
        return np.concatenate([x for y in out for x in (y, end)]), sizes

    def spaced(self, text: str) -> bytes:
        """A text with unusual white space, cut at single spaces into parts worth a call each."""
        return b"".join(self.raw(_PARTS.findall(text)))


@lru_cache(2)
def encoder(path: str, end_id: int) -> CachedEncoder:
    """One for each Python worker, kept from task to task."""
    return CachedEncoder(path, end_id)


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them in batches of equal size."""

    def __init__(self, sink, dtype: np.dtype, seq_len: int, batch_rows: int):
        if seq_len % 8:
            raise ValueError("seq_len must be a multiple of 8")
        self.dtype, self.seq_len, self.full = dtype, seq_len, seq_len * batch_rows
        ids = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema(
            {"ids": pa.list_(ids, seq_len), "mask": pa.list_(pa.uint8(), seq_len // 8)},
            metadata={"seq_len": str(seq_len), "batch_rows": str(batch_rows)},
        )
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting = bytearray()

    def add(self, ids: np.ndarray) -> None:
        self.waiting += ids.tobytes()
        size = self.full * self.dtype.itemsize
        while len(self.waiting) >= size:
            self.batch(np.frombuffer(bytes(self.waiting[:size]), self.dtype), self.full)
            del self.waiting[:size]

    def batch(self, ids: np.ndarray, n: int) -> None:
        mask = np.packbits(np.arange(len(ids)) < n, bitorder="little")
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(x), size)
            for x, size in ((ids, self.seq_len), (mask, self.seq_len // 8))
        ]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if n := len(self.waiting) // self.dtype.itemsize:
            ids = np.zeros(-(-n // self.seq_len) * self.seq_len, self.dtype)
            ids[:n] = np.frombuffer(bytes(self.waiting), self.dtype)
            self.batch(ids, n)
        self.writer.close()


class SequenceFile:
    """Random access to the sequences of a file; arrays are views of its buffers where the file
    system can map them into memory."""

    def __init__(self, uri: str):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        meta = self.reader.schema.metadata
        self.seq_len, self.batch_rows = int(meta[b"seq_len"]), int(meta[b"batch_rows"])
        self.at, self.now = -1, None

    def batch(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.now = k, self.reader.get_batch(k)
        return self.now

    def sequence(self, k: int, column: str = "ids") -> np.ndarray:
        values = self.batch(k // self.batch_rows).column(column)[k % self.batch_rows].values
        return values.to_numpy(zero_copy_only=True)

    def runs(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids start to start + n of the stream, a view per batch."""
        size = self.seq_len * self.batch_rows
        while n > 0:
            values = self.batch(start // size).column("ids").flatten().to_numpy(zero_copy_only=True)
            found = values[start % size : start % size + n]
            yield found
            start, n = start + len(found), n - len(found)

    def close(self) -> None:
        self.source.close()


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    seq_len: int = 2048,
    batch_rows: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the files below the shared folder `path`; returns the lazy index, one row per
    document: `(file, file_no, doc_id, at, n_tokens)`, `at` counting ids within the file.

    Evaluating the index writes the files, so write it once (`commit_index`). A range shuffle on (id,
    hash of the text) orders the documents: an id that very many rows share is split as well.
    """
    rows = rows_of(docs, id_col, text_col).withColumn("_h", F.xxhash64("_text"))
    ordered = rows.repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h", "_text")
    ordered = ordered.withColumn("_no", F.spark_partition_id()).drop("_h")
    id_sql = dict(rows.dtypes)["_id"]

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, file, at = encoder(tokenizer, end_id), None, None, 0
        for batch in batches:
            ids, starts, sizes = batch.column("_id"), [], []
            if out is None and len(batch):
                no = batch.column("_no")[0].as_py()
                fs, root = pa.fs.FileSystem.from_uri(path)
                fs.create_dir(root, recursive=True)
                file = f"part-{no:06d}-{uuid.uuid4().hex}.arrow"
                sink = fs.open_output_stream(f"{root}/{file}")
                out = SequenceWriter(sink, encode.dtype, seq_len, batch_rows)
            for part in slices(batch, "_text"):
                found, n = encode(part.column("_text"))
                out.add(found)
                starts.append(at + np.cumsum(n) - n)
                sizes.append(n)
                at += len(found)
            starts, sizes = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, sizes))
            yield pa.record_batch(
                [
                    pa.array([file] * len(ids), pa.string()),
                    batch.column("_no"),
                    ids,
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                ],
                ["file", "file_no", "doc_id", "at", "n_tokens"],
            )
        if out is not None:
            out.close()
            sink.close()

    return ordered.mapInArrow(
        write, f"file string, file_no int, doc_id {id_sql}, at bigint, n_tokens bigint"
    )


def commit_index(spark: SparkSession, index: DataFrame, path: str) -> DataFrame:
    """Write the files and their index; from then on the index says which files count."""
    index.write.mode("error").parquet(f"{path}/index")
    return spark.read.schema(index.schema).parquet(f"{path}/index")


def with_stream_start(index: DataFrame) -> DataFrame:
    """Adds `start`, the number of ids of all documents before. The window runs over one row per
    file; files are as many as the range partitions."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    sizes = index.groupBy("file_no").agg(F.sum("n_tokens").alias("_n"))
    offsets = sizes.select("file_no", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per file, and files are as many as shuffle partitions
    placed = index.join(F.broadcast(offsets), "file_no")
    return placed.withColumn("start", F.col("_before") + F.col("at")).drop("_before")


def read_documents(index: DataFrame, path: str) -> DataFrame:
    """The index with `ids_crc32`, computed from the ids that the files hold for each document."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            crcs = []
            columns = (batch.column(c).to_pylist() for c in ("file", "at", "n_tokens"))
            for wanted, at, n in zip(*columns, strict=True):
                if wanted != name:
                    if file:
                        file.close()
                    name, file = wanted, SequenceFile(f"{path}/{wanted}")
                crc = 0
                for ids in file.runs(at, n):
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(crcs, pa.int64())], [*batch.schema.names, "ids_crc32"]
            )
        if file:
            file.close()

    schema = ", ".join(f"`{c}` {t}" for c, t in [*index.dtypes, ("ids_crc32", "bigint")])
    return index.mapInArrow(read, schema)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = workspace(spark).path("tokens")
    written = write_token_files(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json")
    )
    index = commit_index(spark, written, path)
    found = read_documents(with_stream_start(index), path)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")
