"""Token-id files: Parquet list columns with chosen encodings, row groups and page indexes.

Texts are encoded by a public tokenizer, an end id is appended to each, and the rows are written in
ascending doc_id order: part files are ranges of doc_id and sorted inside. Token ids are dictionary
encoded; doc_id and counts are delta encoded (data page version 2); row groups and pages are kept
small and carry column and offset indexes, so a reader can take metadata without token pages or a
doc_id range without the rest. Offsets over all documents come from one number per part file.

The tokenizer drops blanks and never merges across them, so each distinct chunk between blanks is encoded
once a batch and the ids are put together with numpy.

Null texts are empty and get the end id only. Null doc_ids come first. Repeated doc_ids are ordered by
a hash of the text, equal rows in any order. An empty table gives files without rows. Other columns are not written.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.shared import shared_dir, small_batches
from strata.llm.text import Coded, as_array, cut, gathered, pieces, ragged, raw, tidy

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SCHEMA = "doc_id bigint, part int, first bigint, n_tokens bigint, ids array<int>"
_MARK = "<|endoftext|>"
_MARKS = "!#$%&*+,-./:;=?@|"


#: Whether two bytes are a letter that stays one character in lower case, by the first byte times 256 plus the second.
_LETTER = np.zeros(1 << 16, bool)
for _code in range(0xC0, 0x280):
    _pair = chr(_code).encode()
    _LETTER[_pair[0] << 8 | _pair[1]] = chr(_code).isalpha() and len(chr(_code).lower()) == 1
_ALNUM = np.array([bytes([b]).isalnum() for b in range(256)])


def parts_of(chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Chunks as what is before their last ASCII marks, and those (else empty), if a letter or digit stands between.

    The tokenizer merges marks with marks but never with letters or digits. It lower-cases, so a part in
    ASCII can be lower-cased first; others are left, as they may compose. Special tokens are found before that,
    so a chunk that may hold one stays whole and as it is.
    """
    body = pc.ascii_rtrim(chunks, characters=_MARKS)
    letters, off = raw(body)
    last, full = off[1:] - 1, np.diff(off) > 0
    one = letters[np.where(full, last, 0)] if len(letters) else np.zeros(len(chunks), np.uint8)
    before = letters[np.where(np.diff(off) > 1, last - 1, 0)] if len(letters) else one
    ends = full & (_ALNUM[one] | ((np.diff(off) > 1) & _LETTER[before.astype(np.int64) << 8 | one]))
    ends &= ~pc.match_substring(chunks, "<|").to_numpy(zero_copy_only=False)
    head = pc.if_else(pa.array(ends), body, chunks)
    plain = pc.and_not(pc.string_is_ascii(head), pc.match_substring(head, "<|"))
    chars, at = raw(chunks)
    begin = at[:-1] + np.diff(off)
    rest = np.where(ends, at[1:] - begin, 0)
    where = np.concatenate([[0], np.cumsum(rest)]).astype(np.int32)
    tails = np.ascontiguousarray(chars[ragged(begin, rest)])
    return pc.if_else(plain, pc.ascii_lower(head), head), pa.Array.from_buffers(pa.string(), len(chunks), [None, pa.py_buffer(where), pa.py_buffer(tails)])


class ChunkEncoder:
    """Encodes texts chunk by chunk; ``tokenizer`` must not let tokens cross blanks or line ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(_MARK)
        self.known = Coded()

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Encode parts in few calls: a special token between parts keeps them apart in the ids."""
        alone = pc.match_substring(new, "<|").to_numpy(zero_copy_only=False) if self.mark is not None else np.ones(len(new), bool)
        rest, single = np.flatnonzero(~alone), np.flatnonzero(alone)
        found, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(rest), 250):
            some = new.take(pa.array(rest[at : at + 250]))
            ids = np.array(self.tokenizer.encode_batch_fast([_MARK.join(some.to_pylist())], add_special_tokens=False)[0].ids, np.int32)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(some) - 1:
                raise ValueError("the tokenizer does not keep its special token apart")
            found.append(np.delete(ids, marks))
            sizes.append(np.diff(marks, prepend=-1, append=len(ids)) - 1)
        for p in new.take(pa.array(single)).to_pylist():
            found.append(np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.int32))
            sizes.append([len(found[-1])])
        ids, size = np.concatenate(found), np.concatenate(sizes)
        if not len(single):
            return ids, size
        order = np.argsort(np.concatenate([rest, single]))
        return ids[ragged((np.cumsum(size) - size)[order], size[order])], size[order]

    def encode(self, texts: pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the offset of each text's ids."""
        w = cut(*raw(texts), blanks=b" \n")
        self.known.trim()
        coded = pa.concat_arrays(parts_of(w.distinct.view(pa.string()))).dictionary_encode()
        part = self.known.find(coded.dictionary, self._learn)[coded.indices.to_numpy()]
        both = part.reshape(2, -1).T  # head and tail of each distinct chunk
        length = np.diff(self.known.off)[both]
        sizes = length.sum(axis=1)
        flat = gathered(self.known.ids, self.known.off[both].reshape(-1), length.reshape(-1))
        begins = np.cumsum(sizes) - sizes
        ids = gathered(flat, begins[w.codes], sizes[w.codes])
        off = np.concatenate([[0], np.cumsum(sizes[w.codes])])[w.starts]
        if end is None:
            return ids, off
        n = w.n_texts
        out = np.empty(len(ids) + n, np.int32)
        ends = off[1:] + np.arange(n)
        out[ends] = end
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = ids
        return out, off + np.arange(n + 1)


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, tokenizer: str, end: int | None, parts: int | None = None) -> DataFrame:
    """Rows of SCHEMA in range partitions of doc_id, sorted; first counts within the partition."""
    small_batches(docs.sparkSession)
    n = parts or max(1, docs.select("doc_id")._jdf.queryExecution().toRdd().getNumPartitions())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in pieces(batches, limit=6 << 20):
            ids, off = own.encode(as_array(b.column(2)), end)
            sizes = np.diff(off)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(sizes), part), pa.int32()), pa.array(seen + off[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))],
                names=["doc_id", "part", "first", "n_tokens", "ids"],
            )
            seen += int(off[-1])
        tidy()

    return rows.mapInArrow(work, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int | None = END_ID, row_group_bytes: int = 16 << 20, page_rows: int = 2000) -> None:
    """Encode docs and write the files to ``path``, which all executors must reach."""
    out = encoded(docs, tokenizer or public_tokenizers.path(VOCABULARY), end)
    options = {"parquet.writer.version": "v2", "parquet.block.size": str(row_group_bytes), "parquet.page.row.count.limit": str(page_rows), "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "compression": "zstd"}
    out.write.options(**options).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before) and n_tokens; no page of ids is read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return _started(rows, spark, path).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids; with bounds, of doc_ids from low to high only."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return _started(rows, spark, path).select("doc_id", "start", "n_tokens", "ids")


def _started(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """One number for each part file reaches the driver: as many as the writer had tasks."""
    sizes = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, base = 0, []
    for r in sizes:
        base.append((r["part"], before))
        before += r["n"]
    return rows.join(F.broadcast(spark.createDataFrame(base, "part int, base bigint")), "part").withColumn("start", F.col("first") + F.col("base"))


def with_crc(tokens: DataFrame) -> DataFrame:
    """ids replaced by ids_crc32, over little-endian unsigned 32-bit integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(3)
            ids = column.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            off = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * int(off[i]) : 4 * int(off[i + 1])]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_token_file(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return with_crc(read_tokens(spark, path))
