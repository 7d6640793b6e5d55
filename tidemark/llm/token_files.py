"""Token files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

An id's rank among all ids of the corpus (most frequent first) takes 1 to 4 bytes; four 2-bit lengths make a control byte,
and control and data bytes lie apart, so numpy decodes a block with a table of 256 entries. Blocks are rows of Parquet files
written by Spark's committer (a lost executor leaves no torn file): part, block, tokens_before, doc_ids, lengths, control, data.
The files of one folder ascend by doc_id: rows are range-partitioned and sorted before they are written. The rank
table is a small file beside them.

Defined results: null or empty text is the end id alone; null doc_ids come first; repeated ids are ordered by content; an
empty table gives empty files and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, new_path, parts
from .tokens import encoded, encoder

TOKENIZER = "word_bpe_49k.json"
#: Tokens in a block, about.
BLOCK = 1 << 18
_LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.int64)
ROWS = "part int, block long, tokens_before long, n_tokens long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def _slots(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Place of each token among the 2-bit slots (every text begins a control byte), and the number of control bytes."""
    lengths = np.asarray(lengths, np.int64)
    quads, end = -(-lengths // 4), np.cumsum(lengths)
    first = 4 * (np.cumsum(quads) - quads)
    return np.repeat(first - (end - lengths), lengths) + np.arange(int(lengths.sum())), int(quads.sum())


def encode(ranks: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of the joined texts' ranks."""
    r = np.ascontiguousarray(ranks, "<u4")
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    at, quads = _slots(lengths)
    slot = np.zeros(4 * quads, np.uint8)
    slot[at] = code
    control = (slot.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()


def decode(control: bytes, data: bytes, lengths: np.ndarray) -> np.ndarray:
    """The joined texts' ranks."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[_slots(lengths)[0]]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n, crc (of the ids as 32-bit integers), ids (binary, 32-bit, or 16-bit if all fit), kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            n, crc, out = [], [], []
            for ids in encoded(enc, b["text"]):
                n.append(len(ids))
                crc.append(zlib.crc32(ids))
                out.append((ids.astype("<u2") if ids.max() < 1 << 16 else ids).tobytes())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "crc", "ids"])

    spark, path = docs.sparkSession, new_path(docs.sparkSession, "ids")
    rows = id_and_text(docs).mapInArrow(run, "doc_id long, n long, crc long, ids binary")
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def frequencies(ids: DataFrame) -> DataFrame:
    """id, n: how often each id occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            for n, raw in zip(b["n"].to_pylist(), b["ids"], strict=True):
                c = np.bincount(_ids(raw.as_buffer(), n), minlength=len(total))
                c[: len(total)] += total
                total = c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return ids.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, block: int = BLOCK) -> None:
    """Writes path/blocks and path/ranks."""
    spark = docs.sparkSession
    ids = tokenized(docs, tokenizer)
    ranked = frequencies(ids).orderBy(F.desc("n"), "id").toPandas()["id"].to_numpy(np.int64)  # at most a row for each id of the vocabulary
    spark.createDataFrame(pa.table({"rank": np.arange(len(ranked)), "id": ranked}), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(ranked.max(initial=0)) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, before, held_docs, held, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held])
            row = [part, k, before, size, held_docs, lengths.tolist(), *encode(rank_of[np.concatenate(held)], lengths)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in ROWS.split(", ")])

        for b in batches:
            for doc, n, raw in zip(b["doc_id"].to_pylist(), b["n"].to_pylist(), b["ids"], strict=True):
                held_docs.append(doc)
                held.append(_ids(raw.as_py(), n))
                size += n
                if size >= block:
                    yield flush()
                    k, before, held_docs, held, size = k + 1, before + size, [], [], 0
        if held:
            yield flush()

    sorted_ = ids.repartitionByRange(parts(spark), F.asc("doc_id"), "crc", "n").sortWithinPartitions("doc_id", "crc", "n")
    sorted_.mapInArrow(blocks, ROWS).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary: little-endian 32-bit), decoded from the files."""
    ids = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)
    rows = spark.read.schema(ROWS).parquet(f"{path}/blocks")
    of_part = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each partition written
    base, before = {}, 0
    for r in of_part:
        base[r["part"]] = before
        before += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lengths = np.array(r["lengths"], np.int64)
                end = np.cumsum(lengths)
                raw = ids[decode(r["control"], r["data"], lengths)].astype("<u4").tobytes()
                texts = [raw[e - s : e] for s, e in zip((4 * lengths).tolist(), (4 * end).tolist(), strict=True)]
                start = base[r["part"]] + r["tokens_before"] + end - lengths
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return rows.select("part", "tokens_before", "doc_ids", "lengths", "control", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """Writes the files into the shared folder and reads them back."""
    path = new_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, block)
    return read(docs.sparkSession, path)
