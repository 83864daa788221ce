"""Token ids in compressed files with one shared dictionary and an index for single records."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.llm.arrays import arrow_schema, batches, bounded_batches, stored
from siftrank.llm.chunks import ChunkTable, text_batches
from siftrank.session import scratch_path

MAGIC = b"SRTOKEN1"
DICTIONARY_MAGIC = b"SRDICT01"
#: Dictionary bytes, and the most records it is trained on.
DICTIONARY_BYTES = 64 << 10
SAMPLE_RECORDS = 2_000
#: Ids of each sampled record, from its start, that the dictionary is trained on; later ones only compress less well.
SAMPLE_IDS = 1 << 14
#: A file is closed once its frames hold so many bytes.
FILE_BYTES = 8 << 20
LEVEL = 3
#: The split pattern of byte-level vocabularies, a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_HEAD = struct.Struct("<8s32sQQ")  # magic, dictionary hash, records, bytes of the id column


# ---- file format ------------------------------------------------------------

def file_bytes(frames: list[bytes], counts: list[int], ids: pa.Array, dictionary: bytes) -> bytes:
    """One file: head, id column (Arrow stream), number of ids of each record, frame borders, frames."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([ids], names=["id"]))
    column = sink.getvalue().to_pybytes()
    borders = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    return b"".join([
        _HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), len(frames), len(column)), column,
        np.array(counts, "<u8").tobytes(), borders.tobytes(), *frames,
    ])


class TokenFile:
    """Reads a token file; ``record(i)`` touches the frame of one record only."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, digest, self.records, size = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        self.view, at = memoryview(data), _HEAD.size
        self.ids = pa.ipc.open_stream(self.view[at:at + size]).read_all().column(0)
        at += size
        self.counts = np.frombuffer(data, "<u8", self.records, at)
        at += 8 * self.records
        self.borders = np.frombuffer(data, "<u8", self.records + 1, at)
        self.first_frame = at + 8 * (self.records + 1)
        self.unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary \
            else zstandard.ZstdDecompressor()

    def record(self, i: int) -> np.ndarray:
        """Token ids of the i-th record."""
        a, b = int(self.borders[i]), int(self.borders[i + 1])
        raw = self.unzip.decompress(self.view[self.first_frame + a:self.first_frame + b])
        ids = np.frombuffer(raw, "<u4")
        if len(ids) != self.counts[i]:
            raise ValueError("the frame does not hold the ids that the index names")
        return ids


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of serialised id arrays; empty where there is too little to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


# ---- Spark steps ------------------------------------------------------------

#: Chunks of these characters alone are cut alike by every version of the split pattern.
_PLAIN = re.compile("[ -~\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff\\n]*")


@lru_cache(maxsize=1)
def _library(serialised: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(serialised)


def _tokenizer(serialised: str) -> ChunkTable:
    """Ids by the tokenizers library, in a table for one task.

    Where the vocabulary is a byte-level BPE with the usual split pattern, plain chunks are cut here and
    their distinct pieces go straight to the library's model; all else goes through its whole pipeline.
    """
    tokenizer = _library(serialised)
    model, letters = tokenizer.model, {b: c for b, c in zip(range(256), _byte_letters(), strict=True)}
    described = json.loads(serialised)
    before = described.get("pre_tokenizer") or {}
    direct = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
              and not described.get("normalizer") and not described.get("post_processor"))
    special = [t["content"] for t in described.get("added_tokens", [])]
    split = regex.compile(SPLIT)

    def encode_many(chunks: list[str]) -> list[np.ndarray]:
        plain = [direct and _PLAIN.fullmatch(c) is not None and not any(s in c for s in special) for c in chunks]
        cut = [split.findall(c) if p else [] for c, p in zip(chunks, plain, strict=True)]
        pieces = {x: np.array([t.id for t in model.tokenize(x.encode().decode("latin-1").translate(letters))], np.uint32)
                  for x in dict.fromkeys(x for xs in cut for x in xs)}
        whole = iter(tokenizer.encode_batch_fast([c for c, p in zip(chunks, plain, strict=True) if not p], add_special_tokens=False))
        none = np.zeros(0, np.uint32)
        return [(pieces[xs[0]] if len(xs) == 1 else np.concatenate([pieces[x] for x in xs]) if xs else none) if p
                else np.array(next(whole).ids, np.uint32) for xs, p in zip(cut, plain, strict=True)]

    return ChunkTable(encode_many)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _encode(frames: Iterator[pa.RecordBatch], serialised: str, end_id: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids of the texts (second column) of each part of a batch, with the end id, and its first column."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    table = _tokenizer(serialised)
    for frame in frames:
        texts = frame.column(1).to_pylist()
        for first, last in text_batches(texts):
            ids, counts = table.encode(texts[first:last])
            yield frame.column(0).slice(first, last - first), [
                np.append(part, end_id).astype("<u4") for part in np.split(ids, np.cumsum(counts)[:-1])]


def write_tokens(records: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "molecule_id",
                 text_col: str = "evidence_summary_notes") -> DataFrame:
    """Encode the evidence notes of all records and write them to ``folder`` in ascending order of their ids.

    Uses the tokenizers library without special tokens and appends ``end_id`` to each record. A
    zstandard dictionary is trained on the first ``SAMPLE_IDS`` ids of at most ``SAMPLE_RECORDS`` records
    (those with the smallest hash of the id); each record is compressed by itself with it. Returns the written
    files: ``file``, ``file_number`` (their order), ``n_records`` and ``n_tokens``, and keeps the
    dictionary in ``folder``.

    Null texts count as empty and hold the end id only. Records without an id come first, repeated
    ids stand together; both are kept. An empty table writes the dictionary only. ``folder`` has to be
    one that all executors reach; a file is written under a name of its own and then renamed, so a
    repeated task leaves a whole file.
    """
    spark = records.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dictionary = _train(rows, vocabulary, end_id)
    _write_file(f"{folder}/dictionary", DICTIONARY_MAGIC + dictionary)
    frames_type = T.StructType([rows.schema["id"], T.StructField("n", T.LongType()), T.StructField("frame", T.BinaryType())])
    frames_schema = arrow_schema(frames_type)

    def compress(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = _compressor(dictionary)
        for ids, arrays in _encode(frames, vocabulary.value, end_id):
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([len(a) for a in arrays], pa.int64()),
                pa.array([zip_.compress(a.tobytes()) for a in arrays], pa.binary())], schema=frames_schema)

    encoded = stored(rows.mapInArrow(compress, frames_type), "token-frames")
    n_bytes = encoded.agg(F.sum(F.length("frame"))).first()[0] or 0
    parts = max(8, n_bytes // (4 * FILE_BYTES))
    # The second key only spreads the rows of one repeated id.
    ordered = encoded.repartitionByRange(parts, F.col("id").asc_nulls_first(), F.xxhash64("frame")).sortWithinPartitions(
        F.col("id").asc_nulls_first())
    manifest = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()),
                          ("n_tokens", pa.int64())])

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        return batches(manifest, _write_part(frames, folder, part, dictionary, frames_schema.field(0).type))

    files = stored(ordered.mapInArrow(write, "part int, number int, file string, n_records long, n_tokens long"), "token-manifest")
    return files.select("file", (F.col("part").cast("long") * (1 << 20) + F.col("number")).alias("file_number"),
                        "n_records", "n_tokens")


def _train(rows: DataFrame, vocabulary, end_id: int) -> bytes:
    chosen = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_RECORDS)
    sample = rows.join(F.broadcast(chosen), "id").limit(SAMPLE_RECORDS)

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, arrays in _encode(frames, vocabulary.value, end_id):
            yield pa.RecordBatch.from_pydict({"ids": pa.array([a[:SAMPLE_IDS].tobytes() for a in arrays], pa.binary())})

    return train_dictionary(sorted(bytes(r.ids) for r in sample.mapInArrow(encode, "ids binary").toLocalIterator()))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=shared, write_dict_id=True)


def _write_part(frames: Iterator[pa.RecordBatch], folder: str, part: int, dictionary: bytes, id_type: pa.DataType
                ) -> Iterator[tuple]:
    held: list[bytes] = []
    counts: list[int] = []
    ids: list = []
    number = 0

    def close() -> tuple:
        name = f"part-{part:06d}-{number:05d}.tokens"
        _write_file(f"{folder}/{name}", file_bytes(held, counts, pa.array(ids, id_type), dictionary))
        return part, number, name, len(held), sum(counts)

    size = 0
    for frame in frames:
        for i, n, data in zip(*(c.to_pylist() for c in frame.columns), strict=True):
            held.append(data)
            counts.append(n)
            ids.append(i)
            size += len(data)
            if size >= FILE_BYTES:
                yield close()
                held, counts, ids, size, number = [], [], [], 0, number + 1
    if held:
        yield close()


def _write_file(path: str, data: bytes) -> None:
    fs, place = pa.fs.FileSystem.from_uri(path)
    folder, name = place.rsplit("/", 1)
    fs.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(data)
    fs.move(draft, place)


def read_tokens(spark: SparkSession, folder: str, files: DataFrame, id_col: str = "molecule_id",
                id_type: T.DataType | None = None, use: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """Read token files back: ``id_col``, ``start`` (ids of all records before it), ``n_tokens``, ``token_ids``.

    ``token_ids`` are the ids as little-endian unsigned 32-bit numbers in one binary value. ``files``
    is the result of :func:`write_tokens`, one small row for each file.
    """
    from pyspark.sql import Window

    out = T.StructType([T.StructField(id_col, id_type or T.LongType()), T.StructField("start", T.LongType()),
                        T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())])
    schema = arrow_schema(out)
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("file_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = files.select("file", before.cast("long").alias("first"))
    dictionary = _read_dictionary(spark, folder)
    bounded_batches(spark)
    data = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def decode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for frame in frames:
                for content, start in zip(frame.column(0), frame.column(1).to_pylist(), strict=True):
                    file = TokenFile(content.as_buffer().to_pybytes(), dictionary)
                    for i, one in enumerate(file.ids.to_pylist()):
                        ids = file.record(i)
                        yield one, start, len(ids), ids.tobytes()
                        start += len(ids)

        return batches(schema, rows(), 256)

    return data.join(F.broadcast(first) if files.count() < 100_000 else first, "file").select("content", "first").mapInArrow(decode, out)


def _read_dictionary(spark: SparkSession, folder: str) -> bytes:
    data = bytes(spark.read.format("binaryFile").load(f"{folder}/dictionary").select("content").first()[0])
    if not data.startswith(DICTIONARY_MAGIC):
        raise ValueError("not a dictionary of token files")
    return data[len(DICTIONARY_MAGIC):]


def tokens_folder(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared one."""
    return scratch_path(spark, "tokens")
