"""Token ids in binary shards: documents compressed one by one with a shared zstandard dictionary.

A shard holds, in order:
    magic b"LWTOKEN1", 32 bytes sha256 of the dictionary
    one zstandard frame for each document: its ids as little-endian unsigned integers of WIDTH bytes
    index: for each document its doc_id (int64), offset of its frame (uint64), number of ids (uint32); the arrays follow
    each other, offsets have one more entry, the end of the last frame
    footer of 32 bytes: offset of the index (uint64), documents (uint64), WIDTH (uint32), how many of the first documents have
    no doc_id (uint32; the index has 0 for them), magic
A short document is read by its index entry alone. dictionary.zdict beside the shards is what the hash names.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.chunks import SegmentEncoder
from lineweave.llm.common import bounds_of, filesystem, partitions, pieces, range_of, shared_dir, utf8, words

MAGIC = b"LWTOKEN1"
#: Bytes of the dictionary; documents that it is trained on, about, and the blocks of so many ids of their whole texts, at most.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_BLOCKS, BLOCK_IDS = 64 << 10, 2_000, 4_000, 2_048
LEVEL = 3

_encoders: dict[str, TextEncoder] = {}

# Byte classes of WordRule: white space, small letter, digit, other, and bytes that leave their word whole
_GAP, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _GAP
_CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[0, 39, 60]] = _WHOLE  # apostrophes may start an ending such as 's; < may start a special token
_CLASS[1:9] = _CLASS[14:32] = _CLASS[127:] = _WHOLE
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
#: The splitting pattern that WordRule follows: endings, runs of letters, single digits, runs of others.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts and ends of the segments that the pattern never joins; each text's first segment.

    Words of small letters (a-z and the two-byte letters after C3), digits and other ASCII bytes are cut where the pattern
    cuts them. Words with any other byte stay whole: the tokenizers library splits them.
    """
    data = _ASCII_LOWER[data]
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    data = np.where(latin & (data < 0x9F), data + np.uint8(32), data)
    kind = _CLASS[data]
    kind[latin] = _LETTER
    kind[:-1][latin[1:]] = _LETTER
    s, e, at = words(data, off)
    whole = np.concatenate([[0], np.cumsum(kind == _WHOLE)])
    whole = whole[e] > whole[s]
    start = np.zeros(len(data) + 1, bool)
    start[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    start[:-1] &= kind != _GAP
    inner = np.zeros(len(data) + 1, np.int8)
    np.add.at(inner, s[whole], 1)
    np.add.at(inner, e[whole], -1)
    start[:-1] &= np.cumsum(inner[:-1]) == 0
    start[s] = True
    starts = np.flatnonzero(start)
    word = np.searchsorted(s, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), e[word])
    return data, starts, ends, np.searchsorted(starts, off)


class TextEncoder:
    """A tokenizers file. Segments are looked up where its rules are those of segments(); other files encode whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        rules = json.loads(self.tok.to_str())
        steps = [x.get("type") for x in (rules["normalizer"] or {}).get("normalizers", ())]
        split = (rules["pre_tokenizer"] or {}).get("pretokenizers", ({},))[0]
        special = all("<" in t["content"] and not t["lstrip"] and not t["rstrip"] for t in rules["added_tokens"])
        self.by_segment = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": _PATTERN} and split.get("invert") and special
        self.table = SegmentEncoder(lambda x: [t.ids for t in self.tok.encode_batch_fast([w.decode() for w in x], add_special_tokens=False)])

    def encode(self, column) -> list[np.ndarray]:
        """Ids of each text of an Arrow string column; null is empty."""
        if not self.by_segment:
            return [np.array(x.ids, np.uint32) for x in self.tok.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
        data, off = utf8(column)
        out: list[np.ndarray] = []
        for i, j in pieces(off):
            out += self.table.encode(*segments(data[off[i] : off[j]], off[i : j + 1] - off[i]))
        return out


def encode_texts(path: str, column, end_id: int) -> list[np.ndarray]:
    """Ids of each text of an Arrow column with end_id after them."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return [np.append(x, np.uint32(end_id)) for x in _encoders[path].encode(column)]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; where there is too little to train on, the samples themselves."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"".join(samples) or b"\0" * 8)[-DICTIONARY_BYTES:].ljust(8, b"\0")


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def write_shard(fs, path: str, dictionary: bytes, docs: Iterable[tuple[int | None, np.ndarray]], width: int) -> tuple[int, int]:
    """Writes (doc_id, ids) pairs, those without a doc_id first; returns how many documents and ids. A second attempt replaces
    the same file whole. Ids that don't fit the width are refused."""
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_content_size=True, write_checksum=False, write_dict_id=False)
    keys, offsets, counts, unnamed = [], [], [], 0
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        at = f.write(MAGIC + hashlib.sha256(dictionary).digest())
        at = len(MAGIC) + 32
        for key, ids in docs:
            if len(ids) and int(ids.max()) >> 8 * width:
                raise ValueError(f"id {ids.max()} needs more than {width} bytes")
            if key is None:
                if unnamed < len(keys):
                    raise ValueError("documents without a doc_id come first")
                unnamed, key = unnamed + 1, 0
            blob = press.compress(ids.astype(f"<u{width}").tobytes())
            f.write(blob)
            keys.append(key)
            offsets.append(at)
            counts.append(len(ids))
            at += len(blob)
        offsets.append(at)
        f.write(np.array(keys, "<i8").tobytes() + np.array(offsets, "<u8").tobytes() + np.array(counts, "<u4").tobytes())
        f.write(struct.pack("<QQII", at, len(keys), width, unnamed) + MAGIC)
    fs.move(part, path)
    return len(keys), int(np.sum(counts, dtype=np.int64))


class Shard:
    """Reads one document, or all in order, of a shard."""

    def __init__(self, fs, path: str, dictionary: bytes):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        at, n, self.width, self.unnamed, magic = struct.unpack("<QQII8s", self.file.read_at(32, size - 32))
        head = self.file.read_at(40, 0)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        if head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        index = self.file.read_at(size - 32 - at, at)
        self.keys = np.frombuffer(index, "<i8", n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 8 * n)
        self.counts = np.frombuffer(index, "<u4", n, 16 * n + 8)
        self.open = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return np.frombuffer(self.open.decompress(self.file.read_at(b - a, a)), f"<u{self.width}")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.keys)):
            yield None if i < self.unnamed else int(self.keys[i]), self.ids(i)


def id_bytes(path: str, end_id: int) -> int:
    """Bytes that hold every id of a tokenizers file, 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if max(end_id, *Tokenizer.from_file(path).get_vocab().values()) < 1 << 16 else 4


def write(docs: DataFrame, path: str, end_id: int, out: str | None = None, width: int | None = None) -> tuple[str, list[tuple]]:
    """Writes the ids of all documents to a new folder of the shared folder, in ascending doc_id order over its shards.

    docs: (doc_id long, text), other columns are not looked at. A null text is an empty one, so its ids are the end id alone;
    rows without a doc_id come first; rows that repeat a doc_id are written in the order of their texts. Returns the folder
    and (shard, file, documents, ids) of each shard, one small row for each partition; an empty table gives empty shards.
    width: bytes of an id, by default as many as the vocabulary needs. The dictionary is trained on blocks, drawn by hash, of the
    whole texts of documents drawn by hash of their doc_id.
    """
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    width = width or id_bytes(path, end_id)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / total) if total else 1.0
    drawn = docs.where(F.col("text").isNotNull()).where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < F.lit(int(share * (1 << 53))))
    drawn = drawn.groupBy("doc_id").agg(F.min("text").alias("text"))

    def blocks(batches):
        for b in batches:
            where, held = [], []
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode_texts(path, b.column("text"), end_id)):
                for i in range(0, len(ids), BLOCK_IDS):
                    where.append(zlib.crc32(f"{doc} {i}".encode()))
                    held.append(ids[i : i + BLOCK_IDS].astype(f"<u{width}").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(held, pa.binary())], ["place", "ids"])

    sample = drawn.mapInArrow(blocks, "place long, ids binary").orderBy("place", "ids").limit(SAMPLE_BLOCKS)
    dictionary = train_dictionary([bytes(r[1]) for r in sample.collect()])
    fs, folder = filesystem(out)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/dictionary.zdict") as f:
        f.write(dictionary)

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, folder = filesystem(out)

        def rows():
            for b in batches:
                yield from zip(b.column("doc_id").to_pylist(), encode_texts(path, b.column("text"), end_id))

        name = f"shard-{shard:07d}.tok"
        n, ids = write_shard(fs, f"{folder}/{name}", dictionary, rows(), width)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([n]), pa.array([ids])], ["shard", "file", "docs", "ids"])

    n = partitions(docs)
    bounds = bounds_of(docs, "doc_id", n)
    ranged = docs.repartitionById(max(n, len(bounds) + 1), range_of("doc_id", bounds)).sortWithinPartitions("doc_id", "text")
    made = ranged.mapInArrow(run, "shard int, file string, docs long, ids long")
    return out, sorted(tuple(r) for r in made.collect())


def read(spark, folder: str, shards: list[tuple]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the shards, from the files. start: ids before it; doc_id is null
    where the document had none."""
    rows, start = [], 0
    for _, file, docs, ids in shards:
        if docs:
            rows.append((file, start))
        start += ids

    def run(batches):
        fs, at = filesystem(folder)
        with fs.open_input_stream(f"{at}/dictionary.zdict") as f:
            dictionary = f.read()
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                shard = Shard(fs, f"{at}/{file}", dictionary)
                first = start + np.concatenate([[0], np.cumsum(shard.counts, dtype=np.int64)])[:-1]
                crc, n = [], []
                for _, ids in shard:
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    n.append(len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(shard.keys.astype(np.int64), mask=np.arange(len(shard.keys)) < shard.unnamed), pa.array(first.astype(np.int64)), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))
    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
