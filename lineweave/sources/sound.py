"""Uncompressed sound files as tables of blocks of samples."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: The 16-byte names of the 64-bit format end in these bytes, those of its outermost chunk in others
TAIL = bytes.fromhex("F3AC D311 8CD1 00C0 4F8E DB8A")
RIFF_TAIL = bytes.fromhex("2E91 CF11 A5D6 28DB 04C1 0000")
COLUMNS = ["file_id", "channels", "rate", "sample_bytes", "at", "samples", "problem"]
SOUND = "file_id string, channels int, rate int, sample_bytes int, at bigint, samples array<int>, problem string"


def chunks(raw: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end) of the chunks of a file, cut at its end; ValueError for what is neither of the two formats."""
    if raw[:4] == b"RIFF" and raw[8:12] == b"WAVE":
        at, name, size, pad, own = 12, 4, "<I", 1, 0
    elif raw[:16] == b"riff" + RIFF_TAIL and raw[24:40] == b"wave" + TAIL:
        at, name, size, pad, own = 40, 16, "<Q", 7, 24
    else:
        raise ValueError("neither of the sound formats")
    width = struct.calcsize(size)
    while at + name + width <= len(raw):
        kind, begin = raw[at : at + name], at + name + width
        end = begin + struct.unpack_from(size, raw, at + name)[0] - own
        if end < begin:
            raise ValueError("a chunk of less than its head")
        if name == 4 or kind[4:] == TAIL:
            yield kind[:4], begin, min(end, len(raw))
        at = (end + pad) & ~pad


def decoded(raw: bytes) -> tuple[int, int, int, np.ndarray]:
    """(channels, rate, bytes a sample, whole numbers as frames x channels); 8-bit samples are unsigned and stay so."""
    form, data = None, []
    for kind, a, b in chunks(raw):
        if kind == b"fmt ":
            if form:
                raise ValueError("two formats")
            if b - a < 16:
                break  # cut within it
            packed, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, a)
            if packed != 1:
                raise ValueError("compressed")
            form = channels, rate, (bits + 7) // 8
        elif kind == b"data":
            if not form or not all(form):
                raise ValueError("samples before their format")
            step = form[0] * form[2]
            data.append(raw[a : a + (b - a) // step * step])
    if not form or not all(form) or not any(data):
        raise ValueError("no samples")
    channels, rate, width = form
    if width > 4:
        raise ValueError(f"samples of {width} bytes")
    bytes_ = np.frombuffer(b"".join(data), np.uint8).reshape(-1, width)
    if width == 1:
        whole = bytes_[:, 0].astype(np.int32)
    else:  # little endian, the last byte with the sign
        wide = np.zeros((len(bytes_), 4), np.uint8)
        wide[:, 4 - width :] = bytes_
        whole = wide.view("<i4")[:, 0] >> (8 * (4 - width))
    return channels, rate, width, whole.reshape(-1, channels)


def sound(files: DataFrame, block: int = 65536) -> DataFrame:
    """files: (file_id, content binary). A row for each block of sample frames, which begins at frame `at`, channels interleaved. A file
    that can't be read has one row with its problem. A file is decoded in one task, block by block it goes on."""

    def run(batches):
        for p in batches:
            for name, raw in zip(p.file_id, p.content):
                try:
                    channels, rate, width, whole = decoded(bytes(raw))
                except ValueError as e:
                    yield pd.DataFrame([(name, None, None, None, None, None, str(e))], columns=COLUMNS)
                    continue
                for at in range(0, len(whole), block):
                    yield pd.DataFrame([(name, channels, rate, width, at, whole[at : at + block].ravel(), None)], columns=COLUMNS)

    return files.select("file_id", "content").mapInPandas(run, SOUND)


def read_sound(spark: SparkSession, path: str, block: int = 65536) -> DataFrame:
    return sound(spark.read.format("binaryFile").load(path).selectExpr("_metadata.file_name AS file_id", "content"), block)
