"""SentencePiece models run by the tokenizers library, checked against the sentencepiece library."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lineweave.llm.chunks import SegmentEncoder
from lineweave.llm.common import pieces

MARK = "▁"
# Piece kinds and model kinds of the public model format
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: int, bytes, or 4 or 8 raw bytes."""

    def varint(i: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            b = data[i]
            x |= (b & 127) << shift
            i += 1
            if b < 128:
                return x, i
            shift += 7

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = data[i : i + n], i + n
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


@dataclass
class Model:
    """What a model file says. Fields that it leaves out have the format's defaults."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_spaces: bool = True
    escape_spaces: bool = True
    spaces_as_suffix: bool = False

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for k, v in _fields(data):
            if k == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, x in _fields(v):
                    if f == 1:
                        piece = x.decode()
                    elif f == 2:
                        score = struct.unpack("<f", x)[0]
                    elif f == 3:
                        kind = x
                m.pieces.append((piece, score, kind))
            elif k == 2:
                for f, x in _fields(v):
                    if f == 3:
                        m.kind = x
                    elif f == 24:
                        m.spaces_as_suffix = bool(x)
                    elif f == 35:
                        m.byte_fallback = bool(x)
            elif k == 3:
                for f, x in _fields(v):
                    if f == 2:
                        m.charsmap = x
                    elif f == 3:
                        m.dummy_prefix = bool(x)
                    elif f == 4:
                        m.remove_spaces = bool(x)
                    elif f == 5:
                        m.escape_spaces = bool(x)
        if m.kind not in (UNIGRAM, BPE) or m.spaces_as_suffix or any(p[2] == USER_DEFINED for p in m.pieces):
            raise ValueError("only unigram and BPE models with spaces as prefixes and without user-defined pieces are supported")
        return m

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def core(self):
        """A tokenizers Tokenizer with the model alone: it takes text that is normalised and marked already."""
        from tokenizers import Tokenizer, models

        if self.kind == UNIGRAM:
            return Tokenizer(models.Unigram([p[:2] for p in self.pieces], self.unknown, self.byte_fallback))
        vocab = {p[0]: i for i, p in enumerate(self.pieces)}
        usable = {p[0] for p in self.pieces if p[2] in (NORMAL, UNUSED)}
        merges = []
        for piece in sorted((p for p in usable if len(p) > 1), key=lambda p: (-self.pieces[vocab[p]][1], vocab[p])):
            both = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in usable and piece[k:] in usable]
            merges += sorted(both, key=lambda x: (vocab[x[0]], vocab[x[1]]))
        return Tokenizer(models.BPE(vocab, merges, unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback))

    def normalizer(self):
        """What the model does to a text before it is split, as a tokenizers Normalizer; None: nothing."""
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_spaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        return normalizers.Sequence(steps) if steps else None

    def tokenizer(self):
        """The whole model as one Tokenizer."""
        from tokenizers import decoders, normalizers

        tok = self.core()
        steps = [self.normalizer()] if self.normalizer() else []
        steps += [normalizers.Prepend(MARK)] if self.dummy_prefix else []
        steps += [normalizers.Replace(" ", MARK)] if self.escape_spaces else []
        if steps:
            tok.normalizer = normalizers.Sequence(steps)
        tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1 if self.dummy_prefix else 0, 0)])
        return tok


class PieceCodec:
    """Encodes and decodes batches of texts; every segment that it meets first is checked against the sentencepiece library.

    A text is cut between two bytes that no piece holds side by side, as no merge can join them; what lies between is
    looked up or goes to the tokenizers library. Models whose merges can't be told from that encode whole texts.
    """

    def __init__(self, data: bytes, check: bool = True):
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        self.model = m = Model.parse(data)
        self.core, self.norm = m.core(), m.normalizer()
        self.differ: set[bytes] = set()
        self.truth = None
        if check:
            import sentencepiece

            self.truth = sentencepiece.SentencePieceProcessor(model_proto=data)
        text = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in m.pieces]
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.size = np.array([len(t) for t in text], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        joined = np.zeros((256, 256), bool)
        for t, (_, _, k) in zip(text, m.pieces):
            if k in (NORMAL, UNUSED):
                x = np.frombuffer(t, np.uint8)
                joined[x[:-1], x[1:]] = True
        joined[:, 0x80:0xC0] = True  # never within a character
        self.cut = ~joined
        self.by_segment = m.kind == BPE and m.byte_fallback and m.escape_spaces and m.dummy_prefix
        self.table = SegmentEncoder(self._new)

    def _new(self, found: list[bytes]) -> list:
        marked = [x.decode().replace(" ", MARK) for x in found]
        ids = [x.ids for x in self.core.encode_batch_fast(marked, add_special_tokens=False)]
        if self.truth:
            # the library puts its own mark first, so a segment comes after a line end, whose ids are left out
            skip = len(self.truth.encode("\n"))
            want = self.truth.encode(["\n" + x.decode() for x in found], num_threads=2)
            self.differ |= {x for x, a, b in zip(found, ids, want) if a != b[skip:]}
        return ids

    def normalized(self, text: str) -> str:
        return self.norm.normalize_str(text) if self.norm else text

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether they are those that the sentencepiece library gives. Null and empty texts have none."""
        texts = [self.normalized(t) if t else "" for t in texts]
        if not self.by_segment:
            m = self.model
            marked = [((MARK if m.dummy_prefix else "") + (t.replace(" ", MARK) if m.escape_spaces else t)) if t else "" for t in texts]
            ids = [np.array(x.ids, np.uint32) for x in self.core.encode_batch_fast(marked, add_special_tokens=False)]
            return ids, [a.tolist() == b for a, b in zip(ids, self.truth.encode(texts, num_threads=2))] if self.truth else [True] * len(ids)
        raw = [(" " + (t.replace(MARK, " ") if MARK in t else t)).encode() if t else b"" for t in texts]
        off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids, same = [], []
        for i, j in pieces(off):
            d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            start = np.zeros(len(d), bool)
            start[1:] = self.cut[d[:-1], d[1:]]
            start[o[:-1][o[:-1] < len(d)]] = True
            s = np.flatnonzero(start)
            begin = np.searchsorted(s, o)
            ids += self.table.encode(d, s, np.append(s[1:], len(d)), begin)
            if self.differ:
                part = [d[a:b].tobytes() in self.differ for a, b in zip(s.tolist(), [*s[1:].tolist(), len(d)])]
                same += [not any(part[a:b]) for a, b in zip(begin[:-1], begin[1:])]
            else:
                same += [True] * (j - i)
        return ids, same

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        upto = np.cumsum(size)
        out = self.flat[np.repeat(self.begin[ids] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
        return out[1:] if self.model.dummy_prefix and out[:1] == b" " else out

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_codecs: dict[tuple, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = PieceCodec(f.read())
    return _codecs[path]


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), parity (with the sentencepiece
    library), round_trip (decoding gives the normalised text), with ids if wanted, for each row of docs.

    A null or empty text has no ids and comes back empty; rows that repeat a doc_id each have a row; columns besides
    doc_id and text are not looked at. path: the model file, on every executor.
    """
    schema = "doc_id long, n_pieces long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<int>" * with_ids

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            ids, same = c.encode(texts)
            back = [c.decode_bytes(x) == c.normalized(t or "").encode() for x, t in zip(ids, texts)]
            cols = [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(same, pa.bool_()), pa.array(back, pa.bool_())]
            if with_ids:
                cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
