"""Document fingerprints from improbable byte windows, in chained Bloom filters."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import bounds_of, byte_values, partitions, pieces, prefix_hash, range_of, span_hash

#: Bytes of a window, windows that compete for being the rarest, and wins that a window needs to become a feature.
WINDOW, RIVALS, WINS = 32, 64, 16
#: Bits of one Bloom filter, features that it takes before the next is chained to it, and bits that a feature sets.
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Entropy in bits that is usual for a window of prose; the further from it, the rarer a window is ranked.
USUAL = 3.7
#: Part of the way from chance overlap to full overlap that counts as none.
CHANCE = 0.15

_N = np.arange(WINDOW + 1, dtype=np.float64)
_SUM = np.rint(np.where(_N > 0, _N * np.log2(np.maximum(_N, 1)), 0) * 4096).astype(np.int64)  # n log n
_STEP = np.concatenate([[0], np.diff(_SUM)])
_USUAL = int(round((np.log2(WINDOW) - USUAL) * WINDOW * 4096))


def entropy_sums(data: np.ndarray) -> np.ndarray:
    """Sum of n log2 n (times 4096) over the byte counts n of each window; the window's entropy falls as it grows."""
    n = len(data)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (2 * n) + order
    at = np.arange(n)
    out, into = np.empty(n, np.int64), np.empty(n, np.int64)
    out[order] = np.searchsorted(key, key + WINDOW) - at  # copies of this byte from here to the window's end
    into[order] = at + 1 - np.searchsorted(key, key - WINDOW, side="right")  # and from the window's start to here
    step = _STEP.astype(np.int64)
    sums = np.empty(n - WINDOW + 1, np.int64)
    sums[0] = _SUM[np.bincount(data[:WINDOW])].sum()
    np.cumsum(step[into[WINDOW:]] - step[out[: n - WINDOW]], out=sums[1:])
    sums[1:] += sums[0]
    return sums


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the features of all texts, in order, each once a text.

    Among RIVALS neighbouring windows the rarest by entropy wins, the first of equals; a window that wins WINS times is a
    feature. Neighbourhoods reach beyond the text's ends, where there are no windows, so the rarest window of a text, the only
    one too, is always a feature. Windows of one repeated byte win against their like only. A text shorter than a window has
    itself as its only one.
    """
    size = np.diff(off)
    c = prefix_hash(byte_values(data))
    short = np.flatnonzero((size > 0) & (size < WINDOW))
    rows, hashes, places = [short], [span_hash(c, off[short], off[short + 1])], [off[short]]
    some = np.flatnonzero(size >= WINDOW)
    if len(some):
        sums = entropy_sums(data)
        n = size[some] - WINDOW + 1
        base = np.cumsum(n + RIVALS - 1) - n  # place of a text's first window, RIVALS - 1 places after the last of the text before
        upto = np.cumsum(n)
        window = np.arange(upto[-1]) - np.repeat(upto - n, n)
        text, window = np.repeat(some, n), window + np.repeat(off[some], n)
        place = window + np.repeat(base - off[some], n)
        far = np.abs(sums[window] - _USUAL)
        far[sums[window] == _SUM[WINDOW]] = 0
        total = int(base[-1] + n[-1]) + RIVALS - 1
        none = np.iinfo(np.int64).max
        pad = np.full(-(-(total + RIVALS) // RIVALS) * RIVALS, none)
        pad[place] = ((1 << 22) - far) * (1 << 33) + np.arange(len(window))
        block = pad.reshape(-1, RIVALS)
        pre = np.minimum.accumulate(block, axis=1).ravel()
        suf = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        w = np.arange(total - RIVALS + 1)
        best = np.minimum(suf[w], pre[w + RIVALS - 1])
        wins = np.bincount(best[best < none] & ((1 << 33) - 1), minlength=len(window))
        chosen = np.flatnonzero(wins >= WINS)
        rows.append(text[chosen])
        hashes.append(span_hash(c, window[chosen], window[chosen] + WINDOW))
        places.append(window[chosen])
    row, h, at = map(np.concatenate, (rows, hashes, places))
    order = np.lexsort((at, h, row))
    row, h, at = row[order], h[order], at[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h, at = row[first], h[first], at[first]
    order = np.lexsort((at, row))
    return row[order], h[order]


def digests(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The chained Bloom filters of each text: an array of bytes, one line a filter. Texts without bytes have none."""
    row, h = features(data, off)
    begin = np.searchsorted(row, np.arange(len(off)))
    chain = (np.arange(len(row)) - begin[row]) // FILTER_FEATURES
    count = -(-np.diff(begin) // FILTER_FEATURES)
    base = np.concatenate([[0], np.cumsum(count)])
    bits = np.zeros((base[-1], FILTER_BITS), bool)
    line = base[row] + chain
    for k in range(HASHES):
        bits[line, ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1, bitorder="little")
    return [packed[a:b] for a, b in zip(base[:-1], base[1:])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: mean over the filters of the shorter digest of its best overlap with a filter of the other, where the
    overlap that chance gives counts as 0 and that of equal filters as 1. Digests without filters are alike."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    na = np.bitwise_count(a).sum(axis=1, dtype=np.int64)[:, None].astype(float)
    nb = np.bitwise_count(b).sum(axis=1, dtype=np.int64)[None, :].astype(float)
    both = np.stack([np.bitwise_count(x[None, :] & b).sum(axis=1, dtype=np.int64) for x in a]).astype(float)
    low, top = na * nb / FILTER_BITS, np.minimum(na, nb)
    low = low + CHANCE * (top - low)
    score = np.clip((both - low) / np.maximum(top - low, 1e-9), 0, 1)
    return float(score.max(axis=1).mean())


def _text(f: np.ndarray) -> str:
    return f"{len(f):x}:{f.tobytes().hex()}"


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each whole text; null is empty, and an empty text's fingerprint has no filters."""
    from lineweave.llm.common import utf8

    def run(batches):
        for b in batches:
            data, off = utf8(b.column("text"))
            out = []
            for i, j in pieces(off):
                out += map(_text, digests(data[off[i] : off[j]], off[i : j + 1] - off[i]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by as much of the next text's start."""
    q = len(text) // 4
    return text[: len(text) - q] + after[:q]


def with_next(docs: DataFrame) -> DataFrame:
    """(range, peek, doc_id, text): documents dealt out by ascending doc_id and sorted; the first document of the next
    range comes along at each range's end (peek), after the last range the very first."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(docs)
    bounds = bounds_of(docs, "doc_id", n)
    low, nulls = docs.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    bounds = [b for b in bounds if low is not None and b > low]
    own = range_of("doc_id", bounds)
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(low)
    edge = F.when(F.col("doc_id").isin(bounds), own - 1) if bounds else F.lit(None).cast("int")
    edge = F.when(F.coalesce(first, F.lit(False)), F.lit(len(bounds))).otherwise(edge)
    rows = docs.select("doc_id", "text", F.explode(F.array(F.struct(own.alias("range"), F.lit(False).alias("peek")), F.struct(edge.alias("range"), F.lit(True).alias("peek")))).alias("r"))
    rows = rows.select("r.range", "r.peek", "doc_id", "text").where("range is not null")
    return rows.repartitionById(max(n, len(bounds) + 1), F.col("range")).sortWithinPartitions("range", "peek", "doc_id", "text")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprint of each whole text and of its edited text, and how alike it is to that and to the next document's.

    Documents follow each other by doc_id (nulls first; rows that repeat a doc_id by text), the first after the last; a
    lone document is its own next. Null is empty; equal texts have equal fingerprints and likeness 1.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]

    def out(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    def process(held: list) -> list:
        """held: (range, peek, doc_id, text, digest or None); all but the last get their result."""
        done = []
        texts, turn = [], []
        for a, b in zip(held, held[1:]):
            turn.append(not a[1] and a[0] == b[0])
            texts += [a[3].encode(), edited(a[3], b[3]).encode() if turn[-1] else b""]
        texts.append(held[-1][3].encode())
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        data = np.frombuffer(b"".join(texts), np.uint8)
        found = []
        for i, j in pieces(off):
            found += digests(data[off[i] : off[j]], off[i : j + 1] - off[i])
        for k, (a, ok) in enumerate(zip(held, turn)):
            if ok:
                own, new, nxt = found[2 * k], found[2 * k + 1], found[2 * k + 2]
                done.append((a[2], len(a[3]), hashlib.sha256(texts[2 * k + 1]).hexdigest(), _text(own), _text(new), likeness(own, new), likeness(own, nxt)))
        return done

    def run(batches):
        held: list = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("range", "peek", "doc_id", "text"))):
                if held and held[-1][1] and row[1] and held[-1][0] == row[0]:
                    continue  # further rows with the doc_id of the edge
                held.append(row)
                size += len(row[3])
                if size > 1 << 20 and len(held) > 1:
                    yield out(process(held))
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield out(process(held))

    return with_next(docs).mapInArrow(run, schema)
