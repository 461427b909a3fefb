"""Passages that occur more than once: sparse suffixes at minimisers, sorted by words, compared with neighbours, extended both ways."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import by_group, byte_values, cut, drop, partitions, pieces, prefix_hash, settled, span_hash, utf8, words

#: Words of the shortest passage that counts, and words that two retained suffixes must share to be compared.
PASSAGE, LEADING = 50, 25
#: Bytes beyond which a suffix holds a word's SHA-256 instead (after a byte that no word has), and keys that a task remembers.
LONG, REMEMBER = 64, 1 << 20
#: Suffixes drawn for each range into which they are cut.
PER_RANGE = 20


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, and at which word each text begins."""
    s, e, at = words(data, off)
    return span_hash(prefix_hash(byte_values(data)), s, e), at


def minimisers(hashes: np.ndarray, at: np.ndarray, passage: int, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, hash of the leading words from there on). Each stretch of `passage` words within one text has one anchor: the
    position, among those whose leading words lie within it, with the least hash, the first of equals. Equal stretches have
    equal anchors, wherever they are."""
    n = len(hashes)
    if n < passage:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.arange(n - leading + 1)
    lead = span_hash(prefix_hash(hashes), first, first + leading)
    rank = np.unique(lead, return_inverse=True)[1]
    width = passage - leading + 1
    pad = np.full(-(-(len(lead) + width) // width) * width, np.iinfo(np.int64).max)
    pad[: len(lead)] = (rank.astype(np.int64) << 32) | first
    block = pad.reshape(-1, width)
    pre = np.minimum.accumulate(block, axis=1).ravel()
    suf = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(n - passage + 1)
    text = np.searchsorted(at, start, side="right") - 1
    start = start[start + passage <= at[1:][text]]
    anchor = np.unique(np.minimum(suf[start], pre[start + width - 1]) & 0xFFFFFFFF)
    return anchor, lead[anchor]


class Met:
    """How often a task has met a key, up to two, in a table of fixed size: a key that lost its place counts anew."""

    def __init__(self, size: int = REMEMBER):
        self.keys, self.count = np.zeros(size, np.uint64), np.zeros(size, np.uint8)

    def again(self, key: np.ndarray) -> np.ndarray:
        """Whether each key has come at least twice before."""
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        at = np.flatnonzero(new)
        nth = np.arange(len(k)) - np.repeat(at, np.diff(np.append(at, len(k))))
        slot = (k & np.uint64(len(self.keys) - 1)).astype(np.int64)
        before = np.where(self.keys[slot] == k, self.count[slot], 0)
        out = np.zeros(len(k), bool)
        out[order] = before + nth >= 2
        last = np.append(at[1:], len(k)) - 1
        if len(k):
            self.keys[slot[last]] = k[last]
            self.count[slot[last]] = np.minimum(before[last] + nth[last] + 1, 2)
        return out


def shared_anchors(docs: DataFrame, passage: int, leading: int) -> DataFrame:
    """(row, anchors): positions of retained suffixes whose leading words come at least twice, judged by 64-bit hash, so at most
    too many. A task sends two rows of a key to where the key is looked up; its further ones repeat for sure and go anywhere."""

    def anchors(batches):
        met = Met()
        for b in batches:
            data, off = utf8(b.column("text"))
            row = b.column("row").to_numpy()
            for i, j in pieces(off):
                h, at = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                anchor, lead = minimisers(h, at, passage, leading)
                text = np.searchsorted(at, anchor, side="right") - 1
                known = met.again(lead)
                sent = np.where(known, lead ^ np.arange(1, len(lead) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), lead)
                yield pa.RecordBatch.from_arrays([pa.array(sent.view(np.int64)), pa.array(known), pa.array(row[i:j][text]), pa.array((anchor - at[text]).astype(np.int32))], ["key", "known", "row", "pos"])

    def repeated(batches):
        for t, at in by_group(batches, ["key"]):
            known = t["known"].to_numpy()
            asked = np.add.reduceat((~known).astype(np.int64), at[:-1])
            keep = known | np.repeat(asked > 1, np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(t[c].to_numpy()[keep]) for c in ("row", "pos")], ["row", "pos"])

    rows = docs.select("row", "text").mapInArrow(anchors, "key long, known boolean, row long, pos int")
    found = rows.repartition(partitions(rows), "key").sortWithinPartitions("key").mapInArrow(repeated, "row long, pos int")
    return found.groupBy("row").agg(F.collect_set("pos").alias("anchors"))


def suffixes(docs: DataFrame, shared: DataFrame, passage: int, leading: int, bounds: list[tuple] | None = None) -> DataFrame:
    """(range, lead, c1, c2, suffix, before, doc_id, row, pos) of each retained suffix of shared: its first `passage` words, and the
    `passage - leading` words before it, the nearest first, each with a space after it. c1, c2: 128-bit hash of both. range: how
    many of the bounds (suffix, before, row, pos) are at most the row's."""
    left = passage - leading
    sent = docs.sparkSession.sparkContext.broadcast(bounds or [])  # one a partition

    def run(batches):
        cuts = sent.value
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            digests = []
            for text, row, doc, anchors in zip(*(b.column(c).to_pylist() for c in ("text", "row", "doc_id", "anchors"))):
                ws = text.encode().split()  # at the bytes 09-0D and 20
                ws = [w if len(w) <= LONG else b"\x0b" + hashlib.sha256(w).hexdigest().encode() for w in ws]
                for p in anchors:
                    if p + leading > len(ws):
                        continue  # rows of one 64-bit hash
                    suffix = b" ".join([*ws[p : p + passage], b""])
                    before = b" ".join([*ws[max(0, p - left) : p][::-1], b""])
                    lead = xxhash.xxh3_64_intdigest(b" ".join(ws[p : p + leading]))
                    digests.append(xxhash.xxh3_128_digest(suffix + b"\x0b" + before))
                    for o, v in zip(out, (bisect_right(cuts, (suffix, before, row, p)), lead - (1 << 64) if lead >> 63 else lead, suffix, before, doc, row, p)):
                        o.append(v)
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            where, lead, suffix, before, doc, row, pos = (pa.array(o, k) for o, k in zip(out, kinds))
            yield pa.RecordBatch.from_arrays([where, lead, pa.array(both[:, 0]), pa.array(both[:, 1]), suffix, before, doc, row, pos], ["range", "lead", "c1", "c2", "suffix", "before", "doc_id", "row", "pos"])

    rows = docs.join(shared.withColumnRenamed("row", "r"), F.col("row") == F.col("r")).select("text", "row", "doc_id", "anchors")
    return rows.mapInArrow(run, "range int, lead long, c1 long, c2 long, suffix binary, before binary, doc_id long, row long, pos int")


def range_bounds(docs: DataFrame, shared: DataFrame, passage: int, leading: int, n: int) -> list[tuple]:
    """n - 1 retained suffixes at most, in order, that cut all of them into ranges of about equal size: quantiles of PER_RANGE
    for each range, drawn by hash from the suffixes of texts drawn by hash."""
    texts = shared.count()
    if n < 2 or not texts:
        return []
    some = F.shiftrightunsigned(F.xxhash64("row", F.lit(5)), 11) < F.lit(int(min(1.0, PER_RANGE * n / texts) * (1 << 53)))
    drawn = suffixes(docs.where(some), shared.where(some), passage, leading).select("suffix", "before", "row", "pos")
    rows = drawn.orderBy(F.xxhash64("row", "pos")).limit(PER_RANGE * n).collect()
    rows = sorted((bytes(r[0]), bytes(r[1]), r[2], r[3]) for r in rows)
    return sorted({rows[len(rows) * k // n] for k in range(1, n)}) if rows else []


def word_codes(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal for equal words, one line a row, and the words of each row. Places after the last equal nothing."""
    lists = pc.split_pattern(column.combine_chunks(), " ")
    size = lists.value_lengths().to_numpy(zero_copy_only=False) - 1  # nothing comes after the last space
    codes = lists.flatten().dictionary_encode().indices.to_numpy()
    out = np.repeat(-1 - np.arange(len(size), dtype=np.int64)[:, None], width, axis=1)
    row = np.repeat(np.arange(len(size)), size + 1)
    col = np.arange(len(row)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    inside = col < np.repeat(size, size + 1)
    out[row[inside], col[inside]] = codes[inside]
    return out, size


def extended(t: pa.Table, at: np.ndarray, n: np.ndarray, least: np.ndarray, most: np.ndarray, passage: int, leading: int, within: bool) -> tuple[np.ndarray, ...]:
    """(low, high, least, most) of each row of t: how many words before the suffix the shortest and the longest of its repeated
    stretches reach (high -1: there is none), and the least and greatest doc_id that have one of these stretches.

    Rows come in groups of common leading words, sorted by their words; n of them are equal, in documents from `least` to `most`.
    Neighbours are compared word by word; a stretch that reaches l words back repeats where the suffixes agree in passage - l
    words and what comes before them in l words.
    """
    after, size = word_codes(t["suffix"], passage)
    back, reach = word_codes(t["before"], passage - leading)
    rows = len(n)
    common = np.zeros(rows, np.int64)  # words shared with the row above
    if rows > 1:
        differ = np.concatenate([after[1:] != after[:-1], np.ones((rows - 1, 1), bool)], axis=1)
        common[1:] = differ.argmax(axis=1)
    common[at[:-1]] = 0
    low, high = np.full(rows, passage, np.int64), np.full(rows, -1, np.int64)
    own_least, own_most = np.full(rows, np.iinfo(np.int64).max), np.full(rows, np.iinfo(np.int64).min)
    same = np.zeros(rows, np.int64)
    for l in range(passage - leading + 1):
        if l:
            same = np.unique(same * np.int64(2 * rows + 1 + back.max(initial=0)) + back[:, l - 1] + rows, return_inverse=True)[1]
        ok = np.flatnonzero((reach >= l) & (size >= passage - l))
        if not len(ok):
            continue
        key = np.cumsum(common < passage - l)[ok] * np.int64(rows + 1) + same[ok]
        order = np.argsort(key, kind="stable")
        new = np.ones(len(ok), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        r = ok[order]
        a, b = np.minimum.reduceat(least[r], begin)[group], np.maximum.reduceat(most[r], begin)[group]
        total = np.add.reduceat(n[r], begin)[group] > 1 if within else a < b
        r, a, b = r[total], a[total], b[total]
        low[r], high[r] = np.minimum(low[r], l), np.maximum(high[r], l)
        own_least[r], own_most[r] = np.minimum(own_least[r], a), np.maximum(own_most[r], b)
    return low, high, own_least, own_most


_PAIRS = "array<struct<x:int,y:int>>"
_FOUND = f"part int, key binary, low int, n long, classes {_PAIRS}, class int, doc_id long, row long, a long, b long, least long, most long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), _PAIRS: pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))}


def _found(size: int, **columns) -> pa.RecordBatch:
    fields = [x.split() for x in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _KINDS[k]) if c in columns else pa.nulls(size, _KINDS[k]) for c, k in fields], [c for c, _ in fields])


def stretches(t: pa.Table, at: np.ndarray, n: np.ndarray, least: np.ndarray, most: np.ndarray, part: int, passage: int, leading: int) -> pa.RecordBatch:
    """Each stretch over the classes of equal rows of t by 128-bit hash, which also says where in the stretch the suffix begins, once
    with all its classes: what groups that go on in another task are compared by."""
    picked = t.take(pa.array(at[:-1]))
    held: dict[tuple[bytes, int], list[int]] = {}
    for k, (suffix, before) in enumerate(zip(picked["suffix"].to_pylist(), picked["before"].to_pylist())):
        a, b = suffix.split(), before.split()
        for l in range(min(len(b), passage - leading) + 1):
            if len(a) >= passage - l:
                key = xxhash.xxh3_128_digest(b" ".join([*b[:l][::-1], b"\x0b", *a[: passage - l]]))
                held.setdefault((key, l), []).append(k)
    runs = []
    for ks in held.values():  # neighbours come as ranges from x to y
        k = np.array(ks)
        begin = np.flatnonzero(np.append(True, np.diff(k) > 1))
        end = np.append(begin[1:], len(k)) - 1
        runs.append([{"x": x, "y": y} for x, y in zip(k[begin].tolist(), k[end].tolist())])
    keys, low = [x for x, _ in held], [l for _, l in held]
    return _found(len(held), part=[part] * len(held), key=keys, low=low, n=[int(n[k].sum()) for k in held.values()], classes=runs, least=[int(least[k].min()) for k in held.values()], most=[int(most[k].max()) for k in held.values()])


def compared(rows: DataFrame, n: int, passage: int, leading: int, within: bool) -> DataFrame:
    """What extended() finds for suffixes() that are dealt out by range and sorted by their words, equal ones as one.

    Rows with a: the words from a to b repeat. Ranges are cut by the words, what is before them and the row, so very many
    suffixes with common leading words, and very many equal ones, lie in several tasks. The first and the last group of a task may
    go on in another: rows with a key are their stretches, rows with a class their members (a: the position), both of one part,
    to be settled by key.
    """

    def run(batches):
        from pyspark import TaskContext

        held, part = None, 2 * TaskContext.get().partitionId()
        for t, at in by_group(batches, ["lead"]):
            if held is None:
                yield from opened(t.slice(0, at[1]), part)
                t, at = t.slice(at[1]), at[1:] - at[1]
                held = t.slice(0, 0)
            if len(at) < 2:
                continue
            yield from closed(held, part)
            yield from closed(t.slice(0, at[-2]), part)
            held = t.slice(at[-2])
        if held is not None:
            yield from opened(held, part + 1)

    def equal(t):
        """Where classes of equal rows begin, their sizes, least and greatest doc_id."""
        c1, c2, doc = (t[c].to_numpy() for c in ("c1", "c2", "doc_id"))
        new = np.ones(len(c1), bool)
        new[1:] = (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
        at = np.flatnonzero(new)
        return np.append(at, len(c1)), np.diff(np.append(at, len(c1))), np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)

    def opened(t, part):
        if t.num_rows:
            at, *counted = equal(t)
            yield stretches(t, at, *counted, part, passage, leading)
            own = np.repeat(np.arange(len(at) - 1), np.diff(at))
            yield _found(t.num_rows, part=np.full(t.num_rows, part), **{"class": own}, a=t["pos"].to_numpy().astype(np.int64), **{c: t[c].to_numpy() for c in ("doc_id", "row")})

    def closed(t, part):
        if not t.num_rows:
            return
        lead = t["lead"].to_numpy()
        new = np.ones(len(lead), bool)
        new[1:] = lead[1:] != lead[:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(lead)))
        some = np.repeat(size > 1, size)
        t, new = t.filter(pa.array(some)), new[some]
        if not t.num_rows:
            return
        at, n, least, most = equal(t)
        groups = np.append(np.flatnonzero(new[at[:-1]]), len(n))
        low, high, least, most = (np.repeat(x, n) for x in extended(t.take(pa.array(at[:-1])), groups, n, least, most, passage, leading, within))
        hit = np.flatnonzero(high >= 0)
        pos = t["pos"].to_numpy()[hit]
        yield _found(len(hit), part=np.full(len(hit), part), a=pos - high[hit], b=pos + passage - low[hit], least=least[hit], most=most[hit], doc_id=t["doc_id"].to_numpy()[hit], row=t["row"].to_numpy()[hit])

    dealt = rows.repartitionById(n, F.col("range")).sortWithinPartitions("suffix", "before", "row", "pos")
    return dealt.drop("range").mapInArrow(run, _FOUND)


def settled_groups(found: DataFrame, n: int, passage: int, within: bool) -> DataFrame:
    """(doc_id, row, a, b, least, most) of all suffixes in found whose stretches repeat: what is known already, and members of classes
    that keys of other parts settle. Each part has sent a stretch once, so a stretch that very many suffixes have is as many
    rows as there are parts that have it."""
    keyed = found.where("key is not null").select("part", "key", "low", "n", "classes", "least", "most")
    again = keyed.groupBy("key").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).where("n > 1" if within else "least < most").withColumnRenamed("key", "k")
    hits = keyed.drop("n", "least", "most").join(again, F.col("key") == F.col("k")).select("part", "low", "classes", "least", "most")
    members = found.where("key is null").select("part", "class", "doc_id", "row", "a", "b", "least", "most")
    kind = F.when(F.col("classes").isNotNull(), 0).when(F.col("class").isNotNull(), 1).otherwise(2).alias("kind")
    rows = hits.unionByName(members, allowMissingColumns=True).select("*", kind).repartition(n, "part").sortWithinPartitions("part", "kind")

    def run(batches):
        for t, at in by_group(batches, ["part"]):
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                yield one(t.slice(i, j - i))

    def one(t):
        kind = t["kind"].to_numpy()
        m, end = np.searchsorted(kind, [1, 2]).tolist()  # stretches, then members, then what is known
        own = t["class"].slice(m, end - m).to_numpy()
        size = int(own.max(initial=-1)) + 1
        low, high = np.full(size, passage, np.int64), np.full(size, -1, np.int64)
        least, most = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
        for l, runs, x, y in zip(*(t[c].slice(0, m).to_pylist() for c in ("low", "classes", "least", "most"))):
            for r in runs:
                k = slice(r["x"], r["y"] + 1)
                low[k], high[k] = np.minimum(low[k], l), np.maximum(high[k], l)
                least[k], most[k] = np.minimum(least[k], x), np.maximum(most[k], y)
        hit = high[own] >= 0
        own, (doc, row, pos) = own[hit], (t[c].slice(m, end - m).to_numpy()[hit] for c in ("doc_id", "row", "a"))
        late = (doc, row, pos - high[own], pos + passage - low[own], least[own], most[own])
        names = ["doc_id", "row", "a", "b", "least", "most"]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([t[c].slice(end).to_numpy(), x])) for c, x in zip(names, late)], names)

    return rows.mapInArrow(run, "doc_id long, row long, a long, b long, least long, most long")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, leading: int = LEADING, within: bool = True) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, partner_id): maximal runs of words of each whole text in which every stretch
    of `passage` words occurs at least twice in the table, within one text or in several; with within=False, under two doc_ids at
    least, so that a text which only repeats itself has none.

    Words are [^\\x20\\x09-\\x0D]+ and compare by their bytes. Suffixes are retained at the minimisers of all stretches; those whose
    leading words come once in the table are left out, the others sorted by their words and compared with their neighbours,
    and matches are extended left and right to `passage` words and more. partner_id: the smallest doc_id that has a stretch of
    the run, if that is the own one the greatest. Null, empty and shorter texts have none, nor have rows without a doc_id. Rows
    that repeat a doc_id are texts of their own if they differ; equal ones are one text that repeats. No other column is
    looked at.
    """
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    shared = cut(shared_anchors(docs, passage, leading))
    n = partitions(docs)
    bounds = range_bounds(docs, shared, passage, leading, n)
    found = cut(compared(suffixes(docs, shared, passage, leading, bounds), max(n, len(bounds) + 1), passage, leading, within))
    drop(shared)
    rows = settled_groups(found, n, passage, within)

    def runs(batches):
        for t, at in by_group(batches, ["doc_id", "row"]):
            doc, a, b, least, most = (t[c].to_numpy() for c in ("doc_id", "a", "b", "least", "most"))
            group = np.repeat(np.arange(len(at) - 1), np.diff(at))
            far = int(b.max()) + 2
            reach = np.maximum.accumulate(group * far + b) - group * far  # end of what came before in the text
            new = np.zeros(len(doc), bool)
            new[at[:-1]] = True
            new[1:] |= a[1:] > reach[:-1]
            first = np.flatnonzero(new)
            own, start, end = doc[first], a[first], np.maximum.reduceat(b, first)
            low, high = np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, start, end, end - start, np.where(low != own, low, high))], ["doc_id", "start_word", "end_word", "n_words", "partner_id"])

    dealt = rows.repartition(n, "doc_id", "row").dropDuplicates().sortWithinPartitions("doc_id", "row", "a", "b")  # equal rows once
    return settled(dealt.mapInArrow(runs, "doc_id long, start_word long, end_word long, n_words long, partner_id long"), found)
