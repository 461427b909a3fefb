"""Line dedup by an edit-distance join: segments, length-aware substring probes, banded bit-parallel verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import by_group, cut, drop, mix64, partitions, pieces, prefix_hash, release, settled, span_hash, spread
from lineweave.llm.components import components

#: Edits at which two lines still are one, and code points below which only equal lines are.
EDITS, SHORTEST = 2, 20
#: Lines of one part of a key's lines that are compared in one group; code points compared at once.
PART, CELLS = 400, 3_000_000
#: Lines that a task remembers so as not to send them twice.
SEEN = 1_000_000


def split_lines(text: str | None) -> list[tuple[int, str]]:
    """(number, line without white space around it) of the lines that aren't blank."""
    return [(i, x) for i, x in enumerate(map(str.strip, (text or "").split("\n"))) if x]


def line_id(line: str) -> int:
    """A 64-bit hash of the line, as a signed number."""
    h = xxhash.xxh3_64_intdigest(line.encode())
    return h - (1 << 64) if h >> 63 else h


def occurrences(docs: DataFrame) -> DataFrame:
    """(id, doc_id, row, line, size, head) of every line that isn't blank. row: a hash that tells apart texts under one doc_id;
    head: whether it is the first of its text. Rows without a doc_id have none."""

    def run(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, row, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
                for k, (i, x) in enumerate(split_lines(text)):
                    for o, v in zip(out, (line_id(x), doc, row, i, len(x), not k)):
                        o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], ["id", "doc_id", "row", "line", "size", "head"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").mapInArrow(run, "id long, doc_id long, row long, line int, size int, head boolean")


def distinct_lines(batches, least: int):
    """(ids, lines) of the lines of at least so many code points in each batch of texts that the task hasn't met before."""
    seen: set[int] = set()
    for b in batches:
        ids, lines = [], []
        for text in b.column("text").to_pylist():
            for _, x in split_lines(text):
                if len(x) >= least:
                    k = line_id(x)
                    if k not in seen:
                        seen.add(k)
                        ids.append(k)
                        lines.append(x)
        if len(seen) > SEEN:
            seen.clear()
        yield ids, lines


def points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines, and where each begins, ending with their number."""
    return np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)


def segment(size: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of edits + 1 even segments, the last ones one longer, of lines of a size."""
    base, more = size // (edits + 1), size % (edits + 1)
    short = edits + 1 - more
    return i * base + np.maximum(0, i - short), base + (i >= short)


def keys_of(ids: np.ndarray, cps: np.ndarray, off: np.ndarray, edits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, id, slot) of each line's segments and of the substrings that probe for segments of lines that are as long or up
    to `edits` shorter.

    A key stands for length, segment number and content. Two lines within `edits` edits agree in one segment, and if all
    segments before it hold at most as many edits as they are many, its place in the longer line is near to the place
    in the shorter from both ends: only those places probe. slot: segment number and shift of the place, plus 256 for probes
    that aren't a segment of the line itself.
    """
    h = prefix_hash(mix64(cps.astype(np.uint64) + np.uint64(1)))
    begin, size = off[:-1], np.diff(off)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for less in range(edits + 1):
        length = size - less
        fit = length >= max(least, edits + 1)
        for i in range(edits + 1):
            p, n = segment(length, i, edits)
            lo = np.maximum(np.maximum(-i, less - (edits - i)), -p)
            hi = np.minimum(np.minimum(i, less + (edits - i)), size - n - p)
            for shift in range(-edits, 2 * edits + 1):
                ok = np.flatnonzero(fit & (shift >= lo) & (shift <= hi))
                if len(ok):
                    a = begin[ok] + p[ok] + shift
                    key = mix64(span_hash(h, a, a + n[ok]) + (length[ok] * (edits + 1) + i).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                    own = less == 0 and shift == 0
                    out.append((key, ids[ok], np.full(len(ok), i * 16 + shift + edits + 256 * (not own), np.int32)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return tuple(map(np.concatenate, zip(*out)))


def shared_keys(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """(key, id, slot) of the keys that are a segment of one line and are segment or probe of another."""

    def emit(batches):
        for ids, lines in distinct_lines(batches, least):
            cps, off = points(lines)
            for i, j in pieces(off):
                key, own, slot = keys_of(np.array(ids[i:j], np.int64), cps[off[i] : off[j]], off[i : j + 1] - off[i], edits, least)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own), pa.array(slot)], ["key", "id", "slot"])

    def keep(batches):
        for t, at in by_group(batches, ["key"]):
            key, own, slot = t["key"].to_numpy(), t["id"].to_numpy(), t["slot"].to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])  # the least slot of a line stands for it
            lines = np.add.reduceat(new.astype(np.int64), at[:-1])
            some = np.add.reduceat((slot < 256).astype(np.int64), at[:-1])
            good = np.repeat((lines > 1) & (some > 0), np.diff(at)) & new
            yield pa.RecordBatch.from_arrays([pa.array(key[good]), pa.array(own[good]), pa.array(slot[good])], ["key", "id", "slot"])

    rows = docs.select("text").mapInArrow(emit, "key long, id long, slot int")
    return rows.repartition(partitions(rows), "key").sortWithinPartitions("key", "id", "slot").mapInArrow(keep, "key long, id long, slot int")


def within(cps: np.ndarray, off: np.ndarray, i: np.ndarray, j: np.ndarray, edits: int) -> np.ndarray:
    """Whether lines i[x] and j[x] are within the edits, for all x at once.

    Columns are the code points of one line, the bits of a word the rows of the other that lie within the band of 2 edits + 2
    diagonals. The band moves down with each column; the distance is followed along its lowest diagonal and, once that has
    reached the last row, along this row.
    """
    size = np.diff(off)
    w = 2 * edits + 2
    full = np.uint32((1 << w) - 1)
    top = np.uint32(w - 1)
    good = np.zeros(len(i), bool)
    order = np.argsort(size[i], kind="stable")
    order = order[np.abs(size[i[order]] - size[j[order]]) <= edits]
    at = 0
    while at < len(order):
        longest = int(max(size[i[order[at]]], 1)) + edits
        n = max(1, min(len(order) - at, CELLS // (2 * longest + 64)))
        part = order[at : at + n]
        while n > 1 and size[i[part[-1]]] > 2 * longest:
            n = max(1, n // 2)
            part = part[:n]
        at += n
        a, b = i[part], j[part]
        m, k = size[a], size[b]
        rows, cols = int(m.max()), int(k.max())
        place = np.arange(-w, rows + w)[:, None]
        x = np.where((place >= 0) & (place < m), cps[np.minimum(off[a] + np.maximum(place, 0), len(cps) - 1)], np.uint32(0xFFFFFFFF))
        place = np.arange(cols)[:, None]
        y = np.where(place < k, cps[np.minimum(off[b] + place, len(cps) - 1)], np.uint32(0xFFFFFFFE))
        vp = np.full(n, ((1 << (edits + 1)) - 1) << (w - 1 - edits), np.uint32)
        vn = np.zeros(n, np.uint32)
        dist = np.full(n, edits, np.int32)
        for c in range(cols):
            match = np.zeros(n, np.uint32)
            for t in range(w):  # row of bit t, counted from 0
                match |= (x[w + c + edits - (w - 1 - t)] == y[c]).astype(np.uint32) << np.uint32(t) if w + c + edits - (w - 1 - t) < len(x) else np.uint32(0)
            d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
            hp = (vn | ~(d0 | vp)) & full
            hn = d0 & vp
            bit = m - 1 - c - edits + w - 1  # of the last row
            live = c < k
            down = live & (bit >= w - 1)
            flat = live & (bit < w - 1)
            dist += down & ((d0 >> top) & 1 == 0)
            s = np.maximum(bit, 0).astype(np.uint32)
            s = np.minimum(s, top)
            dist += np.where(flat, ((hp >> s) & 1).astype(np.int32) - ((hn >> s) & 1).astype(np.int32), 0)
            d0 >>= np.uint32(1)
            vp = (hn | ~(d0 | hp)) & full
            vn = d0 & hp
        good[part] = dist <= edits
    return good


def first_slot(longer: str, shorter: str, edits: int) -> int:
    """Least slot by which the longer line meets a segment of the shorter; of lines of one length, its own segment comes before
    its probes, as in shared_keys()."""
    less = len(longer) - len(shorter)
    for i in range(edits + 1):
        p, n = (int(v) for v in segment(np.array(len(shorter)), i, edits))
        shifts = range(max(-i, less - (edits - i), -p), min(i, less + (edits - i), len(longer) - n - p) + 1)
        for shift in shifts if less else sorted(shifts, key=bool):
            if longer[p + shift : p + shift + n] == shorter[p : p + n]:
                return i * 16 + shift + edits
    return -1


def compare(t: pa.Table, at: np.ndarray, edits: int) -> pa.RecordBatch:
    """kind 0: (line, other lines linked to it); kind 1: links that connect what all links of a group connect. A pair that
    meets under several keys counts under the first."""
    from lineweave.llm.simhash import forest

    ids, slot, own = t["id"].to_numpy(), t["slot"].to_numpy(), t["own"].to_numpy()
    p, q = t["p"].to_numpy(), t["q"].to_numpy()
    text = t["text"].to_pylist()
    kinds, us, vs = [], [], []
    lefts, rights, n = [], [], 0

    def settle(lefts: list, rights: list) -> None:
        i, j = np.concatenate(lefts), np.concatenate(rights)
        used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        cps, off = points([text[k] for k in used.tolist()])
        a, b = back[: len(i)], back[len(i) :]
        bins = np.bincount(np.repeat(np.arange(len(used)), np.diff(off)) * 32 + ((cps * np.uint32(0x9E3779B1)) >> np.uint32(27)), minlength=32 * len(used)).reshape(-1, 32).astype(np.int32)
        close = np.zeros(len(i), bool)
        for x in range(0, len(i), 50_000):
            y = slice(x, x + 50_000)
            close[y] = np.abs(bins[a[y]] - bins[b[y]]).sum(axis=1) <= 2 * edits  # an edit changes two counts at most
        i, j, a, b = i[close], j[close], a[close], b[close]
        good = within(cps, off, a, b, edits)
        i, j = i[good], j[good]
        once = np.array([first_slot(text[x], text[y], edits) == slot[x] % 256 for x, y in zip(i.tolist(), j.tolist())], bool)
        if len(i):
            line, count = np.unique(np.concatenate([ids[i[once]], ids[j[once]]]), return_counts=True)
            nodes, where = np.unique(np.concatenate([ids[i], ids[j]]), return_inverse=True)
            root = forest(len(nodes), where[: len(i)], where[len(i) :])
            link = np.flatnonzero(root != np.arange(len(nodes)))
            kinds.extend([np.zeros(len(line), np.int32), np.ones(len(link), np.int32)])
            us.extend([line, nodes[link]])
            vs.extend([count, nodes[root[link]]])

    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        size = np.array([len(x) for x in text[a:b]])
        base = np.flatnonzero(slot[a:b] < 256)
        for y in base.tolist():  # y: the line of which the key is a segment
            ok = (size > size[y]) | ((size == size[y]) & (ids[a:b] > ids[a + y]))
            if p[a] != q[a]:
                ok &= own[a:b] != own[a + y]
            x = np.flatnonzero(ok)
            if len(x):
                lefts.append(a + x)
                rights.append(np.full(len(x), a + y))
                n += len(x)
        if n > 100_000:
            settle(lefts, rights)
            lefts, rights, n = [], [], 0
    if n:
        settle(lefts, rights)
    cat = [np.concatenate(x).astype(k) if x else np.zeros(0, k) for x, k in ((kinds, np.int32), (us, np.int64), (vs, np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cat], ["kind", "u", "v"])


def line_links(docs: DataFrame, edits: int = EDITS, least: int = SHORTEST) -> DataFrame:
    """(kind, u, v) over distinct lines of all texts: kind 0 (line, number of other lines within the edits), kind 1 links (u, v)
    that connect the same lines as all links do.

    Keys that very many lines share are dealt out as pairs of parts, so no group grows with them.
    """
    keys = cut(shared_keys(docs, edits, least))
    parts = keys.groupBy("key").count().where(F.col("count") > PART).select("key", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    rows = keys.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", "id", "slot", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def texts(batches):
        for ids, lines in distinct_lines(batches, least):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string())], ["id", "text"])

    wanted = keys.select("id").distinct()
    text = docs.select("text").mapInArrow(texts, "id long, text string").join(wanted, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    text = cut(text)

    def kernel(t, at):
        yield compare(t, at, edits)

    found = cut(spread(rows.join(text, "id"), partitions(docs, 2), ["key", "p", "q"], kernel, "kind int, u long, v long"))
    drop(keys, text)
    return found


def line_classes(docs: DataFrame, edits: int = EDITS, least: int = SHORTEST) -> tuple[DataFrame, DataFrame]:
    """All line occurrences, and for each distinct line (id, n_links, first): the lines that edits connect are one class, and
    first is the (doc_id, row, line) at which the class occurs first."""
    found = line_links(docs, edits, least)
    label = components(found.where("kind = 1").select("u", "v"))
    counts = found.where("kind = 0").groupBy(F.col("u").alias("id")).agg(F.sum("v").alias("n_links"))
    occ = cut(occurrences(docs))
    lines = occ.groupBy("id").agg(F.min(F.struct("doc_id", "row", "line")).alias("own_first"))
    lines = cut(lines.join(counts, "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("class"), "own_first"))
    first = lines.groupBy("class").agg(F.min("own_first").alias("first"))
    lines = cut(lines.join(first, "class").select("id", "class", "n_links", "first"))
    drop(found)
    release(docs.sparkSession)
    return occ, lines


def marked(docs: DataFrame, edits: int = EDITS, least: int = SHORTEST) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, row, line, size, head, n_links, again): each line that isn't blank of rows with a doc_id, and whether its class occurs
    before it; the lines of equal rows come as often as these. Also the tables that it reads."""
    occ, lines = line_classes(docs, edits, least)
    rows = occ.join(lines, "id").select("doc_id", "row", "line", "size", "head", "n_links", (F.struct("doc_id", "row", "line") != F.col("first")).alias("again"))
    return rows, [occ, lines]


def _beside(docs: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """The columns of docs as a struct `own`, whatever their names, with what was found for each (doc_id, row)."""
    own = docs.select(F.struct(*columns).alias("own"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("r"))
    return own.join(found, (F.col("d") == F.col("doc_id")) & (F.col("r") == F.col("row")), "left")


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = SHORTEST) -> DataFrame:
    """docs whose texts have lost the lines that are, but for `edits` edits, lines that come before; n_chars, where there is one,
    is counted anew. What comes before: a smaller doc_id, under one doc_id the text with the smaller hash, in one text the
    line above.

    Lines compare without the white space around them; blank lines stay, and lines shorter than `least` are lost only where an
    equal line occurs before. Null texts and rows without a doc_id stay as they are; a text whose lines all occur before
    becomes empty; equal rows of one doc_id are one document and stay alike. All columns stay, whatever their names.
    """
    found, tables = marked(docs, edits, least)
    rows = _beside(docs, found.where("again").groupBy("doc_id", "row").agg(F.collect_set("line").alias("lost")), *docs.columns)
    left = F.filter(F.split("own.text", "\n", -1), lambda x, i: ~F.array_contains("lost", i))
    text = F.when(F.col("lost").isNull(), F.col("own.text")).otherwise(F.array_join(left, "\n"))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return settled(rows.select(*(out.get(c, F.col("own")[c]).alias(c) for c in docs.columns)), *tables)


def line_report(docs: DataFrame, edits: int = EDITS, least: int = SHORTEST) -> DataFrame:
    """(doc_id, n_lines, n_links, n_again, kept_chars) of each row of docs: its lines that aren't blank, how many other distinct
    lines they link with, how many occur before (as in dedup_lines()), and the code points of the others.

    Rows without a doc_id, and null, empty and blank texts, have zeros. Other columns are not looked at.
    """
    found, tables = marked(docs, edits, least)
    found = found.groupBy("doc_id", "row").agg(F.count("*").alias("n_lines"), F.sum("n_links").alias("n_links"), F.count_if("again").alias("n_again"), F.sum(F.when(~F.col("again"), F.col("size")).otherwise(0)).alias("kept_chars"), F.count_if("head").alias("copies"))
    found = found.select("doc_id", "row", *((F.col(c) / F.col("copies")).cast("long").alias(c) for c in ("n_lines", "n_links", "n_again", "kept_chars")))  # of one of the equal rows
    return settled(_beside(docs, found, "doc_id").select("own.doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_links", "n_again", "kept_chars"))), *tables)
