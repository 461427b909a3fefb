"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, with calibrated scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import cut, drop
from lineweave.llm.ftrl import Ftrl
from lineweave.llm.toxicity import remainder

#: Bits of the feature space, longest n-gram, texts of each language that are learned from at most (about: they are
#: chosen by hash), share of them that calibrates, passes over the others.
BITS, LONGEST, SAMPLE, CALIBRATE, PASSES = 15, 3, 1_200, 0.2, 3
RATE, L1, L2, SCALE = 0.5, 0.002, 0.01, 10.0
#: Languages that a model may have: the weights sent to each executor are 2^BITS x languages x 4 bytes.
MOST_LANGUAGES = 500
#: Code points, and texts, that a kernel takes in one go.
_POINTS, _TEXTS = 1 << 20, 256
NONE = "und"
_LETTER = regex.compile(r"\p{L}")


def _pieces(texts: list[str | None]):
    """(first row, code points, where each text begins) of lower-cased texts, in bounded pieces."""
    i = 0
    while i < len(texts):
        part, size = [], 0
        while i + len(part) < len(texts) and len(part) < _TEXTS and (not part or size < _POINTS):
            part.append((texts[i + len(part)] or "").lower())
            size += len(part[-1])
        yield i, np.frombuffer("".join(part).encode("utf-32-le", "replace"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in part])])
        i += len(part)


def ngrams(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the n-grams of 1 to LONGEST code points of all texts, repeats included, text by text."""
    x = points.astype(np.uint32)
    x = np.where((x == 10) | (x == 9) | (x == 13), np.uint32(32), x)
    size = np.diff(off)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    left = np.repeat(off[1:], size) - np.arange(len(x))  # code points from here to the text's end
    rows, keys, h = [], [], np.zeros(len(x), np.uint32)
    for k in range(LONGEST):
        h = (h * np.uint32(0x01000193)) ^ (x * np.uint32(0x9E3779B1) + np.uint32(k))
        keys.append(h.copy())
        rows.append(left > k)
        x = np.append(x[1:], np.uint32(0))
    good = np.stack(rows, axis=1).ravel()
    key = np.stack(keys, axis=1).ravel()[good]
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x85EBCA6B)
    return np.repeat(row, LONGEST)[good], (key >> np.uint32(32 - BITS)).astype(np.int32)


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each bucket occurs, and the number of texts."""

    def run(batches):
        seen, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for _, points, off in _pieces(b.column("text").to_pylist()):
                row, bucket = ngrams(points, off)
                mark = np.zeros((len(off) - 1) << BITS, bool)
                mark[(row.astype(np.int64) << BITS) + bucket] = True
                seen += np.count_nonzero(mark.reshape(-1, 1 << BITS), axis=0)
            n += b.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(seen[at], n), pa.int64())], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out[:-1], int(out[-1])


class Model:
    """Languages, combined weights (inverse document frequency included) of each bucket, bias and temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.weights, self.bias, self.temperature = langs, weights, bias, temperature

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Logits of each text."""
        out = np.tile(self.bias.astype(np.float64), (len(texts), 1))
        table = self.weights.astype(np.float32)
        for i, points, off in _pieces(texts):
            if not len(points):
                continue
            row, bucket = ngrams(points, off)
            n = np.bincount(row, minlength=len(off) - 1)
            full = np.flatnonzero(n)
            begin = np.concatenate([[0], np.cumsum(n)])[full]
            out[i + full] += np.add.reduceat(table[bucket], begin, axis=0, dtype=np.float64) / n[full][:, None]
        return out


def train(examples: DataFrame, langs: list[str], idf: np.ndarray) -> Model:
    """Fits (doc_id, text, lang) examples, whose number the caller bounds, in one task after their n-grams are counted where
    they lie. A part of them sets the temperature that makes the scores true probabilities."""
    place = {x: i for i, x in enumerate(langs)}
    factor = (idf * SCALE).astype(np.float32)

    def featurize(batches):
        for b in batches:
            want = [place[x] for x in b.column("lang").to_pylist()]
            keys, counts = [], []
            for _, points, off in _pieces(b.column("text").to_pylist()):
                row, bucket = ngrams(points, off)
                both, n = np.unique((row.astype(np.int64) << BITS) + bucket, return_counts=True)
                at = np.searchsorted(both >> BITS, np.arange(len(off)))
                keys += [(both[x:y] & ((1 << BITS) - 1)).astype("<u4").tobytes() for x, y in zip(at[:-1], at[1:])]
                counts += [n[x:y].astype("<u4").tobytes() for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("order"), pa.array(want, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["order", "want", "keys", "counts"])

    def fit(batches):
        rows = []
        for b in batches:
            for k, y, x, n in zip(*(c.to_pylist() for c in b.columns)):
                x, n = np.frombuffer(x, "<u4").astype(np.int32), np.frombuffer(n, "<u4").astype(np.float32)
                if len(x):
                    rows.append((k, y, x, n / n.sum() * factor[x]))
        rows.sort(key=lambda r: r[:2])
        model = Ftrl(1 << BITS, max(2, len(langs)), RATE, 1.0, L1, L2)
        split = [((k >> 7) & 1023) < CALIBRATE * 1024 for k, *_ in rows]
        for _ in range(PASSES):
            for (_, y, x, v), out in zip(rows, split):
                if not out:
                    model.step(x, v, y)
        w = model.weights()
        logits = np.array([(w[x] * v[:, None]).sum(axis=0) + model.bias for (_, _, x, v), out in zip(rows, split) if out])
        want = np.array([y for (_, y, _, _), out in zip(rows, split) if out], int)

        def loss(t: float) -> float:
            z = logits / t
            z = z - z.max(axis=1, keepdims=True)
            return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), want]).mean())

        temperature = min(np.geomspace(0.05, 20, 121), key=loss) if len(want) else 1.0
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()]), pa.array([model.bias.astype("<f8").tobytes()]), pa.array([float(temperature)])], ["weights", "bias", "temperature"])

    rows = examples.select(F.xxhash64("doc_id").alias("order"), "lang", "text")
    one = rows.mapInArrow(featurize, "order long, want int, keys binary, counts binary").repartition(1).mapInArrow(fit, "weights binary, bias binary, temperature double").first()
    if one is None:
        return Model(langs, np.zeros((1 << BITS, max(2, len(langs)))), np.zeros(max(2, len(langs))), 1.0)
    w = (np.frombuffer(one[0], "<f4").reshape(1 << BITS, -1) * factor[:, None]).astype(np.float32)
    return Model(langs, w, np.frombuffer(one[1], "<f8"), one[2])


def fitted(docs: DataFrame, sample: int = SAMPLE, folds: int = 3, held: int = 1) -> Model:
    """A model from the text and lang of docs outside the held fold. Document frequencies are those of all these texts;
    weights come from about `sample` texts of each language, chosen by a hash of doc_id, of rows that repeat a doc_id the
    least. More than MOST_LANGUAGES languages are refused."""
    known = docs.where("lang is not null and doc_id is not null and text is not null").where(remainder("doc_id", folds) != held).select("doc_id", "text", "lang")
    count = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    langs = sorted(count)
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages, at most {MOST_LANGUAGES} are possible")
    if not langs:
        return Model([NONE], np.zeros((1 << BITS, 2)), np.zeros(2), 1.0)
    df, n = document_counts(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 11)
    limit = F.coalesce(*[F.when(F.col("lang") == x, F.lit(int(min(1.0, sample / k) * (1 << 53)))) for x, k in count.items()])
    examples = known.where(chance < limit).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x")).select("doc_id", "x.*")
    examples = cut(examples)
    model = train(examples, langs, idf)
    drop(examples)
    return model


def predicted(docs: DataFrame, model: Model, keep: list[str] = ()) -> DataFrame:
    """The columns `keep` of docs with lang_pred and score. Null texts and texts without a letter are `und` with score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^15 buckets x MOST_LANGUAGES at most

    def run(batches):
        m = sent.value
        for b in batches:
            texts = b.column("text").to_pylist()
            z = m.scores(texts)[:, : len(m.langs)] / m.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            letters = [t is not None and _LETTER.search(t) is not None for t in texts]
            lang = [m.langs[k] if ok else NONE for k, ok in zip(best, letters)]
            score = np.where(letters, p[np.arange(len(p)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"])
    columns = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*columns).mapInArrow(run, schema)


def identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs whose language is told with a score of `least` or more, with lang set to it. Null texts and texts without
    a letter go; all columns stay, whatever their names; an empty table gives an empty one."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = predicted(whole, model, ["row"]).where((F.col("lang_pred") != NONE) & (F.col("score") >= least))
    return found.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns))


def languages(docs: DataFrame, folds: int = 3, held: int = 1, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of docs.

    lang_pred is a language of the learned rows, `und` for a null text or one without a letter; score is the calibrated
    probability, 0 for `und`. Rows that repeat a doc_id each have a row; a null doc_id is predicted and not held out;
    without labelled rows all are `und`. Other columns of docs are not looked at.
    """
    model = fitted(docs, folds=folds, held=held, **options)
    out = predicted(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
