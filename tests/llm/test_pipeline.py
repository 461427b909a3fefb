"""Each stage of the pipeline against brute force on the rows that the stage before kept."""

import random
from collections import Counter

import pytest
from test_operators import fingerprint, groups, line_truth

import corpus_pipeline
from lineweave.llm import mixing
from lineweave.llm.common import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_language_keeps_clean_documents(stages):
    lang = {r.doc_id: r.lang for r in stages[0].collect()}
    kept = {r.doc_id: r.lang for r in stages[1].collect()}
    assert len(kept) >= 0.95 * len(lang)
    assert sum(lang[d] == x for d, x in kept.items()) >= 0.95 * len(kept)


def test_lines(stages):
    want, _ = line_truth(sorted(texts(stages[1]).items()))
    got = texts(stages[2])
    assert got.keys() == want.keys()
    assert all(sum(len(x.strip()) for x in t.split("\n")) == want[d][3] for d, t in got.items())


def test_one_of_each_group_stays(stages):
    before = texts(stages[2])
    fp = {d: fingerprint(t, 5) for d, t in before.items()}
    ids = sorted(fp)
    root = groups([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 4], ids)
    assert texts(stages[3]) == {d: before[d] for d in ids if root[d] == d}


def test_mix(stages):
    want = Counter({r.row.doc_id: r.copies for r in mixing.mixed(stages[3]).collect() if r.copies})
    assert Counter(r.doc_id for r in stages[4].collect()) == want


def test_pieces(stages):
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter(r.doc_id for r in stages[5].collect())
    assert all(r.parity and r.round_trip for r in stages[5].collect())


def test_near_copies_at_a_jaccard_of_four_fifths(spark):
    rng = random.Random(8)
    rows, shingles = [], {}
    for k in range(120):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 200, 600)))]
        for d in (2 * k, 2 * k + 1):
            rows.append((d, " ".join(w)))
            shingles[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            w = list(w)
            for i in rng.sample(range(len(w)), max(1, len(w) * (1 + k % 3) // 100)):
                w[i] = f"x{rng.randrange(5000)}"
    rows += [(900, None), (901, " "), (902, "")]
    shingles |= {d: set() for d in (900, 901, 902)}
    ids = sorted(shingles)
    alike = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])]
    root = groups(alike, ids)
    far = sum((fingerprint(dict(rows)[a], 5) ^ fingerprint(dict(rows)[b], 5)).bit_count() > 4 for a, b in alike)
    assert far >= 20  # pairs that four bits miss
    kept = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [d for d in ids if root[d] == d]


def test_odd_tables(spark):
    """Nulls, empty and repeated rows, columns whose names the stages use themselves, and an empty table through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred int, _size int, _target string, `row` int, copies int, _lost int, id int, `key` int"
    rest = ("x", 1, 2, "t", 3, 4, 5, 6, 7)
    base = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, None) for k, t in enumerate((None, "", "plain words of a text that says little", "plain words of a text that says little", "12 34", "une phrase dans une autre langue ici"))]
    base += [base[2], (None, "a text without an id but with some words", "en", "s", 3), (None, None, None, None, None), (2, "another text under an id that repeats", "en", "s", 9)]
    docs = spark.createDataFrame([r + rest for r in base], schema)
    for df, least in ((docs, 3), (docs.limit(0), 0)):
        now = df
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = cut(stage(spark, now, SF))
            assert k == 4 or now.columns == docs.columns
        assert now.count() >= least if least else now.count() == 0
