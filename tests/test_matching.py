"""match_ranked over whole texts against brute force on a small table."""

from lineweave.operators import matching as M
from lineweave.plans import queries as plans


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_match_ranked_whole_texts(spark, tmp_path):
    head = "the same long beginning of all of these items goes on for over sixty letters "
    texts = [head + "and ends in one way", head + "and ends in one way", head + "and ends in one wax", head + "but" + " other words follow it" * 5, "short text", "short test", "q" * 90]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    entry = [("a.json" if i % 2 == 0 else "b.json", f"item/{i // 2}", t) for i, t in enumerate(texts)]
    want = {}
    for q, t in enumerate(texts):
        hits = [(*e, 1 - distance(t, e[2]) / max(len(t), len(e[2]))) for e in sorted(entry)]
        hits = [h for h in hits if h[3] == 1] + [h for h in hits if 0.7 <= h[3] < 1]
        for file, key, x, score in hits:
            for f, k, y in [(file, key, x)] * (x != t) + [e for e in sorted(entry) if e[1] == key and e[0] != file and e[2] != x]:
                want.setdefault((q, f, k, y), round(score, 9))
    got = {(r.query_id, r.file, r.key, r.text): round(r.score, 9) for r in plans.QUERIES["match_ranked"](spark, str(tmp_path)).collect()}
    assert got == want and any(0.7 <= s < 1 for s in want.values())


def test_normalized(spark):
    cases = {"Hello, {\\i1}World!": "hello world", "a\\Nb": "a b", "x{a{b}c}y{z": "xy", "<i>q</i> 1 < 2": "q 1 2", "「ÀÉ」Я　ｚＡ": "àéя ｚａ", "a\u200bb\u00a0 c": "ab c"}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").select("t", M.normalize("t").alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases


def test_all_passes(spark):
    entries = spark.createDataFrame([("en.json", "greet", "Hello there"), ("zh.json", "greet", "你好"), ("en.json", "long", "First part.{*1}Second part here{*2}Third"), ("zh.json", "long", "一{*1}二{*2}三"), ("en.json", "menu_title", "x"), ("en.json", "other", "Hello therr")], "file string, key string, text string")
    pairs = spark.createDataFrame([("p.json", "k", "Good night{*1}sleep well", "晚安{*1}睡好")], "file string, key string, source string, translation string")
    languages = spark.createDataFrame([("zh.json", "zh"), ("en.json", "en")], "file string, language string")
    queries = spark.createDataFrame([(1, "hello there!"), (2, "second part here"), (3, "menu title"), (4, "sleep well"), (5, "..."), (6, "Hello there")], "query_id int, text string")
    got = {}
    for r in M.match(queries, entries, 0.7, pairs=pairs, languages=languages, preferred="zh").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.file, r.key, r.text, r.exact, r.from_key))
    assert got[1] == [("zh.json", "greet", "你好", True, False), ("en.json", "greet", "Hello there", True, False), ("en.json", "other", "Hello therr", False, False)]
    assert got[2][:2] == [("zh.json", "long", "二", True, False), ("en.json", "long", "Second part here", True, False)]
    assert got[3] == [("en.json", "menu_title", "x", False, True)]
    assert got[4] == [("p.json", "k", "睡好", True, False)]
    assert 5 not in got and [x[2] for x in got[6]] == ["你好", "Hello therr"]
    assert [r.rank for r in M.match(queries, entries, 0.7, most=1).where("query_id = 1").collect()] == [1]
