"""Named queries over the driver's tables, each a use of one operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.functions import htmltags as HT
from lineweave.functions import kana as KN
from lineweave.functions import markup as B
from lineweave.functions import paths as P
from lineweave.functions import patterns as R
from lineweave.functions import shapes as SH
from lineweave.functions import tags as N
from lineweave.functions import text as X
from lineweave.functions import times as T
from lineweave.operators import editing as E
from lineweave.operators import evidence as V
from lineweave.operators import history as H
from lineweave.operators import karaoke as K
from lineweave.operators import lines as L
from lineweave.operators import matching as M
from lineweave.operators import resample as Z
from lineweave.operators import styles as S
from lineweave.operators import templates as TP
from lineweave.operators import timing as G
from lineweave.operators import windows as W
from lineweave.plans import tables as D
from lineweave.sources import ttxt as TX
from lineweave.sources import writers as WR

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def over_lines(name: str, run: Callable[[DataFrame], DataFrame], sql: str | None, *more: str) -> None:
    """A query that needs the lines alone."""
    QUERIES[name] = lambda spark, d: run(D.lines(spark, d))
    if sql:
        SQL[name] = f"WITH {', '.join((D.LINES, *more))} {sql}"


COLUMNS = "file_id, id, row_no, comment, layer, start_ms, end_ms, style, actor, effect, text"


def odd():
    return F.col("row_no") % 3 != 1


ODD = "row_no % 3 <> 1"

# predicates, search, selections
over_lines("select_contains", lambda d: L.select(d, L.matches("text", "an"), comments=False), f"SELECT {COLUMNS} FROM lines WHERE contains(text, 'an') AND NOT comment")
over_lines("select_exact", lambda d: L.select(d, L.matches("actor", "user", "exact")), f"SELECT {COLUMNS} FROM lines WHERE actor = 'user'")
over_lines("select_ignore_case", lambda d: L.select(d, L.matches("text", "THE", ignore_case=True)), f"SELECT {COLUMNS} FROM lines WHERE contains(lower(text), 'the')")
over_lines("select_regex_invert", lambda d: L.select(d, L.matches("text", "^[A-M]", "regex"), invert=True), f"SELECT {COLUMNS} FROM lines WHERE NOT regexp_matches(text, '^[A-M]')")
over_lines("selection_union", lambda d: L.selection(d.where("layer = 1"), d.where("row_no > 2"), "add"), "SELECT DISTINCT file_id, id FROM lines WHERE layer = 1 OR row_no > 2")
over_lines("selection_subtract", lambda d: L.selection(d.where("layer = 1"), d.where("row_no > 2"), "subtract"), "SELECT file_id, id FROM lines WHERE layer = 1 AND NOT row_no > 2")
over_lines("selection_intersect", lambda d: L.selection(d.where("layer = 1"), d.where("row_no > 2"), "intersect"), "SELECT file_id, id FROM lines WHERE layer = 1 AND row_no > 2")
over_lines("find_next", lambda d: L.find_next(d, L.matches("text", "on"), 1), "SELECT file_id, arg_min(id, (CASE WHEN row_no <= 1 THEN 1000 ELSE 0 END) + row_no) AS id, arg_min(row_no, (CASE WHEN row_no <= 1 THEN 1000 ELSE 0 END) + row_no) AS row_no FROM lines WHERE contains(text, 'on') GROUP BY file_id")
over_lines("replace_all_text", lambda d: L.replace_all(d, "text", "[aeiou]n", "##").select("id", "text"), "SELECT id, regexp_replace(text, '[aeiou]n', '##', 'g') AS text FROM lines")
over_lines("replace_all_count", lambda d: L.count_matches(d, "text", "[aeiou]n"), "SELECT file_id, sum(len(regexp_extract_all(text, '[aeiou]n')))::BIGINT AS matches, count(*) FILTER (regexp_matches(text, '[aeiou]n')) AS lines_changed FROM lines GROUP BY file_id")
over_lines("visible_at", lambda d: L.visible_at(d, 7000), f"SELECT {COLUMNS} FROM lines WHERE NOT comment AND start_ms <= 7000 AND end_ms > 7000")
over_lines("toggle_comment", lambda d: L.toggle_comment(d).select("id", "comment"), "SELECT id, NOT (bool_and(comment) OVER (PARTITION BY file_id)) AS comment FROM lines")
over_lines("paste_over", lambda d: L.paste_over(d, d.where("row_no > 0").withColumns({"row_no": F.col("row_no") - 1, "text": F.reverse("text")}), ["text", "layer"]).select("id", "text", "layer"), "SELECT a.id, CASE WHEN b.id IS NULL THEN a.text ELSE reverse(b.text) END AS text, CASE WHEN b.id IS NULL THEN a.layer ELSE b.layer END AS layer FROM lines a LEFT JOIN lines b ON a.file_id = b.file_id AND b.row_no = a.row_no + 1")
over_lines("select_overlaps", lambda d: L.select_overlaps(d).select("file_id", "id"), "SELECT file_id, id FROM (SELECT *, (SELECT max(1) FROM k WHERE k.file_id = l.file_id AND k.id = l.id) AS kept FROM lines l) WHERE kept IS NULL", "k AS (WITH RECURSIVE r AS (SELECT file_id, id, row_no, end_ms FROM lines WHERE row_no = 0 UNION ALL SELECT n.file_id, n.id, n.row_no, n.end_ms FROM r JOIN lines n ON n.file_id = r.file_id AND n.row_no = (SELECT min(x.row_no) FROM lines x WHERE x.file_id = r.file_id AND x.row_no > r.row_no AND x.start_ms >= r.end_ms)) SELECT * FROM r)")
over_lines("collisions", lambda d: W.interval_join(d, d.select("file_id", "id", "start_ms", "end_ms"), ["file_id"], 5000).where("id < b_id").select("file_id", "id", "b_id"), "SELECT a.file_id, a.id, b.id AS b_id FROM lines a JOIN lines b ON a.file_id = b.file_id AND a.id < b.id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms")

# order
for key, column in (("style", "style"), ("text", "text"), ("end", "end_ms"), ("layer", "layer"), ("actor", "actor")):
    over_lines(f"sort_by_{key}", lambda d, key=key: L.sort_lines(d, key).select("id", "row_no"), f"SELECT id, (row_number() OVER (PARTITION BY file_id ORDER BY {column}, row_no) - 1)::INT AS row_no FROM lines")
over_lines("sort_stripped", lambda d: L.sort_lines(d.withColumn("text", F.concat(F.lit("{\\b1}"), F.reverse("text"))), "stripped").select("id", "row_no"), "SELECT id, (row_number() OVER (PARTITION BY file_id ORDER BY reverse(text), row_no) - 1)::INT AS row_no FROM lines")
over_lines("sort_selected_blocks", lambda d: L.sort_blocks(d, odd(), "text").select("id", "row_no"), f"SELECT id, (CASE WHEN s THEN min(row_no) OVER (PARTITION BY file_id, g) + row_number() OVER (PARTITION BY file_id, g ORDER BY text, row_no) - 1 ELSE row_no END)::INT AS row_no FROM (SELECT *, {ODD} AS s, CASE WHEN {ODD} THEN row_no - row_number() OVER (PARTITION BY file_id, {ODD} ORDER BY row_no) ELSE -1000 - row_no END AS g FROM lines)")
over_lines("move_up", lambda d: L.move(d, F.col("row_no").isin(2, 4)).select("id", "row_no"), "SELECT id, (CASE WHEN row_no IN (2, 4) THEN row_no - 1 WHEN row_no IN (1, 3) AND EXISTS (SELECT 1 FROM lines b WHERE b.file_id = a.file_id AND b.row_no = a.row_no + 1) THEN row_no + 1 ELSE row_no END)::INT AS row_no FROM lines a")
over_lines("recent_texts", lambda d: L.recent(d, "actor", "id", 2, ["file_id"]), "SELECT file_id, actor, id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY id DESC, actor) AS rank FROM (SELECT file_id, actor, max(id) AS id FROM lines GROUP BY ALL)) WHERE rank <= 2")
over_lines("neighbours", lambda d: L.neighbours(d).select("id", "prev_id", "next_id"), "SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM lines WINDOW w AS (PARTITION BY file_id ORDER BY row_no)")

# edits
over_lines("delete_lines", lambda d: L.delete(d, d.where("layer = 1")).select("id", "row_no"), "SELECT id, (row_number() OVER (PARTITION BY file_id ORDER BY row_no) - 1)::INT AS row_no FROM lines WHERE layer <> 1")
over_lines("duplicate_blocks", lambda d: L.duplicate_blocks(d, odd()).select("id", "copy", "row_no"), f"SELECT id, copy, (row_number() OVER (PARTITION BY file_id ORDER BY g, copy, row_no) - 1)::INT AS row_no FROM (SELECT *, sum(n) OVER (PARTITION BY file_id ORDER BY row_no) AS g FROM (SELECT *, {ODD} AS s, CASE WHEN lag({ODD}) OVER (PARTITION BY file_id ORDER BY row_no) IS NOT DISTINCT FROM ({ODD}) THEN 0 ELSE 1 END AS n FROM lines)) CROSS JOIN (VALUES (0), (1)) AS c(copy) WHERE s OR copy = 0")
over_lines("split_at", lambda d: L.split_at(d, 4000).select("id", "row_no", "part", "start_ms", "end_ms"), "SELECT id, (row_number() OVER (PARTITION BY file_id ORDER BY row_no, part) - 1)::INT AS row_no, part, CASE WHEN h AND part = 1 THEN 4000 ELSE start_ms END AS start_ms, CASE WHEN h AND part = 0 THEN 4000 ELSE end_ms END AS end_ms FROM (SELECT *, start_ms < 4000 AND end_ms > 4000 AS h FROM lines) CROSS JOIN (VALUES (0), (1)) AS c(part) WHERE h OR part = 0")
over_lines("join_concat", lambda d: L.join_lines(d, ["file_id", "layer"]), "SELECT file_id, layer, min(row_no) AS row_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY row_no) AS text FROM lines GROUP BY file_id, layer")
over_lines("join_keep_first", lambda d: L.join_lines(d, ["file_id"], "keep_first"), "SELECT file_id, min(row_no) AS row_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, arg_min(text, row_no) AS text FROM lines GROUP BY file_id")
over_lines("join_karaoke", lambda d: L.join_lines(d, ["file_id"], "karaoke"), "SELECT file_id, min(row_no) AS row_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg('{\\k' || ((end_ms - start_ms) // 10)::VARCHAR || '}' || text, '' ORDER BY row_no) AS text FROM lines GROUP BY file_id")
over_lines("fit_new_line", lambda d: L.fit_new_line(d, 3500, 5000), "SELECT file_id, 3500 AS start_ms, least(8500, min(CASE WHEN start_ms >= 3500 THEN start_ms END)) AS end_ms FROM lines GROUP BY file_id")
over_lines("insert_after", lambda d: L.insert_beside(d, d.where("layer = 1"), 2000).select("file_id", "id", "row_no", "start_ms", "end_ms"), "SELECT file_id, CASE WHEN s = 0 THEN id END AS id, (row_number() OVER (PARTITION BY file_id ORDER BY row_no, s) - 1)::INT AS row_no, CASE WHEN s = 0 THEN start_ms ELSE end_ms END AS start_ms, CASE WHEN s = 0 THEN end_ms ELSE greatest(end_ms, least(end_ms + 2000, coalesce(n, end_ms + 2000))) END AS end_ms FROM (SELECT *, lead(start_ms) OVER (PARTITION BY file_id ORDER BY row_no) AS n FROM lines) CROSS JOIN (VALUES (0), (1)) AS c(s) WHERE s = 0 OR layer = 1")
over_lines("recombine", lambda d: L.recombine(d).select("file_id", "id", "start_ms", "end_ms", "text"), None)
over_lines("infer_resolution", lambda d: d.select("id", L.resolution(F.when(F.col("layer") == 0, 0).when(F.col("layer") == 1, 1280).otherwise(640), F.when(F.col("row_no") % 2 == 0, 0).otherwise(1024)).alias("r")).select("id", "r.width", "r.height"), "SELECT id, CASE WHEN w = 0 AND h = 0 THEN 384 WHEN w = 0 AND h = 1024 THEN 1280 WHEN w = 0 THEN h * 4 // 3 ELSE w END AS width, CASE WHEN w = 0 AND h = 0 THEN 288 WHEN h = 0 AND w = 1280 THEN 1024 WHEN h = 0 THEN w * 3 // 4 ELSE h END AS height FROM (SELECT id, CASE layer WHEN 0 THEN 0 WHEN 1 THEN 1280 ELSE 640 END AS w, CASE WHEN row_no % 2 = 0 THEN 0 ELSE 1024 END AS h FROM lines)")
over_lines("clear_text", lambda d: d.select("id", X.only_tags(F.concat(F.lit("{\\i1}a{x}"), "text")).alias("text")), "SELECT id, '{\\i1}{x}' AS text FROM lines")

# preparation for export
over_lines("strip_comments", L.strip_comments, f"SELECT {COLUMNS} FROM lines WHERE NOT comment AND text <> ''")
over_lines("strip_tags", lambda d: d.select("id", X.strip_tags(F.concat(F.lit("{\\b1}"), "text", F.lit("{\\b0}"))).alias("text")), "SELECT id, text FROM lines")
over_lines("convert_newlines", lambda d: d.select("id", X.convert_newlines(F.concat(F.lit("a\\hb\\N\\n"), "text"), "|", True).alias("text")), "SELECT id, 'a b|' || CASE WHEN starts_with(text, '|') THEN NULL ELSE text END AS text FROM lines")
over_lines("merge_identical", lambda d: L.merge_identical(d.withColumns({"text": F.col("layer").cast("string"), "end_ms": F.col("start_ms") + 3000}).withColumn("text", F.floor(F.col("row_no") / 2).cast("string"))), "SELECT file_id, min(row_no) AS row_no, min(start_ms) AS start_ms, max(start_ms + 3000) AS end_ms, (row_no // 2)::VARCHAR AS text, count(*) AS n FROM lines GROUP BY file_id, row_no // 2")
over_lines("recombine_coverage", L.coverage, "SELECT p.file_id, p.s AS start_ms, p.e AS end_ms, count(*) AS active FROM (SELECT file_id, t AS s, lead(t) OVER (PARTITION BY file_id ORDER BY t) AS e FROM (SELECT file_id, start_ms AS t FROM lines UNION SELECT file_id, end_ms FROM lines)) p JOIN lines l ON l.file_id = p.file_id AND l.start_ms <= p.s AND l.end_ms >= p.e WHERE p.e IS NOT NULL GROUP BY ALL")
over_lines("recombine_overlaps", lambda d: L.recombine_overlaps(d).select("file_id", "row_no", "start_ms", "end_ms", "text"), None)
over_lines("gap_blanks", L.gap_blanks, "SELECT file_id, end_ms AS start_ms, n AS end_ms FROM (SELECT *, lead(start_ms) OVER (PARTITION BY file_id ORDER BY start_ms, row_no) AS n FROM lines) WHERE n > end_ms")
over_lines("actor_share", L.actor_share, "SELECT file_id, (count(*) FILTER (actor <> ''))::DOUBLE / count(*) AS share, (count(*) FILTER (actor <> ''))::DOUBLE / count(*) > 0.5 AS write_actor FROM lines WHERE NOT comment GROUP BY file_id")
over_lines("fill_actor", lambda d: L.fill_actor(d).select("id", "actor"), "SELECT id, coalesce(last_value(nullif(actor, '') IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS actor FROM lines")

# scalar functions
over_lines("cps", lambda d: d.select("id", X.chars_per_second("text", "start_ms", "end_ms").alias("cps")), "SELECT id, (CASE WHEN end_ms - start_ms <= 100 OR strlen(text) > end_ms - start_ms THEN -1 ELSE length(text) * 1000 // (end_ms - start_ms) END)::INT AS cps FROM lines")
over_lines("char_count", lambda d: d.select("id", X.char_count("text", whitespace=False).alias("n"), X.max_line_length(F.concat("text", F.lit("\\Nab"))).alias("longest")), r"SELECT id, length(regexp_replace(text, '[\s\p{Z}]', '', 'g'))::INT AS n, greatest(length(text), 2)::INT AS longest FROM lines")
over_lines("format_times", lambda d: d.select("id", T.format_ass("end_ms").alias("ass"), T.format_srt("end_ms").alias("srt"), T.parse(T.format_srt("end_ms")).alias("back")), "SELECT id, printf('%d:%02d:%02d.%02d', c // 360000, c // 6000 % 60, c // 100 % 60, c % 100) AS ass, printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) AS srt, end_ms AS back FROM (SELECT *, (end_ms + 5) // 10 AS c FROM lines)")
over_lines("frame_at_time", lambda d: d.select("id", *(T.frame_at("end_ms", 24000, 1001, m).alias(m) for m in ("exact", "start", "end"))), "SELECT l.id, max(CASE WHEN f.ms <= end_ms THEN f.frame END) AS exact, min(CASE WHEN f.ms >= end_ms THEN f.frame END) AS start, max(CASE WHEN f.ms < end_ms THEN f.frame END) AS \"end\" FROM lines l JOIN f ON f.frame BETWEEN end_ms * 0.0239 - 3 AND end_ms * 0.024 + 3 GROUP BY ALL", "f AS (SELECT k::INT AS frame, ((k * 1001000 + 12000) // 24000)::INT AS ms FROM range(0, 200000) AS r(k))")
over_lines("time_at_frame", lambda d: d.select("id", T.time_at(F.col("row_no") * 100, 24000, 1001).alias("ms")), "SELECT id, ((row_no::BIGINT * 100 * 1001000 + 12000) // 24000)::INT AS ms FROM lines")
over_lines("smpte_dropframe", lambda d: d.select("id", T.smpte((F.col("id") * 37).cast("bigint"), 30, True).alias("code"), T.smpte((F.col("id") * 37).cast("bigint"), 25).alias("pal")), "SELECT id, printf('%02d:%02d:%02d;%02d', g // 108000, g // 1800 % 60, g // 30 % 60, g % 30) AS code, printf('%02d:%02d:%02d:%02d', f // 90000, f // 1500 % 60, f // 25 % 60, f % 25) AS pal FROM (SELECT id, f, f + f // 17982 * 18 + CASE WHEN f % 17982 >= 2 THEN 2 * ((f % 17982 - 2) // 1798) ELSE 0 END AS g FROM (SELECT id, id * 37 AS f FROM lines))")
over_lines("color_format", lambda d: d.select("id", X.color_style(F.col("row_no") * 30, F.col("layer") * 100, F.lit(7), F.lit(0)).alias("c")).select("id", "c", X.color_channels("c").alias("x")).select("id", "c", "x.r", "x.g", "x.b"), "SELECT id, printf('&H0007%02X%02X', layer * 100, row_no * 30) AS c, row_no * 30 AS r, layer * 100 AS g, 7 AS b FROM lines")

# times
over_lines("shift_times", lambda d: G.shift(d, -5000, end=False).select("id", "start_ms", "end_ms"), "SELECT id, greatest(start_ms - 5000, 0) AS start_ms, end_ms FROM lines")
over_lines("shift_onward", lambda d: G.shift(d, 700, selected=F.col("layer") == 2, onward=True).select("id", "start_ms", "end_ms"), "SELECT id, start_ms + 700 * h AS start_ms, end_ms + 700 * h AS end_ms FROM (SELECT *, max((layer = 2)::INT) OVER (PARTITION BY file_id ORDER BY row_no) AS h FROM lines)")
over_lines("lead_in", lambda d: G.lead_in(d, 500).select("id", "start_ms"), "SELECT a.id, greatest(a.start_ms - 500, coalesce(max(b.end_ms), 0)) AS start_ms FROM lines a LEFT JOIN lines b ON a.file_id = b.file_id AND b.end_ms <= a.start_ms GROUP BY a.id, a.start_ms")
over_lines("lead_out", lambda d: G.lead_out(d, 500).select("id", "end_ms"), "SELECT a.id, least(a.end_ms + 500, min(b.start_ms)) AS end_ms FROM lines a LEFT JOIN lines b ON a.file_id = b.file_id AND b.start_ms >= a.end_ms GROUP BY a.id, a.end_ms")
over_lines("make_adjacent", lambda d: G.make_adjacent(d, 2000, 1000).select("id", "start_ms", "end_ms"), "SELECT id, CASE WHEN (start_ms - p > 0 AND start_ms - p <= 2000) OR (start_ms - p < 0 AND p - start_ms <= 1000) THEN p + trunc((start_ms - p) * 0.5)::INT ELSE start_ms END AS start_ms, CASE WHEN (n - end_ms > 0 AND n - end_ms <= 2000) OR (n - end_ms < 0 AND end_ms - n <= 1000) THEN end_ms + trunc((n - end_ms) * 0.5)::INT ELSE end_ms END AS end_ms FROM (SELECT *, lag(end_ms) OVER w AS p, lead(start_ms) OVER w AS n FROM lines WINDOW w AS (PARTITION BY file_id ORDER BY start_ms, row_no))")
over_lines("continuous_end", lambda d: G.make_continuous(d).select("id", "end_ms"), "SELECT id, coalesce(lead(start_ms) OVER (PARTITION BY file_id ORDER BY row_no), end_ms) AS end_ms FROM lines")
_RATES = "f AS (SELECT k::INT AS frame, ((k * 1001000 + 12000) // 24000)::INT AS a, (((k + 1) * 1001000 + 12000) // 24000)::INT AS b, (k * 40)::INT AS p, ((k + 1) * 40)::INT AS q FROM range(0, 200000) AS r(k))"
over_lines("transform_rate", lambda d: G.transform_rate(d, (24000, 1001), (25, 1)).select("id", "start_ms", "end_ms"), "SELECT l.id, (trunc(s.p + (s.q - s.p) * ((start_ms - s.a) / (s.b - s.a)::DOUBLE))::INT // 10 * 10)::INT AS start_ms, ((trunc(e.p + (e.q - e.p) * ((end_ms - e.a) / (e.b - e.a)::DOUBLE))::INT + 9) // 10 * 10)::INT AS end_ms FROM lines l JOIN f s ON s.a <= start_ms AND start_ms < s.b JOIN f e ON e.a <= end_ms AND end_ms < e.b", _RATES)
over_lines("snap_to_scene", lambda d: G.snap_to_scene(d, d.select("file_id", (F.col("row_no") * 70).alias("frame")), F.col("layer") > 0, 100, (25, 1), 5000).select("id", "start_ms", "end_ms"), "SELECT id, CASE WHEN layer > 0 THEN greatest(coalesce(a, 0) * 40 - 20, 0) ELSE start_ms END AS start_ms, CASE WHEN layer > 0 THEN (coalesce(b, 5000) - 1) * 40 + 20 ELSE end_ms END AS end_ms FROM (SELECT *, max(CASE WHEN row_no * 70 <= 100 THEN row_no * 70 END) OVER (PARTITION BY file_id) AS a, min(CASE WHEN row_no * 70 > 100 THEN row_no * 70 END) OVER (PARTITION BY file_id) AS b FROM lines)")
over_lines("snap_to_frame", lambda d: G.snap_to_frame(d, F.col("layer") > 0, 100, (25, 1)).select("id", "start_ms", "end_ms"), "SELECT id, CASE WHEN layer > 0 THEN 3980 ELSE start_ms END AS start_ms, CASE WHEN layer > 0 THEN greatest(end_ms, 4020) ELSE end_ms END AS end_ms FROM lines")
over_lines("snap_keyframes", lambda d: G.snap_to_keyframes(d, d.select("file_id", (F.col("row_no") * 70).alias("frame")), (25, 1), (500, 700, 600, 400)).select("id", "start_ms", "end_ms"), """SELECT id, CASE WHEN (ks > fs AND ks * 40 - 20 - start_ms <= 500) OR (ks < fs AND start_ms - (ks * 40 - 20) <= 700) THEN greatest(ks * 40 - 20, 0) ELSE start_ms END AS start_ms, CASE WHEN (ke - 1 > fe AND (ke - 1) * 40 + 20 - end_ms <= 600) OR (ke - 1 < fe AND end_ms - ((ke - 1) * 40 + 20) <= 400) THEN greatest((ke - 1) * 40 + 20, 0) ELSE end_ms END AS end_ms
FROM (SELECT l.*, arg_min(k.k, (abs(k.k - fs), k.k)) AS ks, arg_min(k.k, (abs(k.k - fe), k.k)) AS ke FROM (SELECT *, (start_ms + 39) // 40 AS fs, (end_ms - 1) // 40 AS fe FROM lines) l JOIN (SELECT DISTINCT file_id, row_no * 70 AS k FROM lines) k USING (file_id) GROUP BY ALL)""")
over_lines("join_next", lambda d: E.join_neighbour(d, d.where("row_no % 3 = 0")).select("id", "row_no", "start_ms", "end_ms", "text"), "SELECT id, (row_number() OVER (PARTITION BY file_id ORDER BY row_no) - 1)::INT AS row_no, CASE WHEN j THEN least(start_ms, ns) ELSE start_ms END AS start_ms, CASE WHEN j THEN greatest(end_ms, ne) ELSE end_ms END AS end_ms, CASE WHEN j THEN concat_ws(' ', nullif(trim(text), ''), nullif(trim(nt), '')) ELSE text END AS text FROM (SELECT *, row_no % 3 = 0 AND nt IS NOT NULL AS j FROM (SELECT *, lead(start_ms) OVER w AS ns, lead(end_ms) OVER w AS ne, lead(text) OVER w AS nt FROM lines WINDOW w AS (PARTITION BY file_id ORDER BY row_no))) WHERE row_no % 3 <> 1")
over_lines("split_cursor", lambda d: E.split_at_cursor(d, d.where("layer = 1").select("file_id", "id", F.octet_length(F.substring("text", 1, 9)).alias("pos")), "estimate").select("file_id", "id", "row_no", "start_ms", "end_ms", "text"), "SELECT file_id, CASE WHEN k = 0 THEN id END AS id, (row_number() OVER (PARTITION BY file_id ORDER BY row_no, k) - 1)::INT AS row_no, CASE WHEN k = 1 THEN m ELSE start_ms END AS start_ms, CASE WHEN layer = 1 AND k = 0 THEN m ELSE end_ms END AS end_ms, CASE WHEN layer <> 1 THEN text WHEN k = 0 THEN a ELSE b END AS text FROM (SELECT *, CASE WHEN strlen(a) + strlen(b) > 0 THEN start_ms + trunc((end_ms - start_ms) * (strlen(a) / (strlen(a) + strlen(b))::DOUBLE))::INT END AS m FROM (SELECT *, rtrim(text[:9], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS a, ltrim(text[10:], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b FROM lines)) CROSS JOIN (VALUES (0), (1)) AS c(k) WHERE layer = 1 OR k = 0")
over_lines("copy_paste_rows", lambda d: E.paste_rows(d, E.copy_rows(d.where("layer = 1")).withColumn("at", F.lit(1))).select("file_id", "id", "row_no", "start_ms", "end_ms", "style", "text"), "SELECT file_id, id, (row_number() OVER (PARTITION BY file_id ORDER BY a, b, row_no) - 1)::INT AS row_no, start_ms, end_ms, style, text FROM (SELECT *, row_no AS a, 1 AS b FROM lines UNION ALL SELECT file_id, NULL, row_no, comment, layer, (start_ms + 5) // 10 * 10, (end_ms + 5) // 10 * 10, style, actor, effect, trim(regexp_replace(text, '[\r\n]', '', 'g')), 1, 0 FROM lines WHERE layer = 1)")
over_lines("visible_at_frame", lambda d: E.visible_at_frame(d, 100, (25, 1)).select("id"), "SELECT id FROM lines WHERE (start_ms + 39) // 40 <= 100 AND (end_ms - 1) // 40 >= 100")
over_lines("replace_one", lambda d: E.replace_one(d, d.where("layer = 1"), "text", "([aeiou])n", "<$1>").select("id", "text"), "SELECT id, CASE WHEN layer = 1 THEN regexp_replace(text, '([aeiou])n', '<\\1>') ELSE text END AS text FROM lines")
over_lines("grid_columns", lambda d: E.grid(d.withColumn("text", F.concat(F.lit("{\\i1}"), "text")), rate=(25, 1)).select("id", "number", "layer", "start", "end", "text"), "SELECT id, row_no + 1 AS number, CASE WHEN layer = 0 THEN '' ELSE layer::VARCHAR END AS layer, ((start_ms + 39) // 40)::VARCHAR AS start, ((end_ms - 1) // 40)::VARCHAR AS \"end\", '☀' || text AS text FROM lines")
over_lines("column_widths", E.column_widths, "SELECT file_id, max(row_no) AS max_row, max(layer) AS max_layer, max(length(style))::INT AS style_width, max(length(actor))::INT AS actor_width, max(length(effect))::INT AS effect_width FROM lines GROUP BY file_id")
over_lines("nth_pairs", lambda d: E.nth_pairs(d, "Default", "Sign"), "SELECT a.file_id, a.n, a.id AS source_id, a.text AS source_text, b.id AS target_id, b.text AS target_text FROM p a LEFT JOIN p b ON b.file_id = a.file_id AND b.n = a.n AND b.style = 'Sign' WHERE a.style = 'Default'", "p AS (SELECT *, (row_number() OVER (PARTITION BY file_id, style ORDER BY row_no))::INT AS n FROM lines WHERE NOT comment)")
over_lines("invert_comments", lambda d: E.invert_comments(d, F.col("layer") == 1).select("id", "comment"), "SELECT id, CASE WHEN layer = 1 THEN NOT comment ELSE comment END AS comment FROM lines")
over_lines("swap_lines", lambda d: E.swap(d, d.where("row_no = 0").select("file_id", "id", (F.col("id") + 1).alias("other_id"))).select("id", "row_no"), "SELECT id, (CASE WHEN n > 1 AND row_no < 2 THEN 1 - row_no ELSE row_no END)::INT AS row_no FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM lines)")
over_lines("split_syllable", lambda d: K.split_syllable(K.syllables(d.withColumn("text", F.concat(F.lit("{\\k20}a{\\k30}"), "text"))), d.select("file_id", "id", F.lit(1).alias("idx"), F.octet_length(F.substring("text", 1, 4)).alias("pos"))).select("id", "idx", "text", "duration_ms", "syl_start_ms"), "SELECT id, k AS idx, CASE k WHEN 0 THEN 'a' WHEN 1 THEN text[:4] ELSE text[5:] END AS text, CASE k WHEN 0 THEN 200 WHEN 1 THEN 300 - x ELSE x END AS duration_ms, start_ms + CASE k WHEN 0 THEN 0 WHEN 1 THEN 200 ELSE 500 - x END AS syl_start_ms FROM (SELECT *, CASE WHEN strlen(text[5:]) = 0 THEN 0 WHEN strlen(text[:4]) = 0 THEN 300 ELSE (300 * strlen(text[5:]) // strlen(text) + 5) // 10 * 10 END::INT AS x FROM lines) CROSS JOIN (VALUES (0), (1), (2)) AS c(k)")
over_lines("wrap_greedy", lambda d: d.select("id", B.wrap_points(F.transform(F.filter(F.split("text", " "), lambda x: x != ""), F.length), 30, "greedy").cast("array<string>").alias("b")).select("id", F.array_join("b", ",").alias("breaks")), "SELECT l.id, coalesce(string_agg((r.k - 1)::VARCHAR, ',' ORDER BY r.k) FILTER (r.fresh), '') AS breaks FROM lines l LEFT JOIN r USING (id) GROUP BY l.id", "t AS (SELECT id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM lines), r AS (WITH RECURSIVE g AS (SELECT id, ws, 1 AS k, length(ws[1]) AS line, false AS fresh FROM t WHERE len(ws) > 0 UNION ALL SELECT id, ws, k + 1, CASE WHEN line + length(ws[k + 1]) > 30 THEN length(ws[k + 1]) ELSE line + length(ws[k + 1]) END, line + length(ws[k + 1]) > 30 FROM g WHERE k < len(ws)) SELECT id, k, fresh FROM g)")
over_lines("smpte_back", lambda d: d.select("id", T.frame_of_smpte(T.smpte((F.col("id") * 37).cast("bigint"), 30, True), 30, True).alias("frame")), "SELECT id, (id * 37)::INT AS frame FROM lines")
over_lines("tag_table", lambda d: d.select("id", N.tags_of(F.concat(F.lit("{\\t(0,"), F.col("start_ms").cast("string"), F.lit(",\\fs20)\\clip(1,m 0 0)\\bordx}"), "text")).alias("t")).select("id", F.array_join(F.transform("t", lambda x: x["name"]), "|").alias("names"), F.array_join(F.transform("t", lambda x: x["text"]), "|").alias("texts")), r"SELECT id, 't|clip|bord' AS names, '\t(0,' || start_ms || ',\fs20)|\clip(1,m 0 0)|\bordx' AS texts FROM lines")


@query("SELECT vec_id, arg_max(b, (n, -b)) AS mode FROM (SELECT vec_id, b, count(*) AS n FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x: floor(floor((x::DOUBLE + 1) * 127)::INT * 32 / 256)::INT)) AS b FROM embeddings) GROUP BY ALL) GROUP BY vec_id")
def histogram_mode(spark, d):
    e = D.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127).cast("int")).alias("p"))
    return e.select("vec_id", V.histogram_mode("p").alias("mode"))


@query("SELECT scan_id AS track_id, segment, frame, value + coalesce(b, 0) AS value FROM s JOIN (SELECT scan_id, segment, sum(e) OVER (PARTITION BY scan_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT scan_id, segment, arg_max(value, frame) AS e FROM s GROUP BY ALL)) USING (scan_id, segment)", D.FRAMES, "s AS (SELECT scan_id, (frame // 5)::INT AS segment, frame, floor(value * 8) AS value FROM frames)")
def accumulated_offsets(spark, d):
    f = D.frames(spark, d).select(F.col("scan_id").alias("track_id"), F.floor(F.col("frame") / 5).cast("int").alias("segment"), "frame", F.floor(F.col("value") * 8).cast("double").alias("value"))
    return V.accumulated(f, ["value"])


@query("SELECT l.file_id, l.id, l.id || ',' || n AS extradata_ids FROM (SELECT *, (SELECT max(x.id) FROM lines x WHERE x.file_id = l.file_id) + 1 + layer AS n FROM lines l) l", D.LINES)
def extradata_set(spark, d):
    lines = D.lines(spark, d)
    files = lines.groupBy("file_id").agg(F.max("id").alias("m"))
    data = lines.select("file_id", "id", F.lit(0).alias("expiration"), F.lit("k").alias("key"), F.col("id").cast("string").alias("value"))
    data = data.unionByName(files.select("file_id", F.explode(F.array(*(F.struct((F.col("m") + 1 + k).alias("id"), F.lit(f"v{k}").alias("value")) for k in range(3)))).alias("x")).select("file_id", "x.id", F.lit(0).alias("expiration"), F.lit("new").alias("key"), "x.value"))
    values = lines.select("file_id", F.col("id").alias("line_id"), F.lit("new").alias("key"), F.concat(F.lit("v"), F.col("layer").cast("string")).alias("value"))
    return E.set_extradata(lines.withColumn("extradata_ids", F.array("id")), data, values)[0].select("file_id", "id", F.array_join(F.col("extradata_ids").cast("array<string>"), ",").alias("extradata_ids"))


over_lines("min_positive_gap", E.least_gap, "SELECT file_id, min(CASE WHEN g > 0 THEN g END) AS gap FROM (SELECT file_id, start_ms - lag(end_ms) OVER (PARTITION BY file_id ORDER BY row_no) AS g FROM lines) GROUP BY file_id")

# karaoke
over_lines("split_karaoke", lambda d: K.split_words(d).select("id", "idx", "text", "syl_start_ms", "duration_ms"), "SELECT id, (idx - 1)::INT AS idx, w AS text, start_ms + (e - s) * (u - strlen(w)) // t // 10 * 10 AS syl_start_ms, (e - s) * u // t // 10 * 10 - (e - s) * (u - strlen(w)) // t // 10 * 10 AS duration_ms FROM (SELECT id, idx, w, start_ms, start_ms::BIGINT AS s, end_ms::BIGINT AS e, sum(strlen(w)) OVER (PARTITION BY id ORDER BY idx)::BIGINT AS u, sum(strlen(w)) OVER (PARTITION BY id)::BIGINT AS t FROM (SELECT id, start_ms, end_ms, unnest(ws) AS w, generate_subscripts(ws, 1) AS idx FROM (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM lines)))")
over_lines("karaoke_round_trip", lambda d: K.render(K.syllables(d.withColumn("text", F.concat(F.lit("{\\k20}a{\\kf35\\b1}"), "text")))), "SELECT file_id, id, '{\\k20}a{\\kf35\\b1}' || text AS text FROM lines WHERE NOT contains(text, '{')")


@query("SELECT l.id, s.fontsize AS style_fontsize FROM lines l LEFT JOIN (SELECT file_id, lower(name) AS n, arg_min(fontsize, ord) AS fontsize FROM styles GROUP BY ALL) s ON s.file_id = l.file_id AND s.n = lower(l.style)", D.LINES, D.STYLES)
def style_lookup(spark, d):
    return L.with_style(D.lines(spark, d), D.styles(spark, d), ["fontsize"]).select("id", "style_fontsize")


@query("SELECT id, CASE WHEN EXISTS (SELECT 1 FROM styles s WHERE s.file_id = l.file_id AND lower(s.name) = lower(l.style)) THEN style ELSE 'Default' END AS style FROM lines l", D.LINES, D.STYLES)
def fix_styles(spark, d):
    return L.fix_styles(D.lines(spark, d), D.styles(spark, d)).select("id", "style")


@query("SELECT s.file_id, s.ord, s.name, s.fontsize FROM styles s WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.file_id = s.file_id AND l.style = s.name)", D.LINES, D.STYLES)
def unused_styles(spark, d):
    return L.unused(D.styles(spark, d), D.lines(spark, d), "style").select("file_id", "ord", "name", "fontsize")


@query("SELECT l.file_id, l.id, n.id AS data_id, 'k' || n.id % 2 AS key, 'v' || n.id AS value FROM lines l JOIN lines n ON n.file_id = l.file_id AND n.id IN (l.id, l.id + 1)", D.LINES)
def extradata_join(spark, d):
    lines = D.lines(spark, d)
    data = lines.select("file_id", "id", F.concat(F.lit("k"), (F.col("id") % 2).cast("string")).alias("key"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"))
    return L.with_extradata(lines.withColumn("extradata_ids", F.array("id", F.col("id") + 1)), data).select("file_id", "id", "data_id", "key", "value")


@query("SELECT id, CASE WHEN k.d <= 600 THEN k.key_ms ELSE start_ms END AS start_ms FROM lines l, LATERAL (SELECT key_ms, abs(key_ms - l.start_ms) AS d FROM keyframes f WHERE f.file_id = l.file_id ORDER BY d, key_ms LIMIT 1) k", D.LINES, D.KEYFRAMES)
def keyframe_snap(spark, d):
    return G.snap(D.lines(spark, d), D.keyframes(spark, d), "start_ms", 600, 600).select("id", "start_ms")


@query("SELECT l.id, (SELECT max(f.frame) FROM t f WHERE f.file_id = l.file_id AND f.ms <= l.start_ms) AS frame FROM lines l", D.LINES, D.KEYFRAMES, "t AS (SELECT file_id, key_ms AS ms, (key_ms // 2500)::INT AS frame FROM keyframes)")
def frame_at_time_vfr(spark, d):
    codes = D.keyframes(spark, d).select("file_id", F.col("key_ms").alias("ms"), F.floor(F.col("key_ms") / 2500).cast("int").alias("frame"))
    return G.frames_of(D.lines(spark, d), codes, "start_ms").select("id", "frame")


_STATE = "s AS (SELECT *, coalesce(last_value(CASE WHEN coverage < 0 THEN NULL WHEN NOT ocr_box OR coverage < 0.3 THEN false WHEN coverage >= 0.7 THEN true END IGNORE NULLS) OVER (PARTITION BY scan_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS present FROM frames)"
_RUNS = "r AS (SELECT *, frame - row_number() OVER (PARTITION BY scan_id, present ORDER BY frame) AS g FROM s)"


def _present(spark, d):
    return V.presence(D.frames(spark, d), 0.7, 0.3)


@query("SELECT scan_id, frame, present FROM s", D.FRAMES, _STATE)
def presence_hysteresis(spark, d):
    return _present(spark, d).select("scan_id", "frame", "present")


@query("SELECT scan_id, frame, present OR (n < 3 AND a > lo AND b < hi) AS present FROM (SELECT *, count(*) OVER (PARTITION BY scan_id, present, g) AS n, min(frame) OVER (PARTITION BY scan_id, present, g) AS a, max(frame) OVER (PARTITION BY scan_id, present, g) AS b, min(frame) OVER (PARTITION BY scan_id) AS lo, max(frame) OVER (PARTITION BY scan_id) AS hi FROM r)", D.FRAMES, _STATE, _RUNS)
def fill_short_dips(spark, d):
    return V.fill_dips(_present(spark, d), 3).select("scan_id", "frame", "present")


@query("SELECT scan_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS frames FROM r WHERE present GROUP BY scan_id, g", D.FRAMES, _STATE, _RUNS)
def run_bounds(spark, d):
    return V.runs(_present(spark, d))


@query("SELECT scan_id AS track_id, frame % 20 AS frame, max(frame) AS segment, arg_max(value, frame) AS value FROM frames GROUP BY ALL", D.FRAMES)
def stitched_last_writer(spark, d):
    f = D.frames(spark, d).select(F.col("scan_id").alias("track_id"), (F.col("frame") % 20).alias("frame"), F.col("frame").alias("segment"), "value")
    return V.last_writer(f)


_SPIKES = "s AS (SELECT scan_id AS track_id, frame * 2 + frame % 2 AS frame, value AS x, coverage * 10 AS y FROM frames)"


@query("SELECT track_id, frame, round(CASE WHEN hit THEN ex ELSE x END, 6) AS x, round(CASE WHEN hit THEN ey ELSE y END, 6) AS y FROM (SELECT *, coalesce((x - ex) ** 2 + (y - ey) ** 2 > 400 AND (x - xa) ** 2 + (y - ya) ** 2 > 400 AND (x - xb) ** 2 + (y - yb) ** 2 > 400, false) AS hit FROM (SELECT *, xa + (xb - xa) * t AS ex, ya + (yb - ya) * t AS ey FROM (SELECT a.*, (a.frame - p.frame) / (n.frame - p.frame)::DOUBLE AS t, p.x AS xa, p.y AS ya, n.x AS xb, n.y AS yb FROM o a LEFT JOIN o p ON p.track_id = a.track_id AND p.k = a.k - 1 LEFT JOIN o n ON n.track_id = a.track_id AND n.k = a.k + 1)))", D.FRAMES, _SPIKES, "o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS k FROM s)")
def spike_repair(spark, d):
    f = D.frames(spark, d).select(F.col("scan_id").alias("track_id"), (F.col("frame") * 2 + F.col("frame") % 2).alias("frame"), F.col("value").alias("x"), (F.col("coverage") * 10).alias("y"))
    return V.repair_spikes(f, ["x", "y"], 20).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query("SELECT scan_id AS track_id, (frame // 8)::BIGINT AS \"column\", min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM frames GROUP BY ALL", D.FRAMES)
def waveform_minmax(spark, d):
    f = D.frames(spark, d).select(F.col("scan_id").alias("track_id"), F.col("frame").alias("idx"), "value")
    return V.peaks(f, 8).withColumn("mean", F.round("mean", 6))


@query("SELECT a.vec_id, round(list_sum([abs(x::DOUBLE - y::DOUBLE) FOR x, y IN list_zip(a.embedding, b.embedding)]) / 64, 5) AS diff FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1".replace("[abs(x::DOUBLE - y::DOUBLE) FOR x, y IN list_zip(a.embedding, b.embedding)]", "list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))"))
def array_mean_abs_diff(spark, d):
    e = D.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    other = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("e").alias("p"))
    return e.join(other, "vec_id").select("vec_id", F.round(V.mean_abs_diff("p", "e"), 5).alias("diff"))


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\[Nn]|\n', ' ', 'g'), '\{[^{}]*\}', '', 'g'), '<[^<>]*>', '', 'g'), '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\x{2000}-\x{206F}\x{3000}-\x{303F}\x{FEFF}\x{FF00}-\x{FF0F}\x{FF1A}-\x{FF20}]', '', 'g'), '[ \t\r]+', ' ', 'g'))"


@query(f"SELECT q.item_id AS query_id, e.file, e.key, e.text FROM (SELECT item_id, {_NORM} AS n FROM benchmark) q JOIN (SELECT *, {_NORM} AS n FROM entries) e USING (n)", D.ENTRIES)
def match_exact(spark, d):
    q = D.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return M.exact(q, D.entries(spark, d))


@query("SELECT a.key, a.file, a.text, b.file AS other_file, b.text AS other_text FROM entries a JOIN entries b ON a.key = b.key AND a.file <> b.file", D.ENTRIES)
def match_key_cross_file(spark, d):
    return M.across_files(D.entries(spark, d))


@query()
def match_ranked(spark, d):
    q = D.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return M.match(q, D.entries(spark, d), 0.7)


@query("SELECT doc_id, CASE WHEN k = 0 THEN '日本語' WHEN k = 1 THEN '中文' WHEN k = 2 THEN '한국어' WHEN k = 3 THEN 'Русский' WHEN len(list_filter(string_split(text, ''), lambda c: c <> '' AND (unicode(c) BETWEEN 65 AND 90 OR unicode(c) BETWEEN 97 AND 122 OR unicode(c) BETWEEN 192 AND 591))) > 0 THEN 'English' ELSE '' END AS script FROM t", "t AS (SELECT doc_id, doc_id % 7 AS k, CASE doc_id % 7 WHEN 6 THEN regexp_replace(text, '[A-Za-zÀ-ɏ]', '7', 'g') ELSE text END AS text FROM documents)")
def detect_script(spark, d):
    sign = F.element_at(F.array(*map(F.lit, ("ﾀ", "㐁", "ᄀ", "ж", "", "Ø"))), (F.col("doc_id") % 7 + 1).cast("int"))
    docs = D.read(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 7 == 6, F.regexp_replace("text", "[A-Za-zÀ-ɏ]", "7")).otherwise(F.concat("text", F.when(F.col("doc_id") % 7 < 6, sign).otherwise(""))))
    return docs.select("doc_id", M.script_of("text").alias("script"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages")
def strip_html(spark, d):
    return D.read(spark, d, "pages").select("page_id", X.strip_html("html").alias("text"))


@query("SELECT style AS face, count(DISTINCT c) AS chars FROM (SELECT style, id, unnest(string_split(text, '')) AS c FROM lines) WHERE c <> '' GROUP BY style", D.LINES)
def font_usage(spark, d):
    d = D.lines(spark, d).withColumn("comment", F.lit(False))
    styles = d.select("file_id", F.col("style").alias("name"), F.col("style").alias("face"), F.lit(False).alias("bold"), F.lit(False).alias("italic")).distinct()
    return S.font_usage(d, styles).select("face", "chars")


# markup
over_lines("tag_parameters", lambda d: d.select("id", F.array_join(B.parameters(F.concat(F.lit("( 1,(a,b) , "), F.col("layer").cast("string"), F.lit(")rest"))), "|").alias("parts"), B.write_tag(F.lit("\\pos"), F.array(F.lit("1"), F.col("layer").cast("string"))).alias("tag")), r"SELECT id, '1|(a,b)|' || layer || '|rest' AS parts, '\pos(1,' || layer || ')' AS tag FROM lines")
over_lines("tag_values", lambda d: d.select("id", B.alpha_value(F.concat(F.lit("&H"), F.hex(F.col("row_no") * 40), F.lit("&"))).alias("alpha"), B.whole_value(F.concat(F.lit(" -"), F.col("row_no").cast("string"), F.lit("px"))).alias("whole"), B.number_text(F.col("start_ms") / 1000 + F.col("layer") / 8).alias("number")), "SELECT id, least(row_no * 40, 255)::INT AS alpha, -row_no AS whole, rtrim(rtrim(printf('%.3f', start_ms / 1000.0 + layer / 8.0), '0'), '.') AS number FROM lines")
over_lines("toggle_tag", lambda d: d.select("id", B.toggle_tag(F.concat(F.lit("{\\b1\\i1}"), "text"), "b").alias("off"), B.toggle_tag("text", "b").alias("on"), B.remove_tag(F.concat(F.lit("{\\bord2\\b1}"), "text"), "b").alias("without")), r"SELECT id, '{\i1\b0}' || text AS off, '{\b1}' || text AS on, '{\bord2}' || text AS without FROM lines")
over_lines("clean_tags", lambda d: d.select("id", B.clean_tags(F.concat(F.lit("{\\i1}{\\k20}{\\pos(1, 2)}"), "text", F.lit("{ }"))).alias("text")), r"SELECT id, '{\pos(1,2)\k20\i1}' || text AS text FROM lines")
over_lines("translate_blocks", lambda d: d.select("id", B.translate_blocks(F.concat(F.lit("ab{\\i1}"), "text"), F.create_map(F.lit(0), F.lit("x"))).alias("text")), r"SELECT id, 'x{\i1}' || text AS text FROM lines")
_SIGNS = "".join(map(chr, range(0x21, 0x7F)))
_WIDE = "".join({'"': "”", "'": "’", "`": "‘"}.get(x, chr(ord(x) + 0xFEE0)) for x in _SIGNS)
over_lines("fullwidth", lambda d: d.select("id", B.edge_blur(B.fullwidth("text")).alias("text")), r"SELECT id, '{\be1}' || translate(text, '" + _SIGNS.replace("'", "''") + "', '" + _WIDE + "') AS text FROM lines")
over_lines("wrap_lines", lambda d: d.select("id", B.wrap_points(F.transform(B.word_list("text"), F.length), 30).alias("breaks")), None)
over_lines("misspelled", lambda d: S.misspelled(d, d.where("layer = 0 and row_no < 3").select(F.explode(B.word_list("text")).alias("word")).select(F.lower("word").alias("word"))), "SELECT file_id, id, pos, word FROM w WHERE NOT comment AND (upper(word) <> word OR lower(word) = word) AND lower(word) NOT IN (SELECT lower(word) FROM w WHERE layer = 0 AND row_no < 3)", r"w AS (SELECT file_id, id, comment, layer, row_no, (p - 1)::INT AS pos, l[p] AS word FROM (SELECT *, generate_subscripts(l, 1) AS p FROM (SELECT *, regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+(?:[''’][\p{L}\p{M}]+)*') AS l FROM lines)))")

# styles and versions
_FACES = "s AS (SELECT DISTINCT file_id, style AS name, style AS face FROM lines)"
over_lines("font_usage_tags", lambda d: S.font_usage(d.withColumn("text", F.when(F.col("layer") == 1, F.concat(F.lit("ab{\\fnX\\b1}"), "text")).otherwise(F.col("text"))), d.select("file_id", F.col("style").alias("name"), F.col("style").alias("face"), F.lit(False).alias("bold"), F.lit(False).alias("italic")).distinct()), "SELECT face, bold, false AS italic, count(DISTINCT c) AS chars, count(DISTINCT CASE WHEN bold THEN id END) AS lines FROM (SELECT id, CASE WHEN layer = 1 THEN 'X' ELSE style END AS face, layer = 1 AS bold, unnest(string_split(text, '')) AS c FROM lines WHERE NOT comment UNION ALL SELECT id, style, false, unnest(['a', 'b']) FROM lines WHERE NOT comment AND layer = 1) WHERE c <> '' GROUP BY ALL")
over_lines("assign_style", lambda d: S.assign(d, d.where("layer = 1").select("file_id", "id", F.lit("New").alias("style"))).select("id", "style"), "SELECT id, CASE WHEN layer = 1 THEN 'New' ELSE style END AS style FROM lines")
over_lines("undo_version", lambda d: H.at_version(d.withColumns({"version": F.lit(1), "deleted": F.lit(False)}).unionByName(d.where("layer = 1").withColumns({"text": F.lit("x"), "version": F.lit(2), "deleted": F.col("row_no") % 2 == 0})).unionByName(d.withColumns({"version": F.lit(3), "deleted": F.lit(True)})), 2).select("id", "text"), "SELECT id, CASE WHEN layer = 1 THEN 'x' ELSE text END AS text FROM lines WHERE NOT (layer = 1 AND row_no % 2 = 0)")
over_lines("check_folds", lambda d: H.check_folds(d.select("file_id", "row_no", (F.col("row_no") % 3 == 2).alias("closing"), (F.col("row_no") % 2).cast("int").alias("fold_id"), F.lit(False).alias("collapsed"))), None)


@query("SELECT file_id, (CASE ord WHEN 0 THEN 2 ELSE ord - 1 END)::INT AS ord, name FROM styles", D.STYLES)
def move_styles_up(spark, d):
    return S.order_styles(D.styles(spark, d), 1, 2, "top").select("file_id", "ord", "name")


@query("SELECT file_id, ord, name FROM styles UNION ALL SELECT file_id, 3, 'TOP - Copy' FROM styles WHERE name = 'TOP'", D.STYLES)
def copy_style(spark, d):
    return S.copy_styles(D.styles(spark, d), F.col("name") == "TOP").select("file_id", "ord", "name")


@query("SELECT file_id, ord, name, CASE name WHEN 'TOP' THEN 99.0 ELSE fontsize END AS fontsize FROM styles", D.STYLES)
def import_styles(spark, d):
    s = D.styles(spark, d)
    return S.import_styles(s, s.where("name = 'TOP'").withColumn("fontsize", F.lit(99.0)))


# karaoke edits
over_lines("merge_syllables", lambda d: K.merge_with_previous(K.syllables(d.withColumn("text", F.lit("{\\k20}a{\\kf30}b{\\k10}c"))), 1).select("id", "idx", "tag", "text", "duration_ms", "syl_start_ms"), "SELECT id, i AS idx, 'k' AS tag, t AS text, u AS duration_ms, start_ms + a AS syl_start_ms FROM lines, (VALUES (0, 'ab', 500, 0), (1, 'c', 100, 500)) AS v(i, t, u, a)")
over_lines("set_syllable_ends", lambda d: K.set_boundaries(K.syllables(d.withColumn("text", F.lit("{\\k20}a{\\kf30}b{\\k10}c"))), F.when(F.col("idx") == 0, F.col("start_ms") + 300).when(F.col("idx") == 1, F.col("start_ms") + 100)).select("id", "idx", "syl_start_ms", "duration_ms"), "SELECT id, i AS idx, start_ms + a AS syl_start_ms, CASE i WHEN 0 THEN 300 WHEN 1 THEN 0 ELSE end_ms - start_ms - 300 END AS duration_ms FROM lines, (VALUES (0, 0), (1, 300), (2, 300)) AS v(i, a)")
over_lines("auto_lead_in", lambda d: K.auto_lead_in(d).select("id", "start_ms", "text"), r"SELECT id, CASE WHEN start_ms > p THEN p ELSE start_ms END AS start_ms, CASE WHEN start_ms > p THEN '{\k' || ((start_ms - p) // 10) || '}' || text ELSE text END AS text FROM (SELECT *, lag(end_ms) OVER (PARTITION BY file_id ORDER BY row_no) AS p FROM lines)")


# samples and signatures
_SAMPLES = "s AS (SELECT scan_id AS track_id, frame % 3 AS segment, frame, value FROM frames)"


@query("SELECT track_id, segment, frame, CASE WHEN frame % 5 = 0 THEN -1.0 ELSE value END AS value FROM s WHERE segment > 0 AND frame BETWEEN 2 AND 30", D.FRAMES, _SAMPLES)
def upsert_and_trim_samples(spark, d):
    s = D.frames(spark, d).select(F.col("scan_id").alias("track_id"), (F.col("frame") % 3).alias("segment"), "frame", "value")
    segments = s.select("track_id", "segment").distinct().withColumns({"first_frame": F.lit(2), "last_frame": F.lit(30), "enabled": F.col("segment") > 0})
    return V.owned(V.upsert_samples(s, s.where("frame % 5 = 0").withColumn("value", F.lit(-1.0))), segments)


@query()
def row_signatures(spark, d):
    e = D.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x + 1) * 127).cast("int")).alias("p"))
    return e.select("vec_id", V.row_signature("p", F.lit(8), F.lit(8), 4, 2).alias("signature"))


over_lines("resample_tags", lambda d: Z.resample_lines(d.withColumn("text", F.concat(F.lit("{\\pos(10,20)\\fs"), (F.col("layer") + 10).cast("string"), F.lit("\\fscx100}"), "text")), Z.scale((640, 480), (1280, 720))).select("id", "text"), r"SELECT id, '{\pos(20,30)\fs' || rtrim(rtrim(printf('%.3f', (layer + 10) * 1.5), '0'), '.') || '\fscx133.333}' || text AS text FROM lines")
over_lines("auto_split", lambda d: K.auto_split(K.syllables(d.withColumn("text", F.lit("{\\k50}ab cd e")))).select("id", "idx", "text", "duration_ms", "syl_start_ms"), "SELECT id, i AS idx, t AS text, u AS duration_ms, start_ms + a AS syl_start_ms FROM lines, (VALUES (0, 'ab ', 210, 0), (1, 'cd ', 220, 210), (2, 'e', 70, 430)) AS v(i, t, u, a)")


@query("SELECT scan_id, min(CASE WHEN coverage >= 0.4 AND ocr_box THEN frame END) AS frame FROM frames GROUP BY scan_id", D.FRAMES)
def snap_boundary(spark, d):
    return V.snap_boundary(D.frames(spark, d), 0.4)


@query("SELECT scan_id, frame, coalesce(a >= 0.4, false) OR coalesce(b >= 0.4, false) AS ambiguous FROM (SELECT *, lag(coverage) OVER w AS a, lag(coverage, 2) OVER w AS b FROM frames WINDOW w AS (PARTITION BY scan_id ORDER BY frame)) WHERE frame % 4 = 1", D.FRAMES)
def ambiguous_bounds(spark, d):
    f = D.frames(spark, d)
    return V.ambiguous(f, f.where("frame % 4 = 1").select("scan_id", "frame"), 0.4)


over_lines("delete_range", lambda d: L.delete_range(d, 1, 2).select("id", "row_no"), "SELECT id, (row_number() OVER (PARTITION BY file_id ORDER BY row_no) - 1)::INT AS row_no FROM lines WHERE row_no NOT BETWEEN 1 AND 2")
over_lines("insert_lines", lambda d: L.insert_lines(d, d.where("layer = 1").withColumn("id", -F.col("id")), 1).select("id", "row_no"), "SELECT id, (row_number() OVER (PARTITION BY file_id ORDER BY a, b, c) - 1)::INT AS row_no FROM (SELECT file_id, id, row_no AS a, 1 AS b, 0 AS c FROM lines UNION ALL SELECT file_id, -id, 1, 0, row_no FROM lines WHERE layer = 1)")
over_lines("hsv_round_trip", lambda d: d.select("id", X.rgb_to_hsv(F.col("row_no") * 20 % 256, F.col("layer") * 100, F.lit(7)).alias("x")).select("id", X.hsv_to_rgb(F.col("x.h"), F.col("x.s"), F.col("x.v")).alias("y")).select("id", "y.r", "y.g", "y.b"), "SELECT id, (row_no * 20 % 256)::INT AS r, layer * 100 AS g, 7 AS b FROM lines")


over_lines("ycbcr_round_trip", lambda d: d.select("id", X.rgb_to_ycbcr(F.col("row_no") * 20 % 256, F.col("layer") * 100, F.lit(7), "709").alias("x")).select("id", X.ycbcr_to_rgb(F.col("x.y"), F.col("x.cb"), F.col("x.cr"), "709").alias("y")).select("id", "y.r", "y.g", "y.b"), "SELECT id, (row_no * 20 % 256)::INT AS r, layer * 100 AS g, 7 AS b FROM lines")
over_lines("code_points", lambda d: d.select("id", F.array_join(X.code_points("text"), "|").alias("chars"), F.array_join(X.tokens("text"), "|").alias("parts")), "SELECT id, array_to_string(list_filter(string_split(text, ''), lambda x: x <> ''), '|') AS chars, array_to_string(list_transform(string_split(text, ','), lambda x: trim(x)), '|') AS parts FROM lines")


@query("SELECT class, count(*) AS n FROM (SELECT 'style' AS class FROM styles UNION ALL SELECT 'dialogue' FROM lines UNION ALL SELECT 'info' FROM (SELECT DISTINCT file_id FROM lines)) GROUP BY class", D.LINES, D.STYLES)
def script_classes(spark, d):
    lines = D.lines(spark, d)
    info = lines.select("file_id").distinct().select("file_id", F.lit("PlayResX").alias("key"), F.lit("640").alias("value"))
    return L.script_rows(info, D.styles(spark, d), lines).groupBy("class").agg(F.count("*").alias("n"))


# shapes, patterns, paths
def _drawing():
    return F.format_string("m %d 1 l %d 9 %d -2 b 1 2 3 4 %d %d", F.col("row_no"), F.col("row_no") * 2, F.col("layer"), F.col("layer") * 7, F.col("row_no") + 3)


over_lines("drawing_bounds", lambda d: d.select("id", SH.segments(_drawing()).alias("s")).select("id", F.size("s").alias("n"), SH.bounds("s").alias("b"), SH.encode("s").alias("drawing")).select("id", "n", "b.*", "drawing"), "SELECT id, 4 AS n, least(row_no, layer, layer * 7, 1)::DOUBLE AS left, -2.0::DOUBLE AS top, greatest(row_no * 2, layer * 7, 3)::DOUBLE AS right, greatest(9, row_no + 3)::DOUBLE AS bottom, format('m {} 1 l {} 9 {} -2 b 1 2 3 4 {} {}', row_no, row_no * 2, layer, layer * 7, row_no + 3) AS drawing FROM lines")
over_lines("curve_points", lambda d: d.select("id", SH.point(F.array(*(F.col(c).cast("double") for c in ("layer", "row_no", "start_ms", "end_ms", "row_no", "layer", "end_ms", "start_ms"))), F.col("row_no") % 5 / 4).alias("q")).select("id", F.round("q.x", 6).alias("x"), F.round("q.y", 6).alias("y")), "SELECT id, round(layer * u ** 3 + start_ms * 3 * t * u ** 2 + row_no * 3 * t ** 2 * u + end_ms * t ** 3, 6) AS x, round(row_no * u ** 3 + end_ms * 3 * t * u ** 2 + layer * 3 * t ** 2 * u + start_ms * t ** 3, 6) AS y FROM (SELECT *, (row_no % 5) / 4.0::DOUBLE AS t, 1 - (row_no % 5) / 4.0::DOUBLE AS u FROM lines)")
over_lines("nearest_on_line", lambda d: d.select("id", SH.nearest(F.array(F.lit(0.0), F.lit(0.0), F.lit(20.0), F.lit(10.0)), F.col("row_no").cast("double"), F.col("layer") * 4.0).alias("t")).withColumn("t", F.round("t", 9)), "SELECT id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (row_no * 20 + layer * 40) / 500.0::DOUBLE)), 9) AS t FROM lines")
over_lines("perspective_points", lambda d: d.select("id", SH.perspective((F.col("row_no") % 4) / 3, F.col("layer") / 2, [F.lit(v) for v in (0.0, 0.0, 10.0, 0.0, 8.0, 6.0, 2.0, 6.0)]).alias("q")).select("id", F.round("q.x", 6).alias("x"), F.round("q.y", 6).alias("y")), "SELECT id, round((10 * u + 10 / 3.0 * v) / (2 / 3.0 * v + 1), 6) AS x, round(10 * v / (2 / 3.0 * v + 1), 6) AS y FROM (SELECT id, (row_no % 4) / 3.0::DOUBLE AS u, layer / 2.0::DOUBLE AS v FROM lines)")
over_lines("clip_bounds", lambda d: d.select("id", SH.clip_value(F.concat(F.lit("{\\"), F.when(F.col("layer") == 1, "i").otherwise(""), F.lit("clip("), F.concat_ws(", ", F.col("row_no"), F.lit("-2.5"), F.col("layer"), F.lit("4")), F.lit(")}"), "text")).alias("c")).select("id", "c.*"), "SELECT id, layer = 1 AS inverse, row_no::DOUBLE AS x1, -2.5::DOUBLE AS y1, layer::DOUBLE AS x2, 4.0::DOUBLE AS y2 FROM lines")
over_lines("placed_gradients", lambda d: d.select("id", SH.placed_gradient(F.format_string("(%d, 5,%d,1,90, a(1,2),b)", "row_no", "layer")).alias("g")).select("id", "g.*"), "SELECT id, least(row_no, layer)::DOUBLE AS left, 1.0::DOUBLE AS top, greatest(row_no, layer)::DOUBLE AS right, 5.0::DOUBLE AS bottom, '(90,a(1,2),b)' AS rest FROM lines")
over_lines("font_name_at", lambda d: d.select("id", B.font_name_at(F.concat(F.lit("{\\b1\\fnA "), "style", F.lit("}"), "text"), F.col("row_no") * 2).alias("f")).select("id", F.col("f.start").alias("from"), F.col("f.end").alias("to")), "SELECT id, CASE WHEN row_no * 2 BETWEEN 7 AND 8 + length(style) THEN 7 END AS \"from\", CASE WHEN row_no * 2 BETWEEN 7 AND 8 + length(style) THEN 9 + length(style) END AS \"to\" FROM lines")
over_lines("pattern_places", lambda d: d.select("id", F.explode(R.found("text", R.compiled("AN", "ICASE"))).alias("m")).select("id", "m.str", "m.first", "m.last"), "SELECT id, substr(text, f::BIGINT, 2) AS str, f::INT AS first, (f + 1)::INT AS last FROM (SELECT id, text, unnest(list_transform(range(1, len(p)), lambda k: 1 + 2 * (k - 1) + list_sum(list_transform(p[1:k], lambda x: length(x))))) AS f FROM (SELECT id, text, string_split(lower(text), 'an') AS p FROM lines))")
over_lines("pattern_edits", lambda d: d.select("id", R.substitute("text", "an", "<>", 1).alias("one"), R.substituted("text", "[ae]", F.upper).alias("all"), F.size(R.split("text", " +", skip_empty=True)).alias("parts")), "SELECT id, regexp_replace(text, 'an', '<>') AS one, translate(text, 'ae', 'AE') AS \"all\", len(list_filter(string_split_regex(text, ' +'), lambda x: x <> ''))::INT AS parts FROM lines")
over_lines("path_folders", lambda d: d.select("id", P.decode(F.concat(F.when(F.col("layer") == 0, "?video").when(F.col("layer") == 1, "?script/").otherwise("/x/"), F.col("id").cast("string")), {"?video": "/v/a", "?script": "/s/"}).alias("path")), "SELECT id, CASE layer WHEN 0 THEN '/v/a/' WHEN 1 THEN '/s/' ELSE '/x/' END || id AS path FROM lines")
over_lines("html_overrides", lambda d: d.select("id", HT.to_overrides(F.concat(F.lit("<i><I>"), "text", F.lit("</i></i><font size="), F.col("row_no").cast("string"), F.lit(">x</font></b>"))).alias("text")), r"SELECT id, '{\i1}' || text || '{\i\fs' || row_no || '}x{\fs}' AS text FROM lines")

# timed-text samples, karaoke cuts and templates, evidence
over_lines("ttxt_samples", TX.samples, "SELECT file_id, row_no, 1 AS part, start_ms, text FROM lines UNION ALL SELECT file_id, row_no, 0, b, '' FROM (SELECT *, lag(end_ms) OVER (PARTITION BY file_id ORDER BY row_no) AS b FROM lines) WHERE b <> start_ms UNION ALL SELECT file_id, max(row_no), 2, arg_max(end_ms, row_no), '' FROM lines GROUP BY file_id")
_UNITS = r"u AS (SELECT file_id, id, start_ms, end_ms, list_transform(string_split_regex(trim(text), '\s+'), lambda x: x) || ['', 'x', '#'] AS u FROM lines)"
over_lines("even_words", lambda d: KN.evenly(d, KN.word_units(F.concat(F.regexp_replace(F.trim("text"), r"[\s|#]+", " "), F.lit(" ||x#|")))).select("id", "idx", "text", "syl_start_ms", "duration_ms"), "SELECT id, (k - 1)::INT AS idx, u[k] AS text, a::INT AS syl_start_ms, (b - a)::INT AS duration_ms FROM (SELECT *, CASE WHEN k = 1 THEN start_ms ELSE least(end_ms, (start_ms + (end_ms - start_ms) * (k - 1) // len(u) + 5) // 10 * 10) END AS a, CASE WHEN k = len(u) THEN end_ms ELSE least(end_ms, (start_ms + (end_ms - start_ms) * k // len(u) + 5) // 10 * 10) END AS b FROM (SELECT *, unnest(range(1, len(u) + 1)) AS k FROM u))", _UNITS)


def _templated(d: DataFrame) -> DataFrame:
    sung = d.withColumn("text", F.concat(F.lit("{\\k20}a{\\k"), F.col("row_no").cast("string"), F.lit("}bc")))
    own = d.groupBy("file_id").agg(F.min("row_no").alias("row_no")).withColumns({"id": -F.col("row_no") - 1, "comment": F.lit(True), "layer": F.lit(4), "start_ms": F.lit(0), "end_ms": F.lit(0), "style": F.lit("Sign"), "actor": F.lit(""), "effect": F.lit("template syl loop 2"), "text": F.lit("!retime('syl', j)!$si:$dur ")})
    return TP.apply(sung, K.syllables(sung), TP.read(own)).select("id", "n", "start_ms", "end_ms", "layer", "text")


over_lines("template_effects", _templated, "SELECT id, (2 * i + j - 1)::INT AS n, (start_ms + a + j)::INT AS start_ms, (start_ms + a + ms)::INT AS end_ms, 4 AS layer, (i + 1) || ':' || ms || ' ' || t AS text FROM (SELECT id, start_ms, i, j, CASE i WHEN 0 THEN 0 ELSE 200 END AS a, CASE i WHEN 0 THEN 200 ELSE row_no * 10 END AS ms, CASE i WHEN 0 THEN 'a' ELSE 'bc' END AS t FROM lines, (VALUES (0), (1)) AS s(i), (VALUES (1), (2)) AS r(j) WHERE style = 'Sign' AND NOT comment AND effect = '')")


@query("SELECT scan_id, coalesce((SELECT max(CASE WHEN p.ok THEN f.frame + 1 ELSE f.frame + 2 END) FROM e f JOIN e p ON p.scan_id = f.scan_id AND p.frame = f.frame + 1 WHERE f.scan_id = a.scan_id AND NOT f.ok AND f.frame < 9 AND f.frame % 2 = 1 AND NOT EXISTS (SELECT 1 FROM e g WHERE g.scan_id = f.scan_id AND NOT g.ok AND g.frame % 2 = 1 AND g.frame > f.frame AND g.frame < 9)), 1)::INT AS first_frame, coalesce((SELECT min(CASE WHEN p.ok THEN f.frame - 1 ELSE f.frame - 2 END) FROM e f JOIN e p ON p.scan_id = f.scan_id AND p.frame = f.frame - 1 WHERE f.scan_id = a.scan_id AND NOT f.ok AND f.frame > 9 AND f.frame % 2 = 1 AND NOT EXISTS (SELECT 1 FROM e g WHERE g.scan_id = f.scan_id AND NOT g.ok AND g.frame % 2 = 1 AND g.frame < f.frame AND g.frame > 9)), (SELECT max(frame) FROM e WHERE e.scan_id = a.scan_id))::INT AS last_frame FROM e a WHERE frame = 9 AND found", D.FRAMES, "t AS (SELECT scan_id, frame, ocr_box AS found, CASE WHEN coverage < 0.2 THEN 9 ELSE 0 END AS d FROM frames)", "e AS (SELECT t.scan_id, t.frame, t.found, t.found AND abs(t.d - x.d) <= 5 AS ok FROM t JOIN t x ON x.scan_id = t.scan_id AND x.frame = 9 AND x.found)")
def align_to_point(spark, d):
    f = D.frames(spark, d).select("scan_id", "frame", F.col("ocr_box").alias("found"), *(F.lit(3).alias(c) for c in ("left", "right", "up")), F.when(F.col("coverage") < 0.2, 9).otherwise(0).alias("down"))
    return V.align_to_point(f, f.select("scan_id").distinct().withColumn("anchor", F.lit(9)))


@query("SELECT a.w AS word, b.w AS suggestion, levenshtein(a.w, b.w)::INT AS distance FROM w a JOIN w b ON abs(length(a.w) - length(b.w)) <= 1 WHERE levenshtein(a.w, b.w) <= 1", r"w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[a-z]+'))) AS w FROM benchmark)")
def near_words(spark, d):
    w = D.read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), 0)).alias("word")).distinct()
    return S.suggestions(w, w)


_MOTION_SQL = "SELECT scan_id AS track_id, 'Adobe After Effects 6.0 Keyframe Data' || n || n || t || 'Units Per Second' || t || '25.000' || n || t || 'Source Width' || t || '640' || n || t || 'Source Height' || t || '480' || n || t || 'Source Pixel Aspect Ratio' || t || '1' || n || t || 'Comp Pixel Aspect Ratio' || t || '1' || n || n || 'Anchor Point' || n || h || string_agg(t || (frame - 1) || t || '0.000' || t || '1.000' || t || '0' || n, '' ORDER BY frame) || n || 'Position' || n || h || string_agg(t || (frame - 1) || t || frame || '.000' || t || '2.500' || t || '0' || n, '' ORDER BY frame) || n || 'Scale' || n || replace(h, 'pixels', 'percent') || string_agg(t || (frame - 1) || t || '100.000' || t || (frame * 100) || '.000' || t || '100' || n, '' ORDER BY frame) || n || 'Rotation' || n || t || 'Frame' || t || 'Degrees' || n || string_agg(t || (frame - 1) || t || '-' || frame || '.000' || n, '' ORDER BY frame) || n || 'End of Keyframe Data' || n AS content FROM frames, (SELECT chr(9) AS t, chr(13) || chr(10) AS n, chr(9) || 'Frame' || chr(9) || 'X pixels' || chr(9) || 'Y pixels' || chr(9) || 'Z pixels' || chr(13) || chr(10) AS h) GROUP BY scan_id, t, n, h"


@query(_MOTION_SQL, D.FRAMES)
def motion_keyframes(spark, d):
    f = D.frames(spark, d).select(F.col("scan_id").alias("track_id"), "frame")
    at = {"anchor_x": F.lit(0), "anchor_y": F.lit(1), "x": F.col("frame"), "y": F.lit(2.5), "scale_x": F.lit(1), "scale_y": F.col("frame"), "rotation": -F.col("frame")}
    tracks = f.select("track_id").distinct().withColumns({"fps": F.lit(25), "width": F.lit(640), "height": F.lit(480)})
    return WR.motion_keyframes(f.withColumns(at), tracks)
