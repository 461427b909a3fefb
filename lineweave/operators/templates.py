"""Karaoke templates: comment lines whose effect says `template ...` make effect lines of each line or syllable of their style."""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.functions.text import strip_tags

#: Words that say what a template is, which can't name a line template
WORDS = ("pre-line", "line", "syl", "furi", "char", "all", "repeat", "loop", "notext", "keeptags", "noblank", "multi", "fx", "fxgroup")
TEMPLATE = "struct<kind:string,name:string,pre:boolean,all:boolean,loops:int,notext:boolean,keeptags:boolean,noblank:boolean,char:boolean>"
EFFECT_LINE = "array<struct<n:int,start_ms:int,end_ms:int,layer:int,style:string,text:string>>"


def described(effect: str) -> dict | None:
    """What an effect's words say; null if the first isn't `template`. A template that names no kind is one of syllables; a count that
    is no number is 1; furi, multi, fx and fxgroup need a layout and give null too."""
    first, *words = effect.split() or [""]
    if first.lower() != "template":
        return None
    out = {"kind": None, "name": None, "pre": False, "all": False, "loops": 1, "notext": False, "keeptags": False, "noblank": False, "char": False}
    while words:
        w = words.pop(0).lower()
        if w in ("line", "pre-line") and out["kind"] is None:
            out["kind"], out["pre"] = "line", w == "pre-line"
            if words and words[0].lower() not in WORDS:
                out["name"] = words.pop(0).lower()
        elif w == "syl" and out["kind"] is None:
            out["kind"] = "syl"
        elif w in ("repeat", "loop") and words:
            if re.fullmatch(r"\d+", words[0]):
                out["loops"] = int(words.pop(0))
        elif w in ("all", "notext", "keeptags", "noblank", "char"):
            out[w] = True
        elif w in ("furi", "multi", "fx", "fxgroup"):
            return None
    return out | {"kind": out["kind"] or "syl"}


def read(lines: DataFrame) -> DataFrame:
    """(file_id, row_no, style, layer, kind, loops, notext, keeptags, noblank, char, body, pre): the templates of files; line templates of one name
    are one, with the first's settings, their texts joined in order. style is null where it holds for all."""

    @F.pandas_udf(TEMPLATE.replace("struct<", "array<struct<") + ">")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda e: [d] if e is not None and (d := described(e)) else None)

    rows = lines.where(F.col("comment") & F.lower("effect").startswith("template")).withColumn("d", F.get(run("effect"), F.lit(0))).where("d is not null")
    group = F.when(F.col("d.name").isNotNull(), F.concat(F.lit("name "), "d.name")).otherwise(F.concat(F.lit("row "), F.col("row_no").cast("string")))
    part = lambda pre: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("d.pre") == pre, F.struct("row_no", "text")))), lambda x: x["text"]), "")
    style = F.when(~F.col("d.all"), F.col("style"))
    first = F.min_by(F.struct(style.alias("style"), "layer", "d.kind", "d.loops", "d.notext", "d.keeptags", "d.noblank", "d.char"), "row_no")
    out = rows.groupBy("file_id", group.alias("_g")).agg(F.min("row_no").alias("row_no"), first.alias("f"), part(False).alias("body"), part(True).alias("pre"))
    return out.select("file_id", "row_no", "f.*", "body", "pre")


# ---------------------------------------------------------------- expressions

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}


def shown(x: object) -> str:
    """Numbers with fourteen digits at most, whole ones without a point."""
    if isinstance(x, bool) or x is None:
        return {True: "true", False: "false", None: "nil"}[x]
    return f"{x:.14g}" if isinstance(x, (int, float)) else str(x)


def evaluate(text: str, names: Mapping[str, object]) -> object:
    """Numbers, texts, names, members of tables, calls, arithmetic with ^ as the power and .. joining texts, comparisons, and, or,
    not. ValueError for anything else."""
    code = re.sub(r"\.\.", "@", re.sub(r"~=", "!=", text).replace("^", "**"))

    def value(n: ast.AST) -> object:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float, str)):
            return n.value
        if isinstance(n, ast.Name):
            if n.id not in names:
                raise ValueError(f"unknown name {n.id}")
            return names[n.id]
        if isinstance(n, ast.Attribute):
            table = value(n.value)
            if not isinstance(table, Mapping) or n.attr not in table:
                raise ValueError(f"no member {n.attr}")
            return table[n.attr]
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.MatMult):
            return shown(value(n.left)) + shown(value(n.right))
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            return _BINARY[type(n.op)](value(n.left), value(n.right))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.Not)):
            return -value(n.operand) if isinstance(n.op, ast.USub) else not value(n.operand)
        if isinstance(n, ast.BoolOp):
            last: object = None
            for x in n.values:
                last = value(x)
                if bool(last) != isinstance(n.op, ast.And):
                    break
            return last
        if isinstance(n, ast.Compare) and len(n.ops) == 1 and type(n.ops[0]) in _COMPARE:
            return _COMPARE[type(n.ops[0])](value(n.left), value(n.comparators[0]))
        if isinstance(n, ast.Call) and not n.keywords:
            f = value(n.func)
            if not callable(f):
                raise ValueError("not a function")
            return f(*map(value, n.args))
        raise ValueError(f"not understood: {text}")

    try:
        return value(ast.parse(code.strip(), mode="eval").body)
    except (SyntaxError, TypeError, ZeroDivisionError) as e:
        raise ValueError(f"{text}: {e}") from e


#: New times by mode from a line's and its syllable's, before what is added to them
RETIME: dict[str, Callable[[dict, dict], tuple[float, float]]] = {
    "line": lambda k, s: (k["start"], k["end"]),
    "preline": lambda k, s: (k["start"], k["start"]),
    "postline": lambda k, s: (k["end"], k["end"]),
    "syl": lambda k, s: (k["start"] + s["start_time"], k["start"] + s["end_time"]),
    "presyl": lambda k, s: (k["start"] + s["start_time"], k["start"] + s["start_time"]),
    "postsyl": lambda k, s: (k["start"] + s["end_time"], k["start"] + s["end_time"]),
    "start2syl": lambda k, s: (k["start"], k["start"] + s["start_time"]),
    "syl2end": lambda k, s: (k["start"] + s["end_time"], k["end"]),
    "set": lambda k, s: (0, 0),
    "abs": lambda k, s: (0, 0),
}


def _effects(line: dict, syllables: list[dict], t: dict, extra: Mapping[str, object]) -> list[dict]:
    """The effect lines that one template makes of one line."""
    a, b = line["start_ms"], line["end_ms"]
    own = {"layer": line["layer"], "lstart": a, "lend": b, "ldur": b - a, "lmid": a + (b - a) / 2, "style": line["style"], "actor": line["actor"], "syln": len(syllables), "li": line["row_no"] + 1}
    whole = {"start": a, "end": b, "dur": b - a, "kdur": (b - a) // 10, "mid": a + (b - a) / 2, "i": line["row_no"] + 1}
    sung = []
    for i, s in enumerate(syllables, start=1):
        at, d = s["start"] - a, s["ms"]
        v = {"sstart": at, "send": at + d, "sdur": d, "skdur": d / 10, "smid": at + d / 2, "si": i}
        v |= {k[1:]: x for k, x in v.items()}
        sung.append((s, v, {"start_time": at, "end_time": at + d, "duration": d, "i": i, "text": s["text"], "tag": s["tag"]}))
    out: list[dict] = []

    def text(source: str, values: dict, syl: dict | None, new: dict, loop: dict) -> str:
        def retime(mode: str, start: float = 0, end: float = 0) -> str:
            k = {"start": new["start_ms"], "end": new["end_ms"]}
            if mode == "sylpct":
                base = k["start"] + syl["start_time"]
                p, q = base + start * syl["duration"] / 100, base + end * syl["duration"] / 100
            else:
                p, q = RETIME[mode](k, syl or {}) if mode in RETIME else (k["start"] - start, k["end"] - end)
                p, q = p + start, q + end
            new["start_ms"], new["end_ms"] = int(p), int(q)
            return ""

        def put(key: str, of: dict) -> Callable:
            return lambda x: of.__setitem__(key, x) or ""

        tables = {"line": {"start_time": new["start_ms"], "end_time": new["end_ms"], "layer": new["layer"], "style": new["style"], "actor": line["actor"]}, "syl": syl or {}}
        names = {"retime": retime, "relayer": put("layer", new), "restyle": put("style", new), "maxloop": put("maxj", loop), "maxloops": put("maxj", loop), **tables, **loop, "true": True, "false": False, "nil": None, **extra}
        filled = re.sub(r"\$([A-Za-z_]+)", lambda m: shown(values[m[1].lower()]) if m[1].lower() in values else "$" + m[1].lower(), source)
        return re.sub(r"!(.*?)!", lambda m: shown(evaluate(m[1], names)), filled)

    def each(make: Callable[[dict, dict], str]) -> None:
        loop = {"j": 0, "maxj": t["loops"]}
        while loop["j"] < loop["maxj"]:
            loop["j"] += 1
            new = {"n": len(out), "start_ms": a, "end_ms": b, "layer": t["layer"], "style": line["style"]}
            new["text"] = make(new, loop)
            new["layer"] = int(new["layer"])
            out.append(new)

    if t["kind"] == "line":

        def of_line(new: dict, loop: dict) -> str:
            done = text(t["pre"], own | whole, None, new, loop) if t["pre"] else ""
            if not t["body"]:
                return done + (line["text"] if t["keeptags"] else line["stripped"])
            for s, v, syl in sung:
                done += text(t["body"], own | whole | v, syl, new, loop) + ("" if t["notext"] else s["tagged"] if t["keeptags"] else s["text"])
            return done

        each(of_line)
        return out
    for s, v, syl in sung:
        if t["noblank"] and (s["ms"] <= 0 or not s["text"].strip(" \t\n\r　")):
            continue
        for shown_text in s["text"] if t["char"] else [s["text"]]:
            tail = s["tagged"] if t["keeptags"] and not t["char"] else "" if t["notext"] and not t["keeptags"] else shown_text
            each(lambda new, loop, tail=tail, v=v, syl=syl: text(t["body"], own | whole | v, syl, new, loop) + tail)
    return out


def apply(lines: DataFrame, syllables: DataFrame, templates: DataFrame, functions: Mapping[str, object] | None = None) -> DataFrame:
    """(file_id, id, template, n, start_ms, end_ms, layer, style, text): the effect lines of all lines that are no comment and have no effect, or
    whose effect is karaoke. `$name` gives times (of the syllable from the line's start), numbers and names, `!...!` an expression,
    in which functions gives further names. A template that can't be evaluated is an error. Syllables without time at a line's start
    are rows like any other. Lines of one template don't see each other's."""
    extra = dict(functions or {})
    karaoke = F.lower("effect").contains("karaoke")
    kept = lines.where(karaoke | (~F.col("comment") & (F.col("effect") == "")))
    tagged = F.concat(F.when(F.col("tags") != "", F.concat(F.lit("{"), "tags", F.lit("}"))).otherwise(""), "text")
    row = F.struct("idx", F.col("syl_start_ms").alias("start"), F.col("duration_ms").alias("ms"), "tag", "text", tagged.alias("tagged"))
    sung = syllables.groupBy("file_id", "id").agg(F.sort_array(F.collect_list(row)).alias("_s"))
    names = ["row_no", "start_ms", "end_ms", "layer", "style", "actor", "text"]
    rows = kept.select("file_id", "id", F.struct(*names, strip_tags("text").alias("stripped")).alias("_l")).join(sung, ["file_id", "id"])
    t = templates.select("file_id", F.col("row_no").alias("template"), F.col("style").alias("_style"), F.struct("kind", "loops", "layer", "notext", "keeptags", "noblank", "char", "body", "pre").alias("_t"))
    rows = rows.join(t, "file_id").where(F.col("_style").isNull() | (F.col("_style") == F.col("_l.style")))

    @F.pandas_udf(EFFECT_LINE)
    def run(k: pd.DataFrame, s: pd.Series, d: pd.DataFrame) -> pd.Series:
        return pd.Series([_effects(x, list(y), z, extra) for x, y, z in zip(k.to_dict("records"), s, d.to_dict("records"))])

    return rows.select("file_id", "id", "template", F.explode(run("_l", "_s", "_t")).alias("e")).select("file_id", "id", "template", "e.*")


def marked(lines: DataFrame, effects: DataFrame) -> DataFrame:
    """Lines that became effects turn to comments with the effect karaoke."""
    done = effects.select("file_id", "id").distinct().withColumn("_done", F.lit(True))
    rows = lines.join(done, ["file_id", "id"], "left")
    hit = F.coalesce("_done", F.lit(False))
    return rows.withColumns({"comment": F.col("comment") | hit, "effect": F.when(hit, "karaoke").otherwise(F.col("effect"))}).drop("_done")
