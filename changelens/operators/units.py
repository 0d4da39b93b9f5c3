"""Segmentation of source files into function units, without a grammar.

Everything happens inside the file's row: strings and comments are blanked
(``masking``) and the rest is cut into steps by native regular expressions; a
small walk over the steps' numbers with a stack of open blocks, linear in a
file's size, gives every function's start and end offset (Pandas UDF; Spark's
``aggregate`` took quadratic time on long files); the text is cut from the
content with ``substring``.  One scan, no exchange, nothing collected.

Rules (approximations of the reference's syntax-tree walk):

* Python, a step is a line: ``def`` / ``async def`` at any depth.  A block ends
  at its last non-blank line before the next logical line with indent <= the
  header's; lines inside brackets, strings or after a backslash go on.
* JS / TS, a step is a header, a bracket, a separator or what lies between:
  ``function`` declarations, methods and arrow functions (named after the
  variable they are assigned to, else ``<anonymous>``), several on a line too.
  A body in braces, on the header's line or the next, ends at its closing
  brace; another arrow body ends before the ``,``, ``;``, closing bracket or
  line end that follows it at its own depth, and a line that cannot end there
  goes on.
* Function expressions and generator functions are none of the reference's
  kinds and give no unit.
* Nested functions give a unit each.  Unit text starts at the header
  keyword (decorators and ``export`` excluded), later lines keep their
  indentation.

Comment-only lines count as blank.  Known deviations: functions inside a
parameter list or a template literal are not seen; parameter lists nest three
brackets deep at most; a TypeScript function type counts as an arrow function
where it does not follow ``type X =``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import with_computed_once
from .languages import path_extension, scan_group
from .masking import blanked

PY_DEF = r"^([ \t]*)(?:async[ \t]+)?def[ \t]+([A-Za-z_]\w*)"

_ID = r"[A-Za-z_$][\w$]*+"
# Parentheses with two levels inside, and a generic parameter list.
_ARGS = r"\([^()]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^()]*+)*+\)"
_GENERIC = r"(?:<[^<>(){};]*+(?:<[^<>(){};]*+>[^<>(){};]*+)*+>)?+"
_RETURNS = r"(?:\s*+:\s*+(?:\{[^{}]*+\}|[^;{}()=,]++)(?:\[\s*+\])*+)?"
_AT_STATEMENT = r"(?<=(?:\A|[;{}\n]|\bexport|\bdefault)[ \t\r]{0,100})"
_AT_MEMBER = r"(?<=[;{},\n][ \t\r]{0,100}\*?[ \t]{0,10})"
JS_FUNCTION = rf"{_AT_STATEMENT}(?:async\s++)?function\s++{_ID}\s*+{_GENERIC}\s*+{_ARGS}{_RETURNS}\s*+\{{"
_ASSIGNED = rf"(?:const|let|var)\s++{_ID}(?:\s*+:[^=;\n]*+(?:=>[^=;\n]*+)*+)?\s*+=\s*+"
JS_ARROW = rf"(?:{_ASSIGNED})?(?:async\b\s*+)?(?:{_GENERIC}{_ARGS}{_RETURNS}|{_ID})\s*+=>\s*+\{{?"
_NO_METHOD = r"(?!(?:if|for|while|switch|catch|function|return|with|else|do|try|new|typeof|await)\b)"
_MODIFIERS = r"(?:(?:static|async|get|set|public|private|protected|readonly|override)\s++)*+(?:\*\s*+)?"
JS_METHOD = (rf"{_MODIFIERS}{_NO_METHOD}#?{_ID}\??\s*+{_GENERIC}\s*+{_ARGS}{_RETURNS}\s*+\{{")
_HEADER = rf"{JS_FUNCTION}|{JS_ARROW}|{_AT_MEMBER}{JS_METHOD}"
# A line end that can end an expression: nothing before or after it asks for more.
_LINE_END = r"(?<![-+*/%&|=?:<>.][ \t\r]{0,100})\n(?!\s*+[.?:&|+*/%=<>-])"
JS_TOKEN = (rf"{_HEADER}|[(){{}}\[\];,]|{_LINE_END}|type\s++{_ID}\s*+{_GENERIC}\s*+=[^;\n]*+"
            rf"|(?:(?!{_HEADER}|{_LINE_END})(?:{_ID}|\n|[^A-Za-z_$(){{}}\[\];,\n]++)){{1,100}}+")
_STEPS = ("n", "visible", "lines", "delta", "kind", "name", "col", "col_lines")
_HEAD, _END, _BRACE = 1, 2, 3      # kinds of JS steps: header, end of an expression, closing brace
_UNITS = T.StructType([T.StructField("name", T.ArrayType(T.StringType()))]
                      + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("start", "line", "end")])


def _count(s: Column, char: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(char), F.lit("")))


def _step(**fields) -> Column:
    """One step: its length, that up to its last visible character, its line
    ends, change of bracket depth, kind, function name, and where in it the
    function starts (characters and lines)."""
    return F.struct(*[(fields[k] if k == "name" else fields[k].cast("int")).alias(k) for k in _STEPS])


def _py_steps(text: Column) -> Column:
    """A step per line; ``col`` is its indent, ``kind`` whether a backslash joins the next one."""
    def line(x):
        bare = F.rtrim(F.translate(x, "\t\r\f", "   "))
        return _step(
            n=F.length(x) + 1, visible=F.length(bare), lines=F.lit(1),
            delta=F.length(F.translate(x, ")]}", "")) - F.length(F.translate(x, "([{", "")),
            kind=bare.endswith("\\"), name=F.regexp_extract(x, PY_DEF, 2),
            col=F.length(bare) - F.length(F.ltrim(bare)), col_lines=F.lit(0))

    return F.transform(F.split(text, "\n", -1), line)


def _js_steps(text: Column) -> Column:
    """A step per header, bracket, separator or what lies between."""
    def token(x):
        first = F.substring(x, 1, 1)
        arrow = x.contains("=>") & x.rlike(r"(?s)^[A-Za-z_$(<].*=>\s*+\{?$")
        head = (F.length(x) > 1) & (x.endswith("{") | arrow)
        before = F.when(arrow & x.rlike(r"^(?:const|let|var)\b"), F.regexp_extract(x, rf"^({_ASSIGNED})", 1)).otherwise("")
        name = (F.when(arrow, F.coalesce(F.nullif(F.regexp_extract(before, rf"^\w+\s+({_ID})", 1), F.lit("")), F.lit("<anonymous>")))
                .when(x.rlike(r"^(?:async\s+)?function\b"), F.regexp_extract(x, rf"function\s+({_ID})", 1))
                .otherwise(F.regexp_extract(x, rf"^{_MODIFIERS}(#?{_ID})", 1)))
        opens = F.when(head, x.endswith("{")).otherwise(first.isin("(", "[", "{"))
        return _step(
            n=F.length(x), visible=F.length(F.rtrim(x, F.lit(" \t\r\n\f"))), lines=_count(x, "\n"),
            delta=F.when(opens, 1).when(~head & first.isin(")", "]", "}"), -1).otherwise(0),
            kind=F.when(head, _HEAD).when(first == "}", _BRACE).when(first.isin(")", "]", ";", ",") | (x == "\n"), _END).otherwise(0),
            name=F.when(head, name), col=F.when(head, F.length(before)).otherwise(0),
            col_lines=F.when(head, _count(before, "\n")).otherwise(0))

    return F.transform(F.regexp_extract_all(text, F.lit(JS_TOKEN), 0), token)


def walk_python(steps) -> list[tuple[str, int, int, int]]:
    """(name, start, line, end) of the functions, from the steps of a file."""
    pos = sig = depth = 0
    line, joined, blocks, done = 1, False, [], []
    for n, visible, lines, delta, joins, name, indent, _ in steps:
        if visible and not depth and not joined:
            while blocks and blocks[-1][3] >= indent:
                done.append((*blocks.pop()[:3], sig))
            if name:
                blocks.append((name, pos + indent, line, indent))
        if visible:
            sig = pos + visible
        pos, line, depth, joined = pos + n, line + lines, max(0, depth + delta), joins
    return done + [(*b[:3], sig) for b in blocks]


def walk_js(steps) -> list[tuple[str, int, int, int]]:
    """(name, start, line, end) of the functions, from the steps of a file."""
    pos = sig = depth = 0
    line, blocks, done = 1, [], []
    for n, visible, lines, delta, kind, name, col, col_lines in steps:
        if kind == _HEAD:
            blocks.append((name, pos + col, line + col_lines, depth, delta == 0))
        elif kind:
            # an expression body ends before what closes it, a braced one after its brace
            while blocks:
                _, _, _, level, expression = blocks[-1]
                if expression and level >= depth:
                    done.append((*blocks.pop()[:3], sig))
                elif not expression and kind == _BRACE and level >= depth + delta:
                    done.append((*blocks.pop()[:3], pos + 1))
                else:
                    break
        if visible:
            sig = pos + visible
        pos, line, depth = pos + n, line + lines, depth + delta
    return done + [(*b[:3], sig) for b in blocks]


@F.pandas_udf(_UNITS)
def _walk(is_py: pd.Series, *steps: pd.Series) -> pd.DataFrame:
    found = [list(zip(*sorted((walk_python if py else walk_js)(zip(*columns)), key=lambda u: u[1]))) or [[]] * 4
             for py, *columns in zip(is_py, *steps)]
    return pd.DataFrame(found, columns=["name", "start", "line", "end"])


def file_steps(content: Column, is_py: Column) -> Column:
    """The steps of a file, as an array of structs."""
    clean = blanked(content, is_py)
    return F.when(is_py, _py_steps(clean)).otherwise(_js_steps(clean))


def segment_units(files: DataFrame) -> DataFrame:
    """files(repo, path, ord, content) -> units (unit_id, repo, file, name,
    start_line, line_count, lang_group, code, n_chars, scan_ord).

    ``scan_ord`` = ord * 2^32 + start offset: listing order, then position.
    """
    f = files.withColumn("lang_group", scan_group(path_extension("path"))).filter(
        F.col("lang_group").isNotNull() & F.col("content").isNotNull())
    is_py = F.col("lang_group") == "python"
    f = with_computed_once(f.select("repo", "path", "ord", "content", "lang_group"), _steps=file_steps(F.col("content"), is_py))
    f = f.select("repo", "path", "ord", "content", "lang_group", _walk(is_py, *[F.col("_steps")[c] for c in _STEPS]).alias("u"))
    f = f.select("*", F.explode(F.arrays_zip("u.name", "u.start", "u.line", "u.end")).alias("one")).drop("u")
    u = f.withColumnRenamed("one", "u").select("*", F.expr("substring(content, u.start + 1, u.end - u.start)").alias("code"))
    return u.select(
        F.xxhash64("repo", "path", "u.line", "u.start").alias("unit_id"), "repo", F.col("path").alias("file"), F.col("u.name").alias("name"),
        F.col("u.line").alias("start_line"), (_count(F.col("code"), "\n") + 1).cast("int").alias("line_count"), "lang_group", "code",
        F.length("code").alias("n_chars"), (F.col("ord") * F.lit(4294967296) + F.col("u.start") + 1).alias("scan_ord"))
