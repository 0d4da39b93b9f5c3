"""Telling code from text inside it: strings and comments of a source file.

A file is cut, inside its row, into code, strings and comments by one regular
expression per language (JS regular expressions count as strings).  Two masks
are built on those parts and shared by segmentation and structure facts:

* ``blanked``: same length, so every offset holds.  A comment becomes blanks,
  a string ``[sss]``, which counts as an open bracket where it spans lines.
* ``guarded``: the text unchanged, but in strings and comments a mark follows
  every line end and semicolon, so a pattern that begins at one finds code
  only; ``unguarded`` removes the marks from what was found.

Deviations: a JS regular expression is one where a value cannot end before it
(after an operator, an opening bracket, ``return`` or at a line's start); a
template nested in a template ends it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE_STRING = r"""'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+\""""
PY_PARTS = (r'(?s)\"\"\"(?:[^"\\]++|\\.|"(?!""))*+\"\"\"|' + r"\'\'\'(?:[^'\\]++|\\.|'(?!''))*+\'\'\'|"
            + _LINE_STRING + r"""|#[^\n]*+|[^"'#]++|["']""")
# A slash opens a regular expression where no value can end before it.
_REGEX = (r"(?<=[(,=:\[!&|?{};+*%~^<>\n-][ \t]{0,50}|\breturn[ \t]{0,50}|\A)/(?![/*])[^/\\\[\n]*+"
          r"(?:(?:\\[^\n]|\[[^\]\\\n]*+(?:\\[^\n][^\]\\\n]*+)*+\])[^/\\\[\n]*+)*+/[a-z]*+")
JS_PARTS = (r"(?s)`[^`\\]*+(?:\\.[^`\\]*+)*+`|" + _LINE_STRING + r"|//[^\n]*+|/\*.*?\*/|" + _REGEX
            + r"""|[^"'`/]++|["'`/]""")
# Follows line ends and semicolons inside strings and comments; a private-use
# character, which is removed from source texts.
GUARD = ""


def _parts(content: Column, is_py: Column) -> Column:
    return F.when(is_py, F.regexp_extract_all(content, F.lit(PY_PARTS), 0)).otherwise(
        F.regexp_extract_all(content, F.lit(JS_PARTS), 0))


def _is_comment(part: Column, is_py: Column) -> Column:
    return F.when(is_py, part.startswith("#")).otherwise(part.startswith("//") | part.startswith("/*"))


def _is_string(part: Column) -> Column:
    return (F.length(part) > 1) & part.rlike("^[\"'`/]")


def blanked(content: Column, is_py: Column) -> Column:
    """``content`` with strings and comments blanked, length kept."""
    def blank(part):
        inside = F.regexp_replace(F.substring(part, F.lit(2), F.length(part) - 2), "[^\n]", "s")
        return (F.when(_is_comment(part, is_py), F.regexp_replace(part, "[^\n]", " "))
                .when(_is_string(part), F.concat(F.lit("["), inside, F.lit("]"))).otherwise(part))

    return F.array_join(F.transform(_parts(content, is_py), blank), "")


def guarded(content: Column, is_py: Column) -> Column:
    """``content`` with a mark after line ends and semicolons inside strings and comments."""
    def guard(part):
        return F.when(_is_comment(part, is_py) | _is_string(part), F.regexp_replace(part, "([\n;])", f"$1{GUARD}")).otherwise(part)

    return F.array_join(F.transform(_parts(F.replace(content, F.lit(GUARD), F.lit("")), is_py), guard), "")


def unguarded(text: Column) -> Column:
    return F.replace(text, F.lit(GUARD), F.lit(""))
