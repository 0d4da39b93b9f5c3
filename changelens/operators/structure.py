"""Structure facts per file: imports and defined symbols.

The reference walks a syntax tree; here each file is one row and the facts
are read with regular expressions inside the row (no explode, no shuffle).
They read code only: ``masking.guarded`` marks line ends and semicolons inside
strings and comments, so no statement begins there.  JS ``require`` and
``import(...)`` calls are no import statements, generator functions and function
expressions no symbols, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import with_computed_once
from .languages import path_extension, scan_group
from .masking import guarded, unguarded

# Python: ``import a`` / ``from a import (b,\n c)`` at any depth.
# Statements may follow a semicolon and go on after a backslash; comments after
# them are left out, those inside brackets belong to them.
PY_IMPORT = (r"(?dm)(?:^|;)[ \t]*(import[ \t]+[^\n;#\\]*+(?:\\\n[^\n;#\\]*+)*+"
             r"|from[ \t]+[^\s]+[ \t]+import[ \t]*"
             r"(?:\([^)#]*+(?:#[^\n]*+[^)#]*+)*+\)|[^\n;#(\\]*+(?:\\\n[^\n;#(\\]*+)*+))")
# JS/TS: ``import x from 'm';``, ``import {a,\n b} from "m"``, ``import 'm'``.
JS_IMPORT = r"(?dm)(?:^|(?<=;))[ \t]*(import\b(?!\s*[(.])[^;'\"]*?['\"][^'\"\n]*['\"];?)"
# Defined names: Python functions and classes at every depth (methods and
# nested functions included); JS/TS function and class declarations.
PY_SYMBOL = r"(?dm)^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+([A-Za-z_]\w*)"
JS_SYMBOL = (r"(?dm)(?:^|[;{}])[ \t]*(?:export[ \t]+(?:default[ \t]+)?)?(?:async[ \t]+)?"
             r"(?:function|class)[ \t]+([A-Za-z_$][\w$]*)")


def _clean_import(x: Column) -> Column:
    # newlines -> blanks, then Python-like strip
    return F.regexp_replace(F.regexp_replace(unguarded(x), "\n", " "), r"(?U)^\s+|\s+$", "")


def _import_statements(content: Column, group: Column) -> Column:
    py = F.regexp_extract_all(content, F.lit(PY_IMPORT), 1)
    js = F.regexp_extract_all(content, F.lit(JS_IMPORT), 1)
    return F.when(group == "python", py).when(group == "js_ts", js).otherwise(F.array().cast("array<string>"))


def extract_imports(content: Column, group: Column) -> Column:
    """Import statements of one file's guarded content, in file order, one line each."""
    return F.transform(_import_statements(content, group), _clean_import)


def bare_imports(content: Column, group: Column) -> Column:
    """The same without Python comments, which end where their line does and
    cannot be told from names once a statement is one line."""
    return F.transform(_import_statements(content, group), lambda x: _clean_import(
        F.when(group == "python", F.regexp_replace(x, "#[^\n]*", "")).otherwise(x)))


def extract_symbols(content: Column, group: Column) -> Column:
    """Function and class names of one file's guarded content, in file order."""
    py = F.regexp_extract_all(content, F.lit(PY_SYMBOL), 1)
    js = F.regexp_extract_all(content, F.lit(JS_SYMBOL), 1)
    return F.when(group == "python", py).when(group == "js_ts", js).otherwise(
        F.array().cast("array<string>"))


def file_structures(files: DataFrame) -> DataFrame:
    """files(repo, path, ord, content) -> (repo, file, ord, imports, symbols,
    statements); statements are the imports without comments.

    Only files with content get a row (as in the reference); a file with no
    import or symbol gets empty arrays.
    """
    f = with_computed_once(
        files.filter(F.col("content").isNotNull() & (F.length("content") > 0))
        .select("repo", F.col("path").alias("file"), "ord", scan_group(path_extension("path")).alias("_group"), "content"),
        _code=F.when(F.col("_group").isNotNull(), guarded(F.col("content"), F.col("_group") == "python")))
    code, grp = F.col("_code"), F.col("_group")
    return f.select("repo", "file", "ord", extract_imports(code, grp).alias("imports"), extract_symbols(code, grp).alias("symbols"),
                    bare_imports(code, grp).alias("statements"))


def structure_block(file: Column, imports: Column, symbols: Column) -> Column:
    """The per-file text block of the architecture summary (fixed values: its
    layout must equal the reference's):

        FILE: <file>
          imports:
            <import>
          defines: a, b
        <blank line>

    Empty parts are left out.
    """
    imp = F.when(F.size(imports) > 0, F.concat(
        F.lit("  imports:\n"),
        F.array_join(F.transform(imports, lambda x: F.concat(F.lit("    "), x)), "\n")))
    sym = F.when(F.size(symbols) > 0, F.concat(F.lit("  defines: "), F.array_join(symbols, ", ")))
    return F.concat_ws("\n", F.concat(F.lit("FILE: "), file), imp, sym, F.lit(""))


# Listing positions that one text covers.
FILES_PER_TEXT = 100


def structure_text(structures: DataFrame, order: str = "ord", files_per_text: int = FILES_PER_TEXT) -> DataFrame:
    """Texts of a repo's file blocks in listing order, joined by newline.

    A repo of any size is covered: part n holds the files at the listing
    positions from n * ``files_per_text`` on, so a row never collects more
    than that many blocks.  ``structure_blocks`` gives the per-file form.
    """
    blocks = structure_blocks(structures, order)
    part = F.floor(F.col(order) / files_per_text).cast("long").alias("part")
    return (blocks.groupBy("repo", part)
            .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("block").alias("b"))))
                 .alias("_bs"), F.count(F.lit(1)).alias("n_files"))
            .select("repo", "part", "n_files",
                    F.array_join(F.transform("_bs", lambda s: s["b"]), "\n").alias("structure_text")))


def structure_blocks(structures: DataFrame, order: str = "ord") -> DataFrame:
    return structures.select("repo", "file", order,
                             structure_block(F.col("file"), F.col("imports"), F.col("symbols")).alias("block"))
