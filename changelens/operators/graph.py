"""Import graph: edges, resolution, degrees, top modules and diagram text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP_MODULES = 12


def import_edges(structures: DataFrame, module_of=None) -> DataFrame:
    """(repo, src_file, dst_module) from each file's imports, duplicates removed.

    ``module_of`` maps an import text column to a module name (default: the
    text itself).
    """
    imp = F.explode("imports").alias("imp")
    e = structures.select("repo", F.col("file").alias("src_file"), imp)
    dst = module_of(F.col("imp")) if module_of else F.col("imp")
    return e.select("repo", "src_file", dst.alias("dst_module")).filter(
        F.col("dst_module") != "").distinct()


def resolve_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Marks each edge internal when a file of the same repo has the module's
    name, else external (left join on (repo, name); the file side is one row
    per file, so the join is a plain shuffle join - or broadcast when AQE
    measures it small)."""
    names = files.select("repo", F.col("file").alias("dst_module")).distinct().withColumn(
        "internal", F.lit(True))
    return (edges.join(names, ["repo", "dst_module"], "left")
            .withColumn("internal", F.coalesce("internal", F.lit(False))))


def external_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose module is no file of the repo (left anti join)."""
    names = files.select("repo", F.col("file").alias("dst_module"))
    return edges.join(names, ["repo", "dst_module"], "left_anti")


def module_degree(edges: DataFrame) -> DataFrame:
    """Per (repo, module): distinct modules it imports and distinct importers.

    ``edges`` is distinct (``import_edges``), so plain counts are distinct
    counts and combine map-side: a module imported by a third of all files
    costs one partial count per map task.  Each edge gives both its ends, so
    one aggregate does.
    """
    ends = F.inline(F.array(
        F.struct(F.col("src_file").alias("module"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst_module").alias("module"), F.lit(1).alias("i"), F.lit(0).alias("o"))))
    return edges.select("repo", ends).groupBy("repo", "module").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def top_modules(degree: DataFrame, k: int = TOP_MODULES) -> DataFrame:
    """The k best-connected modules per repo (in + out, ties by name).

    ``row_number() <= k`` runs as a partial top-k before the shuffle.
    """
    w = Window.partitionBy("repo").orderBy(
        (F.col("in_degree") + F.col("out_degree")).desc(), F.col("module"))
    return degree.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def node_id(c):
    """Diagram node id: characters other than letters, digits and _ -> _, and
    six digits of the name's MD5, so that different names keep different ids."""
    return F.concat(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"), F.lit("_"), F.substring(F.md5(c), 1, 6))


def diagram_text(edges: DataFrame, top: DataFrame) -> DataFrame:
    """Per repo a ``graph TD`` flowchart over the edges between top modules.

    At most k*k edges per repo reach the collect (k = size of ``top``).
    """
    t = top.select("repo", "module")
    sel = (edges.join(t.withColumnRenamed("module", "src_file"), ["repo", "src_file"], "left_semi")
           .join(t.withColumnRenamed("module", "dst_module"), ["repo", "dst_module"], "left_semi"))
    line = F.concat(F.lit("  "), node_id(F.col("src_file")), F.lit("["), F.col("src_file"),
                    F.lit("] --> "), node_id(F.col("dst_module")), F.lit("["), F.col("dst_module"),
                    F.lit("]"))
    per = sel.select("repo", "src_file", "dst_module", line.alias("line"))
    return (per.groupBy("repo")
            .agg(F.sort_array(F.collect_list(F.struct("src_file", "dst_module", "line"))).alias("_l"),
                 F.count(F.lit(1)).alias("n_edges"))
            .select("repo", "n_edges",
                    F.concat(F.lit("graph TD\n"),
                             F.array_join(F.transform("_l", lambda s: s["line"]), "\n")).alias("diagram")))


# Fixed candidate suffixes for JS/TS module paths (resolution order).
JS_SUFFIXES = ["", ".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.jsx", "/index.ts", "/index.tsx"]
_PY_FROM = r"(?s)^\s*from\s+(\.*)([^\s.]\S*|)\s+import\b(.*)$"
_PY_IMPORT = r"(?s)^\s*import\s+(.*)$"
_JS_IMPORT_PATH = r"""['"]([^'"]+)['"]"""


def _normalize_path(p):
    """Drop ``.`` segments and resolve ``..`` ones, as many as there are; a path
    that climbs above the root keeps its ``..`` and resolves to nothing."""
    def step(done, part):
        climbs = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return (F.when(part == ".", done)
                .when(climbs, F.slice(done, F.lit(1), F.size(done) - 1))
                .otherwise(F.concat(done, F.array(part))))

    return F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"),
                                    lambda done, part: F.when(F.size(done) == 0, F.when(part == ".", done).otherwise(
                                        F.array(part))).otherwise(step(done, part))), "/")


def _py_imported(stmt):
    """(dots, module, name) of everything a Python import statement names; name
    is empty where a module as a whole is imported (``import a``, ``*``)."""
    def first_words(c):
        words = F.transform(F.split(F.regexp_replace(c, r"[()\\]", " "), ","),
                            lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1))
        return F.filter(words, lambda x: x != "")

    dots, module = F.regexp_extract(stmt, _PY_FROM, 1), F.regexp_extract(stmt, _PY_FROM, 2)
    plain = F.transform(first_words(F.regexp_extract(stmt, _PY_IMPORT, 1)), lambda m: F.struct(
        F.lit("").alias("dots"), m.alias("module"), F.lit("").alias("name")))
    named = F.transform(first_words(F.regexp_extract(stmt, _PY_FROM, 3)), lambda n: F.struct(
        dots.alias("dots"), module.alias("module"), F.when(n == "*", F.lit("")).otherwise(n).alias("name")))
    return F.when(F.concat(dots, module) != "", named).otherwise(plain)


def _py_candidates(src_file, dots, module, name):
    """(module, file) in resolution order; none when the dots climb above the root."""
    above = F.split(src_file, "/")
    depth = F.size(above) - F.length(dots)          # folders that are left
    folder = F.when(dots == "", F.array().cast("array<string>")).when(
        depth >= 0, F.slice(above, F.lit(1), F.greatest(depth, F.lit(0))))
    base = F.concat(folder, F.when(module == "", F.array().cast("array<string>")).otherwise(F.split(module, r"\.")))
    written = F.concat(dots, module)
    sub = F.concat(written, F.when(module == "", F.lit("")).otherwise(F.lit(".")), name)

    def one(mod, parts, ending=""):
        return F.struct(mod.alias("module"), F.concat(F.array_join(parts, "/"), F.lit(ending)).alias("file"))

    named, init = F.concat(base, F.array(name)), F.array(F.lit("__init__.py"))
    none = F.array().cast("array<struct<module:string,file:string>>")
    cands = F.concat(
        F.when(name == "", none).otherwise(F.array(one(sub, named, ".py"), one(sub, F.concat(named, init)))),
        F.when(module == "", none).otherwise(F.array(one(written, base, ".py"))), F.array(one(written, F.concat(base, init))))
    return F.when(base.isNotNull(), cands).otherwise(none)


def _js_candidates(src_file, path):
    base = _normalize_path(F.concat(F.regexp_extract(src_file, r"^(.*/)?[^/]*$", 1), path))
    return F.when(path.startswith("."), F.array(*[
        F.struct(path.alias("module"), F.concat(base, F.lit(s)).alias("file")) for s in JS_SUFFIXES])).otherwise(
        F.array().cast("array<struct<module:string,file:string>>"))


def code_import_edges(structures: DataFrame) -> DataFrame:
    """Code imports -> (repo, src_file, dst_module, name, candidates), candidates
    being (module, file) in resolution order.

    Python: every module of ``import a.b, c`` and every name of ``from a.b
    import c, d``.  ``a.b`` has the files ``a/b.py`` and ``a/b/__init__.py``; a
    name of it is tried first as a module of its own (``a/b/c.py``,
    ``a/b/c/__init__.py``, as module ``a.b.c``).  Leading dots start at the
    importing file's folder, one more dot a folder higher; above the root
    nothing is found.  JS/TS: the quoted path; a relative one (``./``, ``../``)
    is resolved against the importing file's folder and tried with the usual
    extensions and ``index`` files; a bare package name stays a module name.

    ``statements`` (imports without comments, see ``structure``) is read where
    ``structures`` has it, else ``imports``.
    """
    text = "statements" if "statements" in structures.columns else "imports"
    e = structures.select("repo", F.col("file").alias("src_file"), F.explode(text).alias("imp"))
    path = F.regexp_extract("imp", _JS_IMPORT_PATH, 1)
    quoted = F.array(F.struct(F.lit("").alias("dots"), path.alias("module"), F.lit("").alias("name")))
    is_py, src = F.col("src_file").endswith(".py"), F.col("src_file")
    e = e.select("repo", "src_file", F.explode(F.when(is_py, _py_imported(F.col("imp"))).otherwise(quoted)).alias("i"))
    e = e.select("repo", "src_file", F.concat("i.dots", "i.module").alias("dst_module"), F.col("i.name").alias("name"),
                 F.when(is_py, _py_candidates(src, F.col("i.dots"), F.col("i.module"), F.col("i.name")))
                 .otherwise(_js_candidates(src, F.col("i.module"))).alias("candidates"))
    return e.filter(F.col("dst_module") != "").dropDuplicates(["repo", "src_file", "dst_module", "name"])


def resolve_code_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, src_file, dst_module, dst_file, internal): ``dst_file`` is the first
    candidate that is a file of the same repo, ``dst_module`` its module (an
    imported name that is no file counts for the module it comes from).
    Candidates are exploded and joined on (repo, file), a unique right side; the
    first hit by candidate order is kept with a ``min_by`` aggregate.  An edge
    without candidates keeps its row by a name that no file can have."""
    names = files.select("repo", F.col("file").alias("cand"), F.lit(True).alias("hit")).distinct()
    none = F.array(F.struct(F.col("dst_module").alias("module"), F.concat(F.lit("\0"), "src_file").alias("file")))
    key = ["repo", "src_file", "dst_module", "name"]
    tried = (edges.select(*key, F.posexplode(F.when(F.size("candidates") > 0, F.col("candidates")).otherwise(none))
                          .alias("pos", "c"))
             .select(*key, "pos", F.col("c.module").alias("module"), F.col("c.file").alias("cand")))
    best = (tried.join(names, ["repo", "cand"], "left").groupBy(*key)
            .agg(F.min_by(F.when(F.col("hit"), F.struct("module", "cand")), F.when(F.col("hit"), F.col("pos"))).alias("best")))
    return best.select("repo", "src_file", F.coalesce("best.module", "dst_module").alias("dst_module"),
                       F.col("best.cand").alias("dst_file"), F.col("best").isNotNull().alias("internal")).distinct()


def path_suffixes(files: DataFrame) -> DataFrame:
    """(repo, suffix, n, file): every proper suffix of two or more parts of a Python
    file's path, how many files of the repo end with it, and one of them.

    An inverted index with one row per suffix: a name that very many files end
    with is a counter combined map-side, never a list.
    """
    parts = F.split("file", "/")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    ends = files.select("repo", "file").filter(F.col("file").endswith(".py")).distinct().filter(F.size(parts) > 2)
    return (ends.select("repo", "file", F.explode(tails).alias("suffix"))
            .groupBy("repo", "suffix").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")))


def resolve_rooted_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, src_file, dst_module, dst_file, internal, ambiguous) of code import
    edges where modules may lie under source roots (``src/``, ``lib/python/``).

    An absolute Python import is tried at the repo's root, then under each
    folder above the importing file, outermost first.  What is found nowhere
    there is looked up by path suffix: the first candidate that any file of the
    repo ends with is taken when it is the only one, and reported as ambiguous, without
    a file, when there are several.  A module of one part without a package
    (``util.py``) is never looked up that way, since it would take names of the
    standard library for files.  Other imports resolve as in ``resolve_code_imports``.

    Both look-ups are left joins with a unique right side, which adaptive
    execution can split at a module that very many files import.
    """
    key = ["repo", "src_file", "dst_module", "name"]
    absolute = F.col("src_file").endswith(".py") & ~F.col("dst_module").startswith(".")
    folders = F.slice(F.split("src_file", "/"), F.lit(1), F.size(F.split("src_file", "/")) - 1)

    def under(depth):
        return F.transform("candidates", lambda c: F.struct(
            c["module"].alias("module"), F.array_join(F.concat(F.slice(folders, F.lit(1), depth), F.array(c["file"])), "/").alias("file"),
            (depth == 0).alias("at_root")))

    tried = edges.select(*key, absolute.alias("absolute"), F.posexplode_outer(F.flatten(F.transform(
        F.sequence(F.lit(0), F.when(absolute, F.size(folders)).otherwise(0)), under))).alias("pos", "c"))
    tried = tried.select(*key, "pos", F.col("c.module").alias("module"), F.col("c.file").alias("cand"),
                         (F.col("absolute") & F.col("c.at_root")).alias("anywhere"))
    names = files.select("repo", F.col("file").alias("cand"), F.lit(True).alias("hit")).distinct()
    index = path_suffixes(files).select("repo", F.col("suffix").alias("cand"), F.col("n").alias("n_files"), F.col("file").alias("elsewhere"))
    found = tried.join(names, ["repo", "cand"], "left").join(index, ["repo", "cand"], "left")
    late = F.col("anywhere") & F.col("n_files").isNotNull()
    best = found.groupBy(*key).agg(
        F.min_by(F.when(F.col("hit"), F.struct("module", "cand")), F.when(F.col("hit"), F.col("pos"))).alias("best"),
        F.min_by(F.when(late, F.struct("module", "n_files", "elsewhere")), F.when(late, F.col("pos"))).alias("late"))
    single = F.when(F.col("late.n_files") == 1, F.col("late.elsewhere"))
    dst_file = F.coalesce("best.cand", single)
    return best.select("repo", "src_file", F.coalesce("best.module", "late.module", "dst_module").alias("dst_module"), dst_file.alias("dst_file"),
                       dst_file.isNotNull().alias("internal"),
                       (F.col("best").isNull() & F.coalesce(F.col("late.n_files") > 1, F.lit(False))).alias("ambiguous")).distinct()
