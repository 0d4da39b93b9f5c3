"""Extension -> language dimension and its lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values that must equal the reference's.
# Extensions scanned for functions, and their comparison group.
SCAN_GROUPS = {
    ".py": "python",
    ".js": "js_ts",
    ".jsx": "js_ts",
    ".ts": "js_ts",
    ".tsx": "js_ts",
}
# Extension found in a diff -> (language name, test framework).
TEST_LANGUAGES = {
    ".py": ("Python", "pytest"),
    ".js": ("JavaScript", "Jest"),
    ".jsx": ("JavaScript (React)", "Jest with React Testing Library"),
    ".ts": ("TypeScript", "Jest"),
    ".tsx": ("TypeScript (React)", "Jest with React Testing Library"),
    ".java": ("Java", "JUnit 5"),
    ".go": ("Go", "Go's built-in testing package"),
    ".rb": ("Ruby", "RSpec"),
    ".php": ("PHP", "PHPUnit"),
    ".cs": ("C#", "xUnit"),
}
GENERIC_LANGUAGE = "an appropriate language for this code"
GENERIC_FRAMEWORK = "an appropriate testing framework"


def _map_literal(d: dict) -> Column:
    kv = []
    for k, v in d.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def languages_dim(spark: SparkSession) -> DataFrame:
    """The dimension as a 15-row table (fixed size: safe to broadcast)."""
    exts = sorted(set(SCAN_GROUPS) | set(TEST_LANGUAGES))
    rows = [(e, SCAN_GROUPS.get(e), *TEST_LANGUAGES.get(e, (None, None))) for e in exts]
    return spark.createDataFrame(rows, "ext string, lang_group string, language string, framework string")


def scan_group(ext) -> Column:
    """Comparison group of an extension, null when not scanned."""
    ext = F.col(ext) if isinstance(ext, str) else ext
    return F.element_at(_map_literal(SCAN_GROUPS), ext)


def attach_language(df: DataFrame, ext_col: str = "ext") -> DataFrame:
    """Adds lang_group, language, framework; unknown extensions get the
    generic language/framework (and a null group).

    The dimension is a fixed 15-entry map literal evaluated inside the
    projection: no join and no shuffle, whatever the size of ``df``.
    """
    ext = F.col(ext_col)
    lang = F.element_at(_map_literal({k: v[0] for k, v in TEST_LANGUAGES.items()}), ext)
    fw = F.element_at(_map_literal({k: v[1] for k, v in TEST_LANGUAGES.items()}), ext)
    return (df.withColumn("lang_group", scan_group(ext))
            .withColumn("language", F.coalesce(lang, F.lit(GENERIC_LANGUAGE)))
            .withColumn("framework", F.coalesce(fw, F.lit(GENERIC_FRAMEWORK))))


def path_extension(path) -> Column:
    """Extension as the reference derives it: '.' + text after the last dot
    (``'.' + path.rsplit('.', 1)[-1]``; no dot -> '.' + whole path)."""
    path = F.col(path) if isinstance(path, str) else path
    return F.concat(F.lit("."), F.substring_index(path, ".", -1))


def known_suffix(path) -> Column:
    """The first scanned extension the path ends with (listing filter), else null."""
    path = F.col(path) if isinstance(path, str) else path
    expr = F.lit(None).cast("string")
    for ext in reversed(list(SCAN_GROUPS)):
        expr = F.when(path.endswith(ext), F.lit(ext)).otherwise(expr)
    return expr
