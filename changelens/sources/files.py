"""Source files and fetched payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.caps import number_in_order
from ..operators.languages import SCAN_GROUPS, known_suffix

FILES_SCHEMA = "repo string, path string, ord bigint, content string"


def utf8_drop_invalid(b: Column) -> Column:
    """Bytes -> text, invalid UTF-8 sequences dropped (Python's
    ``decode('utf-8', errors='ignore')``).  ``make_valid_utf8`` replaces them
    with U+FFFD, which is then removed; a genuine U+FFFD in the source is
    removed too (documented deviation)."""
    return F.regexp_replace(F.make_valid_utf8(b.cast("string")), "�", "")


def load_files(spark: SparkSession, root: str, exts: list[str] | None = None) -> DataFrame:
    """All source files under ``root/<repo>/...`` as (repo, path, ord, content).

    The extension test runs at listing time (``pathGlobFilter``), before any
    content is read.  ``ord`` numbers a repo's files in path order, the code
    host's listing order; it is counted on the paths alone, without bringing a
    repo's paths to one task (``number_in_order``), and joined to the contents
    by path.  Each file is one row.
    """
    import os
    import re
    exts = exts or list(SCAN_GROUPS)
    glob = "*.{" + ",".join(e.lstrip(".") for e in exts) + "}"
    raw = (spark.read.format("binaryFile")
           .option("recursiveFileLookup", "true")
           .option("pathGlobFilter", glob)
           .load(root))
    local = root.split(":", 1)[1] if re.match(r"^[a-z][a-z0-9+.-]*:", root) else os.path.abspath(root)
    pat = r"^.*?" + re.escape(local.strip("/")) + r"/([^/]+)/(.*)$"
    named = raw.select("path", F.regexp_extract("path", pat, 1).alias("repo"),
                       F.regexp_extract("path", pat, 2).alias("file")).filter(known_suffix("file").isNotNull())
    listed = number_in_order(named, ["repo"], ["file"])
    return (raw.select("path", utf8_drop_invalid(F.col("content")).alias("content")).join(listed, "path")
            .select("repo", F.col("file").alias("path"), "ord", "content"))


def land_files(files: DataFrame, root: str) -> int:
    """Write files (repo, path, content) as ``root/<repo>/<path>``, each task its
    own, and return their number.  A file is written again by a retried task with
    the same content; null contents are left out.  ``root`` is any path that
    pyarrow's file systems open."""
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        system, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for repo, path, content in zip(*[c.to_pylist() for c in b.columns]):
                target = f"{base.rstrip('/')}/{repo}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows = files.filter(F.col("content").isNotNull()).select("repo", "path", F.encode("content", "UTF-8"))
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def from_table(df: DataFrame) -> DataFrame:
    """A landed files table (repo, path, ord, content) filtered to scanned
    extensions (``EndsWith`` filters, which the Parquet scan takes)."""
    wanted = F.lit(False)
    for ext in SCAN_GROUPS:
        wanted = wanted | F.col("path").endswith(ext)
    return df.filter(wanted).select("repo", "path", "ord", "content")


def decode_contents(payloads: DataFrame) -> DataFrame:
    """Fetched payloads -> text.  Non-200, non-base64 or empty content gives
    no row; line-wrapped base64 is accepted; invalid UTF-8 bytes are dropped."""
    ok = payloads.filter((F.col("status") == 200) & (F.col("encoding") == "base64"))
    # wrapped lines are fine; what is no base64 gives no row
    text = utf8_drop_invalid(F.try_to_binary(F.regexp_replace("content", r"\s", ""), F.lit("base64")))
    cols = [c for c in payloads.columns if c not in ("status", "encoding", "content")]
    return ok.select(*cols, text.alias("content")).filter(F.length("content") > 0)
