"""The reference's four jobs as compositions of the operators.

Each function works on tables of many repos or changes at once.  The shingle
scan writes its sets once to the checkpoint folder when it is built; all else
is lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caps, dedup, diffs, graph, inference, report, structure
from .units import segment_units


def duplicate_scan(files: DataFrame, method: str = "shingle", max_files: int | None = None,
                   threshold: float = dedup.SIMILARITY_THRESHOLD, k: int = 5,
                   within_repo: bool = True) -> dict[str, DataFrame]:
    """files(repo, path, ord, content) -> {"units", "pairs", "report"}.

    ``method='shingle'`` (default): exact k-shingle Jaccard with copy groups
    (the scale path).  ``method='exact'``: difflib ratio over all pairs of a
    band, ranked by similarity (the reference's measure, for bounded inputs).  ``max_files``
    applies the reference's per-repo listing cap (off by default).  A scan looks
    at each repo by itself; ``within_repo=False`` compares repos too.  With
    shingles, ``pairs`` are of representatives and ``copies`` has their copies.
    """
    listed = caps.cap_per_repo(files, max_files).drop("rank_in_repo") if max_files else files
    units = dedup.min_size_filter(segment_units(listed))
    copies = None
    if method == "exact":
        pairs = dedup.rank_pairs(dedup.similar_pairs_exact(units, threshold, within_repo=within_repo))
        ids = pairs.select(F.col("a_unit_id").alias("a_id"), F.col("b_unit_id").alias("b_id"))
    elif method == "shingle":
        pairs = dedup.shingle_similar_pairs(units, k=k, threshold=threshold, within_repo=within_repo)
        copies = dedup.copy_groups(units, k=k, within_repo=within_repo)
        ids = pairs.select("a_id", "b_id")
    else:
        raise ValueError("method must be 'exact' or 'shingle'")
    rep = report.duplicate_report(listed.select("repo"), units.select("unit_id", "repo"), ids, copies=copies)
    return {"units": units, "pairs": pairs, "report": rep} | ({"copies": copies} if copies is not None else {})


def architecture_facts(files: DataFrame, max_files: int | None = None,
                       top_k: int = graph.TOP_MODULES) -> dict[str, DataFrame]:
    """files -> {"structures", "structure_text", "edges", "degrees", "diagram",
    "requests"}: the facts the architecture prompt is built from, the import
    graph computed from them, and one architecture request per repo.

    Structures, edges, degrees and diagram cover every file; a repo's text and
    requests come in parts of bounded size.  ``max_files`` (off by default)
    leaves further files out of the texts alone."""
    st = structure.file_structures(files)
    told = caps.cap_per_repo(st, max_files).drop("rank_in_repo") if max_files else st
    text = structure.structure_text(told)
    edges = graph.resolve_code_imports(graph.code_import_edges(st), st)
    internal = edges.filter("internal").select("repo", "src_file", F.col("dst_file").alias("dst_module")).distinct()
    degrees = graph.module_degree(internal)
    diagram = graph.diagram_text(internal, graph.top_modules(degrees, top_k))
    requests = inference.build_requests(
        text.withColumn("key", F.concat_ws("#", "repo", F.col("part").cast("string"))), "architecture")
    return {"structures": st, "structure_text": text, "edges": edges, "degrees": degrees,
            "diagram": diagram, "requests": requests}


def review_requests(diff_table: DataFrame, kind: str = "review", max_chars: int | None = None) -> DataFrame:
    """diffs(owner, repo, pr_number, diff) -> review or tests requests keyed
    ``owner/repo/number``; tests requests carry the primary language of the
    diff.  ``max_chars`` (off by default) cuts diffs first."""
    key = F.concat_ws("/", "owner", "repo", F.col("pr_number").cast("string"))
    d = diff_table.select(key.alias("key"), "diff")
    if kind == "tests":
        cut = F.substring("diff", 1, max_chars) if max_chars else F.col("diff")
        d = diffs.with_primary_language(d, cut)
    return inference.build_requests(d, kind, max_chars=max_chars)
