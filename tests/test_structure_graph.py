from pyspark.sql import functions as F

from changelens.operators import graph, structure

PY = """import os
from a.b import (
    c,
    d,
)

class K:
    def m(self):
        import json
        def inner():
            pass

async def top():
    pass
"""

JS = """import x from "y";
import {
  a,
  b,
} from './z';
export default function main() {}
class Thing {}
const f = () => 1;
"""


def _files(spark):
    rows = [("r", "p/mod.py", 1, PY), ("r", "web/app.js", 2, JS), ("r", "empty.py", 3, ""),
            ("r", "README.md", 4, "# x")]
    return spark.createDataFrame(rows, "repo string, path string, ord bigint, content string")


def test_file_structures(spark):
    s = {r.file: (r.imports, r.symbols) for r in structure.file_structures(_files(spark)).collect()}
    assert "empty.py" not in s                      # no content, no row
    assert s["README.md"] == ([], [])               # unscanned extension: empty arrays
    imp, sym = s["p/mod.py"]
    assert imp == ["import os", "from a.b import (     c,     d, )", "import json"]
    assert sym == ["K", "m", "inner", "top"]        # all depths, in file order
    imp, sym = s["web/app.js"]
    assert imp == ['import x from "y";', "import {   a,   b, } from './z';"]
    assert sym == ["main", "Thing"]                 # arrow functions are not symbols


def test_structure_text_format(spark):
    rows = [("r", "a.py", 1, ["import os", "import re"], ["f", "g"]),
            ("r", "b.py", 2, [], ["h"]),
            ("r", "c.py", 3, [], [])]
    df = spark.createDataFrame(rows, "repo string, file string, ord bigint, imports array<string>, symbols array<string>")
    text = structure.structure_text(df).collect()[0].structure_text
    expected_lines = ["FILE: a.py", "  imports:", "    import os", "    import re", "  defines: f, g", "",
                      "FILE: b.py", "  defines: h", "", "FILE: c.py", ""]
    assert text == "\n".join(expected_lines)


def test_graph_ops(spark):
    rows = [("r", "a", 1, ["b", "c", "b"], []), ("r", "b", 2, ["c"], []), ("r", "c", 3, [], [])]
    s = spark.createDataFrame(rows, "repo string, file string, ord bigint, imports array<string>, symbols array<string>")
    e = graph.import_edges(s)
    assert e.count() == 3                            # duplicate edge removed
    resolved = {(r.src_file, r.dst_module): r.internal for r in graph.resolve_imports(e, s).collect()}
    assert all(resolved.values())
    s2 = spark.createDataFrame([("r", "a", 1, ["ext.lib"], [])],
                               "repo string, file string, ord bigint, imports array<string>, symbols array<string>")
    assert graph.external_imports(graph.import_edges(s2), s2).count() == 1
    deg = {r.module: (r.in_degree, r.out_degree) for r in graph.module_degree(e).collect()}
    assert deg == {"a": (0, 2), "b": (1, 1), "c": (2, 0)}
    top = graph.top_modules(graph.module_degree(e), 2)
    assert sorted(r.module for r in top.collect()) == ["a", "b"] or sorted(r.module for r in top.collect()) == ["b", "c"]
    d = graph.diagram_text(e, graph.top_modules(graph.module_degree(e), 12)).collect()[0]
    assert d.diagram.startswith("graph TD\n  a_0cc175[a] --> b_92eb5f[b]")
    assert graph.node_id(F.lit("x/y.z")) is not None


def test_duplicate_report_with_empty_repo(spark):
    from changelens.operators.report import NO_FILES_REASON, duplicate_report
    files = spark.createDataFrame([("r1", 1), ("r1", 2)], "repo string, ord int")
    units = spark.createDataFrame([(10, "r1"), (11, "r1")], "unit_id long, repo string")
    pairs = spark.createDataFrame([(10, 11)], "a_id long, b_id long")
    repos = spark.createDataFrame([("r1",), ("r2",)], "repo string")
    got = {r.repo: tuple(r)[1:] for r in duplicate_report(files, units, pairs, repos).collect()}
    assert got == {"r1": (2, 2, 1, None), "r2": (0, 0, 0, NO_FILES_REASON)}


def test_resolve_code_imports(spark):
    rows = [("r", "pkg/util.py", 1, "def u():\n    pass\n"),
            ("r", "pkg/sub/__init__.py", 2, "x = 1\n"),
            ("r", "app/main.py", 3, "import pkg.util\nfrom pkg.sub import x\nimport os\n"),
            ("r", "web/lib/a.ts", 4, "export function a() {}\n"),
            ("r", "web/lib/index.js", 5, "x\n"),
            ("r", "web/app/b.js", 6, "import {a} from '../lib/a';\nimport lib from '../lib';\nimport React from 'react';\n")]
    files = spark.createDataFrame(rows, "repo string, path string, ord bigint, content string")
    st = structure.file_structures(files)
    e = graph.resolve_code_imports(graph.code_import_edges(st), st)
    got = {(r.src_file, r.dst_module): r.dst_file for r in e.collect()}
    assert got == {("app/main.py", "pkg.util"): "pkg/util.py", ("app/main.py", "pkg.sub"): "pkg/sub/__init__.py",
                   ("app/main.py", "os"): None, ("web/app/b.js", "../lib/a"): "web/lib/a.ts",
                   ("web/app/b.js", "../lib"): "web/lib/index.js", ("web/app/b.js", "react"): None}


def test_resolve_every_python_import_form(spark):
    main = ("import os, pkg.b as x, pkg.sub\nfrom . import near\nfrom .near import c, \\\n    deep\n"
            "from pkg import (b,  # (one, two)\n    d, nowhere)\nfrom ..pkg import d\nfrom ....far import z\n"
            "from pkg.sub import *; import pkg.d\n")
    rows = [("r", "app/main.py", 1, main), ("r", "pkg/__init__.py", 2, "x = 1\n"), ("r", "pkg/b.py", 3, "from . import d\n"),
            ("r", "pkg/d.py", 4, "x = 1\n"), ("r", "pkg/sub/__init__.py", 5, "from . import one, two\nfrom .. import b\n"),
            ("r", "pkg/sub/two.py", 6, "x = 1\n"), ("r", "app/near.py", 7, "x = 1\n"), ("r", "far.py", 8, "from . import top\n"),
            ("r", "top.py", 9, "import near\n"), ("q", "near.py", 1, "x = 1\n")]
    st = structure.file_structures(spark.createDataFrame(rows, "repo string, path string, ord bigint, content string"))
    got = sorted((r.src_file, r.dst_module, r.dst_file or "") for r in graph.resolve_code_imports(
        graph.code_import_edges(st), st).collect())
    assert got == sorted([
        ("app/main.py", "os", ""), ("app/main.py", "pkg.b", "pkg/b.py"), ("app/main.py", "pkg.sub", "pkg/sub/__init__.py"),
        ("app/main.py", ".near", "app/near.py"), ("app/main.py", "pkg.d", "pkg/d.py"), ("app/main.py", "pkg", "pkg/__init__.py"),
        ("app/main.py", "..pkg.d", "pkg/d.py"), ("app/main.py", "....far", ""), ("pkg/b.py", ".d", "pkg/d.py"),
        ("pkg/sub/__init__.py", ".", "pkg/sub/__init__.py"), ("pkg/sub/__init__.py", ".two", "pkg/sub/two.py"),
        ("pkg/sub/__init__.py", "..b", "pkg/b.py"), ("far.py", ".top", "top.py"), ("top.py", "near", "")])


def test_modules_under_source_roots(spark):
    rows = [("r", "src/pkg/__init__.py", 1, "x = 1\n"), ("r", "src/pkg/b.py", 2, "import pkg.c, json\n"), ("r", "src/pkg/c.py", 3, "from pkg import b\n"),
            ("r", "tests/test_b.py", 4, "import pkg.b\nfrom pkg import c, nothing\nimport tools.run\nimport util\n"),
            ("r", "a/tools/run.py", 5, "import util\n"), ("r", "b/tools/run.py", 6, "from . import run\n"), ("r", "b/util.py", 7, "x = 1\n"),
            ("r", "b/tools/json.py", 8, "import tools.run\n"), ("q", "pkg/b.py", 1, "import tools.run\n")]
    st = structure.file_structures(spark.createDataFrame(rows, "repo string, path string, ord bigint, content string"))
    got = {(r.repo, r.src_file, r.dst_module): "?" if r.ambiguous else r.dst_file for r in graph.resolve_rooted_imports(
        graph.code_import_edges(st), st).collect()}
    assert got == {
        ("r", "src/pkg/b.py", "pkg.c"): "src/pkg/c.py", ("r", "src/pkg/b.py", "json"): None, ("r", "src/pkg/c.py", "pkg.b"): "src/pkg/b.py",
        ("r", "tests/test_b.py", "pkg.b"): "src/pkg/b.py", ("r", "tests/test_b.py", "pkg.c"): "src/pkg/c.py",
        ("r", "tests/test_b.py", "pkg"): "src/pkg/__init__.py", ("r", "tests/test_b.py", "tools.run"): "?", ("r", "tests/test_b.py", "util"): None,
        ("r", "a/tools/run.py", "util"): None, ("r", "b/tools/run.py", ".run"): "b/tools/run.py", ("r", "b/tools/json.py", "tools.run"): "b/tools/run.py",
        ("q", "pkg/b.py", "tools.run"): None}
