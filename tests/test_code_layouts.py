"""Layouts of source files that line rules miss: segmentation and structure facts."""

from changelens.operators import structure
from changelens.operators.units import segment_units

FILES = "repo string, path string, ord bigint, content string"

ALLMAN = '''function first(a)
{
  return a;
}
class Box
{
  open(key)
  {
    return this.m[key];
  }
  get size() { return 1; } set size(v) { this.n = v; }
}
const pick = (x) =>
{
  return x;
};
'''

ONE_LINE = '''const a = (x) => x + 1, rest = 2; const b = async y => { return y; };
items.map(z => z.id).filter((q) => { return q > 0; });
function one() { return 1; } function two() { return [2, 3].map(v => v * 2); }
const nested = p => q => ({ p, q });
const late = (m) =>
  m.first
    .second(r => r);
const run = function hidden() { return 0; };
function* stream() { yield 1; }
type Take = (n: number) => void;
const typed: (n: number) => string = (n) => `${n}`;
'''

REGEXES = '''function strip(s) {
  const quote = /["'`{(]/g;
  return s.replace(/[/"]\\/{/, "x") / 2;   // a } and a "
}
function after(t) {
  return t / 2 > 1 ? "}" : '{';
}
'''

PYTHON = '''class K:
    def a(self, x=(1,
2)):
        return """
def not_a_function():
    import nothing
"""

    def b(self): return 1
    async def c(self):
        if x and \\
y:
            return {
}
        # def commented(): pass
def last():
    pass
'''


def _units(spark, **files):
    rows = [("r", path.replace("_", "."), i, text) for i, (path, text) in enumerate(files.items())]
    return segment_units(spark.createDataFrame(rows, FILES)).collect()


def test_braces_on_the_next_line(spark):
    got = {(r.name, r.start_line): (r.line_count, r.code) for r in _units(spark, a_js=ALLMAN)}
    assert {k: v[0] for k, v in got.items()} == {("first", 1): 4, ("open", 7): 4, ("size", 11): 1, ("pick", 13): 4}
    assert got["first", 1][1] == "function first(a)\n{\n  return a;\n}"
    assert got["pick", 13][1] == "(x) =>\n{\n  return x;\n}"


def test_two_accessors_on_a_line(spark):
    assert [r.code for r in _units(spark, a_js=ALLMAN) if r.name == "size"] == ["get size() { return 1; }", "set size(v) { this.n = v; }"]


def test_several_headers_on_a_line(spark):
    got = [(r.name, r.start_line, r.code) for r in sorted(_units(spark, a_ts=ONE_LINE), key=lambda r: r.scan_ord)]
    assert got == [
        ("a", 1, "(x) => x + 1"), ("b", 1, "async y => { return y; }"), ("<anonymous>", 2, "z => z.id"),
        ("<anonymous>", 2, "(q) => { return q > 0; }"), ("one", 3, "function one() { return 1; }"),
        ("two", 3, "function two() { return [2, 3].map(v => v * 2); }"), ("<anonymous>", 3, "v => v * 2"),
        ("nested", 4, "p => q => ({ p, q })"), ("<anonymous>", 4, "q => ({ p, q })"),
        ("late", 5, "(m) =>\n  m.first\n    .second(r => r)"), ("<anonymous>", 7, "r => r"), ("typed", 11, "(n) => `${n}`")]


def test_quotes_in_regular_expressions(spark):
    got = {r.name: (r.start_line, r.line_count) for r in _units(spark, a_js=REGEXES)}
    assert got == {"strip": (1, 4), "after": (5, 3)}


def test_python_layouts(spark):
    got = {r.name: (r.start_line, r.line_count) for r in _units(spark, a_py=PYTHON)}
    assert got == {"a": (2, 6), "b": (9, 1), "c": (10, 5), "last": (16, 2)}


def test_segmentation_is_one_scan(spark):
    df = spark.createDataFrame([("r", "a.py", 1, PYTHON)], FILES)
    plan = segment_units(df)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


def test_empty_and_odd_files(spark):
    odd = {"a_py": "", "b_js": "}}} ) => {", "c_py": "def f(:\n  (((", "d_js": "`${`}` ' /", "e_py": None, "f_js": "function f() {\n",
           "g_js": "x" * 50_000, "h_js": "(" * 3_000, "i_js": "word " * 20_000, "j_py": "'" * 20_001}
    got = {(r.file, r.name): r.code for r in _units(spark, **odd)}
    assert got == {("c.py", "f"): "def f(:\n  (((", ("f.js", "f"): "function f() {"}


def test_facts_are_read_from_code_only(spark):
    py = ('"""\nimport fake\nfrom a import b\ndef fake(): pass\n"""\nimport os  # import no; import never\n'
          "x = 'a; import b'; import re\n'''\nclass Fake:\n'''\nfrom m import (a,  # first; import c\n  b)\nclass Real:\n    pass\n# def gone(): pass\n")
    js = ('/*\nimport x from "y";\nfunction gone() {}\n*/\nimport a from "a"; import b from \'b\';\n'
          'const t = `\nimport z from "z";\nclass Gone {}\n`;\nconst lazy = import("later");\nimport("now");\n'
          "function real() {} class Kept {}\nfunction* stream() {}\nconst f = function hidden() {};\n")
    rows = [("r", "a.py", 1, py), ("r", "b.ts", 2, js)]
    got = {r.file: r for r in structure.file_structures(spark.createDataFrame(rows, FILES)).collect()}
    assert got["a.py"].imports == ["import os", "import re", "from m import (a,  # first; import c   b)"]
    assert got["a.py"].statements == ["import os", "import re", "from m import (a,     b)"]
    assert got["a.py"].symbols == ["Real"]
    assert got["b.ts"].imports == ['import a from "a";', "import b from 'b';"]
    assert got["b.ts"].symbols == ["real", "Kept"]


def test_sized_functions_of_every_line_and_turn(spark, tmp_path):
    """The scan's functions are those of the code files too, not of the turn files alone."""
    import duckdb

    from changelens.plans import segments
    rows = [(1, 0, "user", "one line"), (1, 1, "assistant", "first\nsecond \"quoted\""), (2, 0, "user", "a\nb\nc"), (2, 1, "assistant", "")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(tuple(r) for r in segments.sized_functions(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert got == sorted(con.sql(segments.SQL_SIZED_FUNCTIONS).fetchall())
    assert {(f, n) for f, n, _, _ in got} == {
        ("1/0.py", "line_1"), ("1/1.tsx", "line_1"), ("1/1.tsx", "line_2"), ("2/0.py", "line_1"), ("2/0.py", "line_2"), ("2/0.py", "line_3"),
        ("2/1.tsx", "line_1"), ("1/1.js", "reply_1"), ("2/0.py", "reply_0"), ("2/1.js", "reply_1")}
