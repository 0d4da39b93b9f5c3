from changelens.operators import dedup
from changelens.operators.units import segment_units

PY = '''import os

def alpha(x):
    y = x + 1
    return y


class K:
    @staticmethod
    def beta(a,
             b):
        if a:
            return b

        return a

    async def gamma(self):
        def inner():
            return 1
        return inner()
'''

JS = '''import x from "y";
function foo(a) {
  const b = a + 1;
  return b;
}
const bar = (p) => {
  return p * 2;
};
class C {
  method(z) {
    return z;
  }
}
items.map((q) => {
  return q;
});
'''


def test_segment_units(spark):
    df = spark.createDataFrame([("r", "a.py", 1, PY), ("r", "b.ts", 2, JS)],
                               "repo string, path string, ord bigint, content string")
    got = {(r.file, r.name): (r.start_line, r.line_count, r.code, r.lang_group)
           for r in segment_units(df).collect()}
    assert got[("a.py", "alpha")] == (3, 3, "def alpha(x):\n    y = x + 1\n    return y", "python")
    assert got[("a.py", "beta")][:2] == (10, 6)            # decorator excluded, continued signature
    assert got[("a.py", "gamma")][2].startswith("async def gamma")
    assert got[("a.py", "inner")] == (18, 2, "def inner():\n            return 1", "python")
    assert got[("b.ts", "foo")][2] == "function foo(a) {\n  const b = a + 1;\n  return b;\n}"
    assert got[("b.ts", "bar")][2] == "(p) => {\n  return p * 2;\n}"
    assert got[("b.ts", "method")][:2] == (10, 3)
    assert got[("b.ts", "<anonymous>")][:2] == (14, 3)
    kept = {r.name for r in dedup.min_size_filter(segment_units(df)).collect()}
    assert "inner" not in kept and "alpha" in kept


def test_comments_do_not_end_blocks(spark):
    py = "def f(a):\n    x = 1\n# note at column 0\n    return x\n    # trailing comment\n\ny = 2\n"
    js = "function g() {\n  // a } brace in a comment\n  return 1;\n}\n"
    df = spark.createDataFrame([("r", "c.py", 1, py), ("r", "d.js", 2, js)],
                               "repo string, path string, ord bigint, content string")
    got = {r.name: (r.start_line, r.line_count, r.code) for r in segment_units(df).collect()}
    assert got["f"] == (1, 4, "def f(a):\n    x = 1\n# note at column 0\n    return x")
    assert got["g"][:2] == (1, 4)

HARD_PY = '''def f(s):
    a = s.split("(")
    return a

def g(
    a,
b="}",
):
    """Text
at column 0 ( [ {
    """
    return a  # note (

x = 1
'''

HARD_TS = '''const s = "{";
function pick<T>(a: T, b = "(") {
  const t = `x {
${a} (`;
  return t;
}
const Card = (p) => (
  <div>
    {p.x} don't
  </div>
);
function many(
  a,
  b,
) {
  return a; // }
}
class C {
  get<T>(
    k: string,
  ): T {
    return this.m[k];
  }
  /* { */
}
'''


def test_strings_generics_jsx_and_wrapped_parameters(spark):
    df = spark.createDataFrame([("r", "a.py", 1, HARD_PY), ("r", "b.tsx", 2, HARD_TS)],
                               "repo string, path string, ord bigint, content string")
    rows = segment_units(df).collect()
    got = {(r.file, r.name): (r.start_line, r.line_count) for r in rows}
    assert got == {("a.py", "f"): (1, 3), ("a.py", "g"): (5, 8), ("b.tsx", "pick"): (2, 5), ("b.tsx", "Card"): (7, 5),
                   ("b.tsx", "many"): (12, 6), ("b.tsx", "get"): (19, 5)}
    code = {r.name: r.code for r in rows}
    assert code["g"].endswith("    return a") and code["Card"].endswith("</div>\n)")
    assert code["get"].startswith("get<T>(") and code["get"].endswith("  }")
