"""Rules and alignments over small sources, against the findings that follow from their definitions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sieveline.operators import ast_rules, clones, structure, symbols

CASES = {}


def query(sql):
    def register(fn):
        CASES[fn.__name__] = (fn, sql)
        return fn

    return register


#: Small sources that break each rule once.
SNIPPETS = {
    "pkg/a.py": "import os\ndef _unused():\n    return 1\n    x = 2\n\ndef used(a, b):\n    try:\n        return a and b or (1 if a else 2)\n    except:\n        pass\n",
    "pkg/b.py": "E = BaseException\ntry:\n    pass\nexcept E as exc:\n    raise exc\n",
    "pkg/c.py": "def broken(:\n",
    "pkg/d.py": "async def deep(xs) -> int:\n    for x in xs:\n        while x:\n            with x as y:\n                if y:\n                    return [a for a in x if a if y]\n    match xs:\n        case 1 if xs:\n            pass\n        case _:\n            pass\n",
}


def _files(spark, sources):
    return spark.createDataFrame(list(sources.items()), "path string, content string")


@query("""SELECT * FROM (VALUES
  ('pkg/a.py', 'complexity', 2, 4, '_unused()', 'PASS', 1, 0), ('pkg/a.py', 'missing-return', 2, 4, '_unused()', 'WARN', NULL, NULL), ('pkg/a.py', 'unreachable', 4, 4, 'statement', 'WARN', NULL, NULL),
  ('pkg/a.py', 'complexity', 6, 10, 'used()', 'PASS', 5, 1), ('pkg/a.py', 'missing-return', 6, 10, 'used()', 'WARN', NULL, NULL), ('pkg/a.py', 'bare-except', 9, 10, 'except', 'FAIL', NULL, NULL),
  ('pkg/a.py', 'swallowed', 9, 10, 'except', 'FAIL', NULL, NULL), ('pkg/a.py', 'inspected', 1, NULL, 'pkg/a.py', 'PASS', NULL, NULL),
  ('pkg/b.py', 'base-exception', 4, 5, 'except', 'FAIL', NULL, NULL), ('pkg/b.py', 'lost-traceback', 5, 5, 'exc', 'WARN', NULL, NULL), ('pkg/b.py', 'inspected', 1, NULL, 'pkg/b.py', 'PASS', NULL, NULL),
  ('pkg/c.py', 'syntax', 1, NULL, 'pkg/c.py', 'ERROR', NULL, NULL),
  ('pkg/d.py', 'complexity', 1, 11, 'deep()', 'WARN', 9, 4), ('pkg/d.py', 'inspected', 1, NULL, 'pkg/d.py', 'PASS', NULL, NULL)
) AS t(path, rule, start_line, end_line, target, status, complexity, nesting)""")
def case_ast_rules(spark):
    """Findings of the syntax-tree rules."""
    found = ast_rules.findings(_files(spark, SNIPPETS), missing_returns=True).drop("message")
    return found.select([F.col(c).cast("int").alias(c) if c in ("start_line", "end_line", "complexity", "nesting") else F.col(c) for c in found.columns])


_HANDLER = "try:\n    a()\nexcept {}:\n    b()\n"
#: Sources by what their handler catches.
CAUGHT = {
    "plain": _HANDLER.format("BaseException"),
    "tuple": _HANDLER.format("(ValueError, BaseException)"),
    "module": "import builtins as q\n" + _HANDLER.format("q.BaseException"),
    "import": "from builtins import BaseException as B\n" + _HANDLER.format("B"),
    "name": "E = BaseException\n" + _HANDLER.format("E"),
    "rebound": "E = BaseException\nE = ValueError\n" + _HANDLER.format("E"),
    "perhaps": "E = ValueError\nif x:\n    E = BaseException\n" + _HANDLER.format("E"),
    "shadowed": "BaseException = ValueError\n" + _HANDLER.format("BaseException"),
    "parameter": "from builtins import BaseException as B\ndef f(B):\n    try:\n        a()\n    except B:\n        b()\n",
    "inner": "def f():\n    try:\n        a()\n    except E:\n        b()\nE = BaseException\n",
    "other": _HANDLER.format("Exception"),
    "chain": "A = BaseException\n" + "".join(f"A{k} = A{k - 1 if k else ''}\n" for k in range(40)) + _HANDLER.format("A39"),
    "circle": "A = B\nB = A\n" + _HANDLER.format("B"),
}


@query("SELECT * FROM (VALUES ('plain', 3), ('tuple', 3), ('module', 4), ('import', 4), ('name', 4), ('perhaps', 6), ('inner', 4), ('chain', 44)) AS t(path, start_line)")
def case_base_exceptions(spark):
    """Handlers that may catch everything, by what their names mean where they stand."""
    found = ast_rules.findings(_files(spark, CAUGHT)).where("rule = 'base-exception'")
    return found.select("path", F.col("start_line").cast("int").alias("start_line"))


#: A package whose private functions are used in every way there is.
PACKAGE = {
    "src/p/__init__.py": "",
    "src/p/a.py": "def _x(): pass\ndef _y(): pass\n@dec\ndef _z(): pass\ndef __w(): pass\nclass C:\n    def _m(self): pass\n",
    "src/p/b.py": "from p.a import _x\n_x()\ndef _x(): pass\n",
    "src/p/c.py": "from p import a\na._y()\n",
    "src/p/d.py": "__all__ = ['_e']\ndef _e(): pass\ndef _f(): pass\n",
    "src/p/e.py": "from . import d\nd._f()\ndef _g(): pass\n",
    "src/p/f.py": "import p.g as h\nh._i()\ndef k():\n    raise ValueError\n    k()\n",
    "src/p/g.py": "def _i(): pass\ndef _j(): pass\n",
}


@query("""SELECT * FROM (VALUES ('src/p/__init__.py', 'inspected', 1, 'PASS'), ('src/p/a.py', '_x', 1, 'PASS'), ('src/p/a.py', '_y', 2, 'PASS'), ('src/p/b.py', '_x', 3, 'PASS'), ('src/p/c.py', 'inspected', 1, 'PASS'),
  ('src/p/d.py', '_f', 3, 'PASS'), ('src/p/e.py', '_g', 3, 'WARN'), ('src/p/f.py', 'statement', 5, 'WARN'), ('src/p/g.py', '_i', 1, 'PASS'), ('src/p/g.py', '_j', 2, 'WARN')) AS t(file, name, line, status)""")
def case_dead_code(spark):
    """Private functions by whether anything refers to them, unreachable statements, and clean files."""
    return ast_rules.dead_findings(_files(spark, PACKAGE)).select("file", "name", F.col("line").cast("int").alias("line"), "status")


@query("SELECT * FROM (VALUES ('pkg/c.py', 'ERROR')) AS t(file, status)")
def case_dead_code_aborts(spark):
    """A file that does not parse silences the rest."""
    return ast_rules.dead_findings(_files(spark, SNIPPETS)).select("file", "status")


@query("""SELECT * FROM (VALUES ('src/p/a.py', '_x'), ('src/p/a.py', '_y'), ('src/q.py', 'r'), ('src/p/deep.py', 'fn')) AS t(file, name)""")
def case_referenced_keys(spark):
    """Definitions that other modules refer to: by name, through a module, by a dotted prefix; unused imports refer to nothing."""
    modules = spark.createDataFrame([("p.a", "src/p/a.py"), ("q", "src/q.py"), ("p", "src/p/__init__.py"), ("p.deep", "src/p/deep.py")], "module string, file string")
    imports = [("m1", "_x", "p.a", "_x"), ("m2", "a", "p", "a"), ("m3", "q", "q", ""), ("m4", "p", "p.deep", ""), ("m5", "_z", "p.a", "_z"), ("m6", "nope", "nowhere", "nope")]
    refs = [("m1", "_x"), ("m2", "a"), ("m3", "q"), ("m4", "p"), ("m6", "nope")]
    qualified = [("m2", "a._y"), ("m3", "q.r"), ("m4", "p.deep.fn"), ("m4", "p.other")]
    frames = [spark.createDataFrame(rows, kind) for rows, kind in ((imports, "file string, alias string, module string, name string"), (refs, "file string, name string"), (qualified, "file string, ref string"))]
    return symbols.referenced_keys(modules, *frames)


NATIVE = {
    "a.cpp": 'struct A {\n  ~A() noexcept {\n    // throw x\n    if (b) { throw 1; }\n  }\n  void f() { throw 2; }\n};\nB::~B()\n{\n  throw "}";\n}\n',
    "b.cpp": 'try { f(); }\ncatch (...) {\n}\n"catch (...) {}"\ntry { g(); } catch(...) { }\ncatch (...) { log(); }\nR"x(catch (...) {})x"\n',
}


@query("SELECT * FROM (VALUES ('a.cpp', 'destructor', 4, 'FAIL'), ('a.cpp', 'destructor', 10, 'FAIL'), ('b.cpp', 'catch', 2, 'FAIL'), ('b.cpp', 'catch', 5, 'FAIL')) AS t(path, rule, start_line, status)")
def case_native_rules(spark):
    """Throws in destructors and empty catch-alls of C-like sources, outside comments and literals."""
    files = _files(spark, NATIVE)
    throws, empty = ast_rules.destructor_rows(files), ast_rules.native_exception_rows(files)
    both = throws.withColumn("rule", F.lit("destructor")).unionByName(empty.withColumn("rule", F.lit("catch")))
    return both.select("path", "rule", F.col("start_line").cast("int").alias("start_line"), "status")


@query("""SELECT * FROM (VALUES ('a', 'a = ; z'), ('b', 'u = ; v'), ('c', 'x = ; y')) AS t(path, rest)""")
def case_masked_source(spark):
    """Sources with comments and literals as spaces: what is left, once the white space is collapsed."""
    sources = {"a": 'a = "x//y"; // c \\\n more\n/* m\nn */ z', "b": "u = 'q'; R\"d(b\"c)d\" v", "c": 'x = "\\"/*"; /* " */ y'}
    masked = F.pandas_udf(lambda s: s.map(ast_rules.masked_source), "string")
    return _files(spark, sources).select("path", F.trim(F.regexp_replace(masked("content"), r"\s+", " ")).alias("rest"))


@query("SELECT * FROM (VALUES ('a.cpp', 'f', 1, 5, 3, 3, 'PASS'), ('a.cpp', 'g', 7, 9, 1, 1, 'PASS')) AS t(path, name, start_line, end_line, complexity, nesting, status)")
def case_heuristic_functions(spark):
    """Functions of a C-like source by lines and braces."""
    files = _files(spark, {"a.cpp": "int f(int a) {\n  if (a && b) {\n    for (;;) { x; }\n  }\n}\n\nvoid g() {\n  y;\n}\n"})
    found = structure.heuristic_functions(files)
    return found.select("path", "name", *[F.col(c).cast("int").alias(c) for c in ("start_line", "end_line", "complexity", "nesting")], "status")


def _body(names: str) -> str:
    a, b, c, d = names.split()
    return f"def {a}({b}):\n    {c} = 0\n    for {d} in {b}:\n        if {d}:\n            {c} += {d}\n        else:\n            {c} -= 1\n    print({c})\n    return {c}\n"


#: A function, renamed copies of it in the same and another file, and one with a line put in.
COPIES = {
    "core.py": _body("a b c d") + "x = 1\n" + _body("e f g h"),
    "refund.py": "# c\n" + _body("total items acc it"),
    "grown.py": _body("m n o q").replace("    print", "    extra = [1]\n    print"),
    "other.py": "y = 2\n",
}


@query("""SELECT * FROM (VALUES ('core.py', 'grown.py', 1, 7, 1, 7, 7), ('core.py', 'refund.py', 1, 9, 2, 10, 9), ('grown.py', 'refund.py', 1, 7, 2, 8, 7)) AS t(a, b, a_start, a_end, b_start, b_end, length)""")
def case_clone_alignment(spark):
    """Aligned blocks between renamed copies; one-to-one, the largest of overlapping ones."""
    files = _files(spark, COPIES)
    code = clones.code_lines(files, "path", "content")
    blocks = clones.unsubsumed(clones.matched_blocks(code, clones.candidate_pairs(clones.windows(code, "path"), "path"), "path"))
    return blocks.select("a", "b", *[F.col(c).cast("int").alias(c) for c in ("a_start", "a_end", "b_start", "b_end", "length")])


@query("""SELECT * FROM (VALUES (1, 9, 3, 'core.py', 1, 9, TRUE), (1, 9, 3, 'core.py', 11, 19, FALSE), (1, 9, 3, 'refund.py', 2, 10, FALSE), (2, 7, 3, 'core.py', 1, 7, TRUE), (2, 7, 3, 'grown.py', 1, 7, FALSE), (2, 7, 3, 'refund.py', 2, 8, FALSE)
) AS t(group_id, lines_count, n_occurrences, key, start_line, end_line, first)""")
def case_clone_intervals(spark):
    """Ranked groups of the intervals that the alignments and the copies within a file connect."""
    groups = clones.clone_report(_files(spark, COPIES), "path", "content")
    return groups.select(*[F.col(c).cast("int").alias(c) for c in ("group_id", "lines_count", "n_occurrences")], "key", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "first")


@pytest.mark.parametrize("name", sorted(CASES))
def test_rows(spark, name):
    build, sql = CASES[name]
    df, want = build(spark), duckdb.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in df.collect()))) == sorted(map(repr, want.fetchall()))
