"""Rules over syntax trees: complexity, exceptions, unreachable and undocumented code, symbol facts.

No built-in parses source code, so each file is parsed in a Python worker that
emits rows; everything after that is relational. A file that does not parse gives
one row saying so.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import policy
from sieveline.functions import text as T
from sieveline.operators import symbols
from sieveline.operators.storage import stored

FINDING = "path string, rule string, start_line long, end_line long, target string, status string, message string"
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPES = (*FUNCTIONS, ast.ClassDef, ast.Lambda)
_ONE = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp)
_DEEPER = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.Try, ast.With)
_ENDS = (ast.Return, ast.Raise, ast.Break, ast.Continue)


def weight(node: ast.AST) -> int:
    """What a node adds to cyclomatic complexity."""
    match node:
        case ast.BoolOp(values=values):
            return len(values) - 1
        case ast.comprehension(ifs=ifs):
            return len(ifs)
        case ast.Match(cases=cases):
            return 1 + sum(case.guard is not None for case in cases)
    return int(isinstance(node, _ONE))


def depth(node: ast.AST) -> int:
    """Greatest number of nested blocks at or below a node."""
    deepest, stack = 0, [(node, 0)]
    while stack:
        node, above = stack.pop()
        here = above + isinstance(node, _DEEPER)
        deepest = max(deepest, here)
        stack += [(child, here) for child in ast.iter_child_nodes(node)]
    return deepest


def statement_lists(tree: ast.AST) -> Iterator[list[ast.stmt]]:
    for node in ast.walk(tree):
        for _, value in ast.iter_fields(node):
            if isinstance(value, list) and value and isinstance(value[0], ast.stmt):
                yield value


def own_nodes(scope: ast.AST) -> Iterator[ast.AST]:
    """Nodes of a scope, without those of scopes inside it."""
    stack = list(ast.iter_child_nodes(scope))
    while stack:
        node = stack.pop()
        yield node
        if not isinstance(node, SCOPES):
            stack += ast.iter_child_nodes(node)


class BaseNames:
    """Which names mean BaseException where a handler stands.

    Assignments count in textual order. An unconditional binding replaces what a name
    meant; one inside a branch, loop or try only adds a possibility.
    """

    def __init__(self, tree: ast.Module):
        self.parents: dict[ast.AST, ast.AST] = {child: node for node in ast.walk(tree) for child in ast.iter_child_nodes(node)}
        self.tree = tree
        self.events: dict[ast.AST, dict[str, list]] = {}

    def scopes(self, node: ast.AST) -> list[ast.AST]:
        """Scopes around a node, innermost first; class scopes count only for code directly in them."""
        found, inner = [], True
        while node in self.parents:
            node = self.parents[node]
            if isinstance(node, (*FUNCTIONS, ast.Lambda, ast.Module)) or isinstance(node, ast.ClassDef) and inner:
                found.append(node)
                inner = False
        return found

    def _conditional(self, node: ast.AST, scope: ast.AST) -> bool:
        while (node := self.parents.get(node)) is not None and node is not scope:
            if isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.Match, ast.IfExp)):
                return True
        return False

    def _bindings(self, scope: ast.AST) -> dict[str, list]:
        if scope in self.events:
            return self.events[scope]
        out: dict[str, list] = {}

        def bind(name: str, node: ast.AST, value):
            out.setdefault(name, []).append(((node.lineno, node.col_offset), value, self._conditional(node, scope)))

        if isinstance(scope, (*FUNCTIONS, ast.Lambda)):
            args = scope.args
            for arg in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]:
                bind(arg.arg, arg, None)
        outside = {name for node in own_nodes(scope) if isinstance(node, (ast.Global, ast.Nonlocal)) for name in node.names}
        for node in own_nodes(scope):
            match node:
                case ast.Assign(targets=targets, value=value):
                    for target in targets:
                        self._assign(target, value, bind)
                case ast.AnnAssign(target=ast.Name(id=name), value=value) if value is not None:
                    bind(name, node, value)
                case ast.NamedExpr(target=ast.Name(id=name), value=value):
                    bind(name, node, value)
                case ast.Import(names=names):
                    for alias in names:
                        bind(alias.asname or alias.name.split(".")[0], node, ("module", alias.name if alias.asname else alias.name.split(".")[0]))
                case ast.ImportFrom(module=module, names=names):
                    for alias in names:
                        bind(alias.asname or alias.name, node, ("name", module, alias.name))
                case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name) | ast.ClassDef(name=name):
                    bind(name, node, None)
                case ast.ExceptHandler(name=name) if name:
                    bind(name, node, None)
                case ast.For(target=target) | ast.AsyncFor(target=target):
                    self._assign(target, None, bind)
                case ast.withitem(optional_vars=target) if target is not None:
                    self._assign(target, None, bind)
                case ast.Delete(targets=targets):
                    for target in targets:
                        self._assign(target, None, bind)
        for name in outside:
            out.pop(name, None)
        self.events[scope] = {name: sorted(found, key=lambda e: e[0]) for name, found in out.items()}
        return self.events[scope]

    def _assign(self, target, value, bind) -> None:
        if isinstance(target, ast.Name):
            bind(target.id, target, value)
        elif isinstance(target, (ast.Tuple, ast.List)):
            values = value.elts if isinstance(value, (ast.Tuple, ast.List)) and len(value.elts) == len(target.elts) else [None] * len(target.elts)
            for one, each in zip(target.elts, values):
                self._assign(one, each, bind)

    def _lookup(self, name: str, at: ast.AST, direct: bool):
        """Possible meanings of a name: the last certain one and the uncertain ones since."""
        here = (at.lineno, at.col_offset)
        for k, scope in enumerate(self.scopes(at)):
            found = self._bindings(scope).get(name, [])
            # Code of an inner function runs later, so it sees all bindings outside it.
            seen = [e for e in found if e[0] < here] if k == 0 and direct else found
            if k == 0 and isinstance(scope, (*FUNCTIONS, ast.Lambda)) and found and not seen:
                return []
            last = max((n for n, e in enumerate(seen) if not e[2]), default=None)
            if last is not None:
                return [(e[1], scope) for e in seen[last:]]
            if seen:
                outer = self._builtin(name)
                return [(e[1], scope) for e in seen] + outer
        return self._builtin(name)

    @staticmethod
    def _builtin(name: str) -> list:
        return [("builtin", None)] if name == "BaseException" else [("module", "builtins")] if name == "__builtins__" else []

    def is_base(self, expr: ast.expr | None, at: ast.AST, above: tuple[ast.expr, ...] = ()) -> bool:
        """Whether an expression may mean BaseException at a place; names that mean themselves do not."""
        if expr is None or expr in above:
            return False
        above = (*above, expr)
        if isinstance(expr, (ast.Tuple, ast.List)):
            return any(self.is_base(e, at, above) for e in expr.elts)
        if isinstance(expr, ast.Starred):
            return self.is_base(expr.value, at, above)
        if isinstance(expr, ast.IfExp):
            return self.is_base(expr.body, at, above) or self.is_base(expr.orelse, at, above)
        if isinstance(expr, ast.BinOp) and isinstance(expr.op, ast.Add):
            return self.is_base(expr.left, at, above) or self.is_base(expr.right, at, above)
        if isinstance(expr, ast.Attribute) and expr.attr == "BaseException" and isinstance(expr.value, ast.Name):
            return any(m == ("module", "builtins") for m, *_ in self._kinds(expr.value.id, at))
        if isinstance(expr, ast.Name):
            for meaning, _ in self._lookup(expr.id, at, True):
                if meaning == "builtin" or meaning == ("name", "builtins", "BaseException"):
                    return True
                if isinstance(meaning, ast.expr) and self.is_base(meaning, meaning, above):
                    return True
        return False

    def _kinds(self, name: str, at: ast.AST) -> list:
        return self._lookup(name, at, True)


def _exception_rows(tree: ast.Module, path: str) -> Iterator[tuple]:
    names = BaseNames(tree)
    for node in ast.walk(tree):
        if not isinstance(node, ast.ExceptHandler):
            continue
        line, end = node.lineno, node.end_lineno
        if node.type is None:
            yield path, "bare-except", line, end, "except", policy.FAIL, "bare except catches everything"
        elif names.is_base(node.type, node):
            yield path, "base-exception", line, end, "except", policy.FAIL, "catches BaseException"
        if len(node.body) == 1 and (isinstance(node.body[0], ast.Pass) or isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and node.body[0].value.value is ...):
            yield path, "swallowed", line, end, "except", policy.FAIL, "handler does nothing"
        if node.name:
            for inner in own_nodes(node):
                if isinstance(inner, ast.Raise) and inner.cause is None and isinstance(inner.exc, ast.Name) and inner.exc.id == node.name:
                    yield path, "lost-traceback", inner.lineno, inner.end_lineno, node.name, policy.WARN, "raise of the caught name loses its traceback"


def rules(path: str, content: str, missing_returns: bool = False) -> list[tuple]:
    """Findings of all rules for one file."""
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError) as error:
        return [(path, "syntax", getattr(error, "lineno", None) or 1, None, path, policy.ERROR, str(error))]
    out: list[tuple] = []
    for node in ast.walk(tree):
        if isinstance(node, FUNCTIONS):
            complexity, nested = 1 + sum(map(weight, ast.walk(node))), depth(node)
            out.append((path, "complexity", node.lineno, node.end_lineno, f"{node.name}()", str(complexity), str(nested)))
            if missing_returns and node.returns is None and not (node.name.startswith("__") and node.name.endswith("__")):
                out.append((path, "missing-return", node.lineno, node.end_lineno, f"{node.name}()", policy.WARN, "no return annotation"))
    for body in statement_lists(tree):
        ended = next((k for k, s in enumerate(body) if isinstance(s, _ENDS)), None)
        if ended is not None and ended + 1 < len(body):
            out.append((path, "unreachable", body[ended + 1].lineno, body[ended + 1].end_lineno, "statement", policy.WARN, "never reached"))
    out += _exception_rows(tree, path)
    out.append((path, "inspected", 1, None, path, policy.PASS, "inspected"))
    return out


def findings(files: DataFrame, warn=15, fail=25, warn_nesting=4, missing_returns: bool = False) -> DataFrame:
    """Findings of (path, content) rows; complexity is judged by its thresholds."""
    columns = [c.split()[0] for c in FINDING.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for path, content in zip(batch["path"], batch["content"]) for row in rules(path, content, missing_returns)]
            yield pd.DataFrame(rows, columns=columns).astype({"end_line": "Int64"})

    found = files.select("path", F.coalesce("content", F.lit("")).alias("content")).mapInPandas(run, FINDING)
    cc, nesting = F.col("status").try_cast("long"), F.col("message").try_cast("long")
    measured = F.col("rule") == "complexity"
    judged: Column = F.when(measured, policy.complexity_status(cc, nesting, warn, fail, warn_nesting)).otherwise(F.col("status"))
    said = F.when(measured, F.format_string("complexity %d, nesting %d", cc, nesting)).otherwise(F.col("message"))
    return found.withColumns({"status": judged, "message": said, "complexity": F.when(measured, cc), "nesting": F.when(measured, nesting)})


def symbol_facts(files: DataFrame) -> DataFrame:
    """(file, kind, name, detail, line) facts for symbol usage.

    kind is def (detail: decorated or empty), ref, qualified, export, or import
    (name: alias, detail: module and imported name with a space between).
    """

    def facts(path: str, content: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError):
            yield path, "error", path, "", 1
            return
        for node in tree.body:
            if isinstance(node, FUNCTIONS):
                yield path, "def", node.name, "decorated" if node.decorator_list else "", node.lineno
            if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
                for item in node.value.elts:
                    if isinstance(item, ast.Constant) and isinstance(item.value, str):
                        yield path, "export", item.value, "", node.lineno
        for node in ast.walk(tree):
            match node:
                case ast.Name(id=name, ctx=ast.Load()):
                    yield path, "ref", name, "", node.lineno
                case ast.Attribute():
                    parts, inner = [], node
                    while isinstance(inner, ast.Attribute):
                        parts.append(inner.attr)
                        inner = inner.value
                    if isinstance(inner, ast.Name):
                        yield path, "qualified", ".".join([inner.id, *reversed(parts)]), "", node.lineno
                case ast.Import(names=names):
                    for alias in names:
                        yield path, "import", alias.asname or alias.name.split(".")[0], f"{alias.name} ", node.lineno
                case ast.ImportFrom(module=module, names=names, level=level):
                    for alias in names:
                        yield path, "import", alias.asname or alias.name, f"{'.' * level}{module or ''} {alias.name}", node.lineno

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([f for path, content in zip(batch["path"], batch["content"]) for f in facts(path, content)], columns=["file", "kind", "name", "detail", "line"])

    return files.select("path", F.coalesce("content", F.lit("")).alias("content")).mapInPandas(run, "file string, kind string, name string, detail string, line long")


def dead_code(files: DataFrame) -> DataFrame:
    """Private functions of Python files with status WARN where nothing refers to them.

    If any file does not parse, only the files that do not are reported.
    """
    facts = stored(symbol_facts(files))
    of = lambda kind: facts.where(F.col("kind") == kind)
    modules = files.select(F.col("path").alias("file"), T.module_name(F.col("path")).alias("module"), F.lit(0).alias("root_rank"))
    here = modules.select("file", F.col("module").alias("here"))
    detail = F.split("detail", " ")
    level = F.length(F.regexp_extract(detail[0], r"^(\.*)", 1))
    bare = F.regexp_replace(detail[0], r"^\.+", "")
    package = F.when(F.endswith("file", F.lit("__init__.py")), F.concat("here", F.lit(".x"))).otherwise(F.col("here"))
    absolute = F.when(level == 0, bare).otherwise(T.resolved_import(F.regexp_replace(package, r"\.?[^.]*$", ""), level, bare))
    imports = of("import").join(here, "file").select("file", F.col("name").alias("alias"), absolute.alias("module"), detail[1].alias("name"))
    refs, qualified = of("ref").select("file", "name"), of("qualified").select("file", F.col("name").alias("ref"))
    keys = symbols.referenced_keys(symbols.first_roots(modules), imports, refs, qualified)
    defs = of("def").select("file", "name", "line", (F.col("detail") == "decorated").alias("decorated"))
    errors = of("error").select("file", "name", "line", F.lit(policy.ERROR).alias("status"))
    return aborting(symbols.private_usage(defs, refs, of("export").select("file", "name"), keys), errors)


def dead_findings(files: DataFrame) -> DataFrame:
    """The whole check: private functions, unreachable statements, and one PASS row for every file with neither.

    (file, name, line, status); files that do not parse silence all others.
    """
    usage = dead_code(files)
    errors = usage.where(F.col("status") == policy.ERROR)
    never = findings(files).where(F.col("rule") == "unreachable").select(F.col("path").alias("file"), F.col("target").alias("name"), F.col("start_line").alias("line"), "status")
    found = usage.where(F.col("status") != policy.ERROR).unionByName(never)
    clean = files.select(F.col("path").alias("file")).join(found.select("file").distinct(), "file", "left_anti")
    rest = clean.select("file", F.lit("inspected").alias("name"), F.lit(1).cast("long").alias("line"), F.lit(policy.PASS).alias("status"))
    return aborting(found.unionByName(rest), errors)


def masked_source(text: str) -> str:
    """C-like source with comments and literals as spaces; length and line ends stay.

    Raw strings end at their own delimiter, and a line comment goes on after a
    backslash at its end.
    """
    out, i, n = list(text), 0, len(text)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] not in "\r\n":
                out[k] = " "

    while i < n:
        two = text[i : i + 2]
        if two == "//":
            end = i
            while end < n and text[end] != "\n":
                end += 2 if text[end] == "\\" and end + 1 < n else 1
        elif two == "/*":
            close = text.find("*/", i + 2)
            end = n if close < 0 else close + 2
        elif two == 'R"' and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] == "_") or text[i - 1] in "uUL8"):
            paren = text.find("(", i + 2)
            if paren < 0 or paren - i - 2 > 16:
                i += 1
                continue
            close = text.find(")" + text[i + 2 : paren] + '"', paren)
            end = n if close < 0 else close + paren - i
        elif text[i] in "\"'" and not (text[i] == "'" and i and text[i - 1].isalnum() and text[i + 1 : i + 2].isalnum() and text[i + 2 : i + 3] != "'"):
            end = i + 1
            while end < n and text[end] not in (text[i], "\n"):
                end += 2 if text[end] == "\\" else 1
            end += 1
        else:
            i += 1
            continue
        blank(i, end)
        i = end
    return "".join(out)


def native_exception_rows(files: DataFrame) -> DataFrame:
    """Empty catch-all handlers of C-like files: (path, start_line, status)."""

    @F.pandas_udf("string")
    def masked(contents: pd.Series) -> pd.Series:
        return contents.fillna("").map(masked_source)

    found = files.select("path", masked("content").alias("m"))
    # Each match closes the text before it, so the pieces' newlines give its line.
    pattern = r"catch\s*\(\s*\.\.\.\s*\)\s*\{\s*\}"
    pieces = F.split("m", pattern, -1)
    before = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.array_join(F.slice(pieces, F.lit(1), k), ""))
    gaps = F.regexp_extract_all("m", F.lit(f"({pattern})"), F.lit(1))
    lines = F.when(F.size(pieces) > 1, F.transform(before, lambda s, k: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit(""))) + F.aggregate(F.slice(gaps, F.lit(1), k), F.lit(0), lambda a, g: a + F.length(g) - F.length(F.replace(g, F.lit("\n"), F.lit("")))) + 1))
    return found.select("path", F.explode(lines).alias("start_line")).select("path", F.col("start_line").cast("long").alias("start_line"), F.lit(policy.FAIL).alias("status"))


_DESTRUCTOR = re.compile(r"~\s*[A-Za-z_]\w*\s*\([^)]*\)[^;{}]*\{")
_THROW = re.compile(r"\bthrow\b")


def throwing_destructors(masked: str) -> list[int]:
    """Lines of throw statements within destructor bodies of masked source."""
    found = []
    for start in _DESTRUCTOR.finditer(masked):
        depth_, at = 1, start.end()
        while at < len(masked) and depth_:
            depth_ += {"{": 1, "}": -1}.get(masked[at], 0)
            at += 1
        found += [masked.count("\n", 0, start.end() + m.start()) + 1 for m in _THROW.finditer(masked[start.end() : at])]
    return sorted(set(found))


def destructor_rows(files: DataFrame) -> DataFrame:
    """Throws in destructors of C-like files: (path, start_line, status)."""

    @F.pandas_udf("array<long>")
    def lines(contents: pd.Series) -> pd.Series:
        return contents.fillna("").map(lambda c: throwing_destructors(masked_source(c)))

    return files.select("path", F.explode(lines("content")).alias("start_line")).withColumn("status", F.lit(policy.FAIL))


def aborting(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """``rows`` unless there is any error; then the errors alone (a run that read only a part says nothing)."""
    failed = errors.select(F.lit(1).alias("__one")).limit(1)
    return rows.withColumn("__one", F.lit(1)).join(failed, "__one", "left_anti").drop("__one").unionByName(errors)
