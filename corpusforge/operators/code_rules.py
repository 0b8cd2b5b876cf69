"""Rules over code: calls found in syntax trees of Python files and in the tokens of JavaScript files, never in their text."""

from __future__ import annotations

import ast
import re
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# The rules, their severities and languages.
CODE_RULES = {
    "python-eval": "high", "python-exec": "high", "python-os-system": "medium", "python-subprocess-shell": "medium", "python-pickle-loads": "medium", "python-yaml-unsafe-load": "medium", "js-eval": "high", "js-child-process": "medium",
}
_CALLS = {"eval": "python-eval", "exec": "python-exec", "os.system": "python-os-system", "pickle.loads": "python-pickle-loads"}


def _full_name(node: ast.expr, names: dict[str, str]) -> str:
    """The dotted name that an expression stands for, by the imports of its file; empty for what isn't a name."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([names.get(node.id, node.id), *reversed(parts)]) if isinstance(node, ast.Name) else ""


def python_calls(text: str) -> list[tuple[str, int]]:
    """(rule, line) of calls that meet a rule; a file that can't be parsed has none."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    nodes = list(ast.walk(tree))
    names: dict[str, str] = {}
    for node in nodes:
        if isinstance(node, ast.Import):
            names |= {a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            names |= {a.asname or a.name: f"{node.module}.{a.name}" for a in node.names}
    found = []
    for call in nodes:
        if not isinstance(call, ast.Call):
            continue
        name = _full_name(call.func, names).removeprefix("builtins.")
        given = {k.arg: k.value for k in call.keywords}
        rule = _CALLS.get(name)
        if name.startswith("subprocess.") and name.count(".") == 1 and isinstance(shell := given.get("shell"), ast.Constant) and shell.value is True:
            rule = "python-subprocess-shell"
        if name == "yaml.load" and _full_name(given.get("Loader", ast.Constant(None)), names) != "yaml.SafeLoader":
            rule = "python-yaml-unsafe-load"
        if rule:
            found.append((rule, call.lineno))
    return sorted(found)


#: Comments, strings, templates, names and other signs of JavaScript, as far as these rules need them.
_JS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|$)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?|`(?:\\.|[^`\\])*`?|[A-Za-z_$][\w$]*|\s+|.", re.S)


def js_calls(text: str) -> list[tuple[str, int]]:
    """(rule, line) of calls of eval and of exec and execSync of child_process, under any name that it is required or imported as."""
    tokens, line = [], 1
    for m in _JS.finditer(text):
        if not m[0].isspace() and not m[0].startswith(("//", "/*")):
            tokens.append((m[0], line))
        line += m[0].count("\n")
    words = [t for t, _ in tokens]
    module = ("'child_process'", '"child_process"', "'node:child_process'", '"node:child_process"')
    held = {"child_process"}
    for i, word in enumerate(words):
        if word in module:
            if words[max(0, i - 4) : i][1:] == ["=", "require", "("]:
                held.add(words[i - 4])
            elif i >= 2 and words[i - 1] == "from":
                held.add(words[i - 2])
    found = []
    for i, (word, at) in enumerate(tokens):
        called = words[i + 1 : i + 2] == ["("]
        if word == "eval" and called and (i == 0 or words[i - 1] not in (".", "function")):
            found.append(("js-eval", at))
        if word in ("exec", "execSync") and called and i >= 2 and words[i - 1] == "." and words[i - 2] in held and (i < 3 or words[i - 3] != "."):
            found.append(("js-child-process", at))
    return found


_HIT = StructType().add("rule", StringType()).add("line_no", IntegerType())


@F.pandas_udf(ArrayType(_HIT))
def _calls(python: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([[{"rule": r, "line_no": n} for r, n in (python_calls if p else js_calls)(t or "")] for p, t in zip(python, texts)])


def code_findings(texts: DataFrame) -> DataFrame:
    """Findings (bundle_id, rule_id, category, severity, locus, message) of files (bundle_id, path, text) of Python, JavaScript and
    TypeScript. Only files with a word that some rule needs go to Python. Null and empty texts have none."""
    name = F.lower("path")
    python, script = name.endswith(".py"), name.rlike(r"\.(js|mjs|cjs|jsx|ts|tsx)$")
    hint = F.when(python, F.col("text").rlike(r"eval|exec|system|subprocess|loads|yaml|import")).otherwise(F.col("text").rlike(r"eval|exec"))
    hit = texts.filter((python | script) & hint).select("bundle_id", "path", F.explode(_calls(python, F.col("text"))).alias("hit"))
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in CODE_RULES.items() for x in kv]), F.col("hit.rule"))
    return hit.select("bundle_id", F.concat(F.lit("code:"), "hit.rule").alias("rule_id"), F.lit("malicious-code").alias("category"), severity.alias("severity"), F.concat_ws(":", "path", "hit.line_no").alias("locus"), F.lit("a call that runs what it is given").alias("message"))
