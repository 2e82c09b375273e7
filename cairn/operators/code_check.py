"""Static check of code in a column [N11]: it is parsed, never run."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: what code may not import, call or reach ------------------------------------------------------------
MODULES = frozenset(
    "socket ssl http urllib urllib2 urllib3 requests httpx aiohttp ftplib smtplib poplib imaplib telnetlib xmlrpc asyncio subprocess multiprocessing ctypes cffi pty signal "
    "socketserver webbrowser importlib pkgutil runpy gc atexit".split()
)
BUILTINS = frozenset("eval exec compile __import__ globals locals vars breakpoint".split())
CALLS = frozenset("system popen spawn spawnl spawnv execv execve execl fork forkpty kill setuid setgid".split())
DUNDERS = frozenset("__name__ __doc__ __file__ __dict__ __len__".split())

RESULT = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("violations", T.ArrayType(T.StringType())), T.StructField("imports", T.ArrayType(T.StringType()))])


def inspected(code: str) -> tuple[bool, list[str], list[str]]:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError) as e:
        return False, [f"line {getattr(e, 'lineno', 0)}: syntax error"], []
    bad: list[tuple[int, str]] = []
    imports: set[str] = set()
    for node in ast.walk(tree):
        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        imports.update(names)
        bad += [(node.lineno, f"import of {n}") for n in names if n.split(".")[0] in MODULES]
        if isinstance(node, ast.Call):
            called = node.func
            if isinstance(called, ast.Name) and called.id in BUILTINS:
                bad.append((node.lineno, f"call of {called.id}"))
            if isinstance(called, ast.Attribute) and called.attr in CALLS:
                bad.append((node.lineno, f"call of .{called.attr}"))
        if isinstance(node, ast.Attribute) and node.attr.startswith("__") and node.attr.endswith("__") and node.attr not in DUNDERS:
            bad.append((node.lineno, f"access to {node.attr}"))
    return not bad, [f"line {n}: {what}" for n, what in sorted(bad)], sorted(imports)


@F.pandas_udf(RESULT)
def code_check(code: pd.Series) -> pd.DataFrame:
    """struct<ok, violations, imports> of each text, in Arrow batches: no built-in parses Python."""
    return pd.DataFrame([inspected(c or "") for c in code], columns=["ok", "violations", "imports"])
