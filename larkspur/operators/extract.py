"""A pattern-based code model: symbols and relations of JavaScript-like sources, one file at a time.

A file is read line by line with a stack of the classes and functions that its braces open. Strings and comments
are blanked first, so they create nothing. What the patterns find is a candidate, not a proof. Unbalanced braces
make a file's status partial; its rows stay, with a diagnostic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "file string, status string, diagnostic string, row string, kind string, owner string, name string, target string, source string, line int"
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
_CLASS = re.compile(r"\bclass\s+(\w+)(?:\s+extends\s+([\w.]+))?")
_FUNCTION = re.compile(r"\bfunction\s+(\w+)\s*\(([^)]*)\)")
_METHOD = re.compile(r"^\s*(?:async\s+|static\s+)?(\w+)\s*\(([^)]*)\)\s*\{")
_PROTOTYPE = re.compile(r"\b(\w+)\.prototype\.(\w+)\s*=\s*function\s*\(([^)]*)\)")
_VARIABLE = re.compile(r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:new\s+([\w.]+))?")
_IMPORT = re.compile(r"^\s*import\s+(?:\{?\s*([\w,\s*]+?)\s*\}?\s+from\s+)?(['\"])")
_EXPORT = re.compile(r"^\s*export\s+(?:default\s+)?(?:class|function|const|let)?\s*(\w+)")
_WRITE = re.compile(r"\b([\w.]+)\.(\w+)\s*=(?![=>])\s*(new\s+)?([\w.]+)?")
_COMPUTED = re.compile(r"\b([\w.]+)\[[^\]]+\]\s*=(?!=)")
_STORE = re.compile(r"\b([\w.]+)\.(push|add|set)\(\s*(?:new\s+)?([\w.]+)?")
_NEW = re.compile(r"\bnew\s+([\w.]+)\s*\(")
_CALL = re.compile(r"\b((?:\w+\.)*\w+)\s*\(")
_READ = re.compile(r"\b(this)\.(\w+)\b(?!\s*(?:=(?!=)|\())")
_WORDS = frozenset("if for while switch catch return function constructor super new typeof await import".split())


def extract(file: str, text: str | None) -> list[tuple]:
    """Rows of SCHEMA for one source."""
    source = text or ""
    quiet = _NOISE.sub(lambda m: re.sub(r"[^\n'\"`]", " ", m[0]), source)
    rows: list[tuple] = []
    stack: list[tuple[str, str, int, tuple[str, ...]]] = []  # kind, name, depth, parameters
    depth = 0
    wrong = ""

    def put(row: str, kind: str, owner: str | None, name: str | None, target: str | None, line: int) -> None:
        rows.append((row, kind, owner, name, target, ".".join(s[1] for s in stack) or "module", line))

    for number, line in enumerate(quiet.split("\n"), 1):
        inside = next((s[1] for s in reversed(stack) if s[0] == "class"), None)
        opened: tuple[str, str, tuple[str, ...]] | None = None
        if m := _IMPORT.match(line):
            for name in (m[1] or "module").split(","):
                put("relation", "import", "module", name.strip(), None, number)
        if m := _EXPORT.match(line):
            put("relation", "export", "module", m[1], None, number)
        if m := _CLASS.search(line):
            put("symbol", "class", None, m[1], m[2], number)
            opened = ("class", m[1], ())
        elif m := _PROTOTYPE.search(line):
            put("symbol", "prototype-method", m[1], m[2], None, number)
            opened = ("function", f"{m[1]}.{m[2]}", tuple(re.findall(r"\w+", m[3])))
        elif m := _FUNCTION.search(line):
            put("symbol", "function", None, m[1], None, number)
            opened = ("function", m[1], tuple(re.findall(r"\w+", m[2])))
        elif inside and stack[-1][0] == "class" and (m := _METHOD.match(line)) and m[1] not in _WORDS - {"constructor"}:
            put("symbol", "class-method", inside, m[1], None, number)
            opened = ("function", m[1], tuple(re.findall(r"\w+", m[2])))
        if m := _VARIABLE.search(line):
            put("symbol", "variable", inside, m[1], m[2], number)
        body = line[m.end() :] if opened and (m := re.search(r"\{", line)) else line if not opened else ""
        given = opened[2] if opened and opened[0] == "function" else next((s[3] for s in reversed(stack) if s[0] == "function"), ())
        own = opened[1] if opened and opened[0] == "class" else inside
        for m in _WRITE.finditer(body):
            owner = own if m[1] == "this" else m[1]
            kind = "parameter-to-field" if m[4] in given and not m[3] else "field-write"
            put("relation", kind, owner, m[2], m[4], number)
        for m in _COMPUTED.finditer(body):
            put("relation", "computed-write", m[1].replace("this", own or "this"), None, None, number)
        for m in _STORE.finditer(body):
            put("relation", f"collection-{m[2]}", m[1].replace("this", own or "this"), None, m[3], number)
        for m in _NEW.finditer(body):
            put("relation", "construct", own, None, m[1], number)
        for m in _CALL.finditer(body):
            last = m[1].split(".")[-1]
            if last not in _WORDS and last not in ("push", "add", "set") and not body[: m.start()].rstrip().endswith(("new", "function")):
                put("relation", "call", own, None, m[1].replace("this", own or "this"), number)
        for m in _READ.finditer(body):
            put("relation", "field-read", own, m[2], None, number)
        for c in line:
            if c == "{":
                if opened:
                    stack.append((opened[0], opened[1], depth, opened[2]))
                    opened = None
                depth += 1
            elif c == "}":
                depth -= 1
                while stack and stack[-1][2] >= depth:
                    stack.pop()
    if depth:
        wrong = f"unbalanced braces: {depth}"
    status = "partial" if wrong else "candidate"
    out = [(file, status, wrong or None, *r) for r in rows]
    return out or [(file, status, wrong or None, "file", "empty", None, None, None, None, 0)]


def code_rows(files: DataFrame, file: str, text: str) -> DataFrame:
    """Symbols and relations of every file: filter the files first, as no predicate passes a Python function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            yield pd.DataFrame([r for f, t in zip(b["file"], b["text"], strict=True) for r in extract(f, t)], columns=names)

    return files.select(F.col(file).alias("file"), F.col(text).alias("text")).mapInPandas(run, SCHEMA)
