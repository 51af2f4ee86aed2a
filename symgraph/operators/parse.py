"""Symbols of source files, by a registry of parsers that run on the executors.

Python is parsed by its own grammar. The other languages are scanned: comments and strings
are blanked (offsets stay), declarations are found by pattern, and bodies by matching
braces. A parser takes source text and gives ``(type, name, receiver, start, end)`` by
offsets; ``register_parser`` replaces or adds one.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.paths import detect_language, stored_language
from symgraph.functions.text import extract_calls, qualified_name

Found = tuple[str, str, str, int, int]
Parser = Callable[[str], Iterable[Found]]


def parse_python(source: str) -> Iterator[Found]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    starts = [0]
    for line in source.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))

    def offset(line: int, column: int) -> int:
        text = source[starts[line - 1] : starts[line]]
        return starts[line - 1] + len(text.encode()[:column].decode(errors="ignore"))

    def visit(node: ast.AST, owner: str) -> Iterator[Found]:
        for child in ast.iter_child_nodes(node):
            name = owner
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                place = offset(child.lineno, child.col_offset), offset(child.end_lineno, child.end_col_offset)
                if isinstance(child, ast.ClassDef):
                    yield "class", child.name, "", *place
                    name = child.name
                else:
                    yield ("method" if owner else "function"), child.name, owner, *place
            yield from visit(child, name)

    yield from visit(tree, "")


_BLANKED = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n]){0,80}\'', re.S)
_BLANKED_RUST = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|\'(?:\\.[^\']{0,8}|[^\'\\\n])\'', re.S)


def blanked(source: str, rust: bool = False) -> str:
    """The source with comments and strings as spaces, line breaks kept."""
    return (_BLANKED_RUST if rust else _BLANKED).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def closing(text: str, at: int, pair: str = "{}") -> int:
    """The offset after the bracket that closes the one at ``at``; -1 if none does."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.end()
    return -1


def _body(text: str, at: int) -> tuple[int, int] | None:
    """The braces of a declaration whose head ends before ``at``, if they come before a semicolon."""
    m = re.compile(r"[{;]").search(text, at)
    if not m or m[0] == ";":
        return None
    end = closing(text, m.start())
    return (m.start(), end) if end > 0 else None


def _go_body(text: str, at: int) -> tuple[int, int] | None:
    """The body of a Go function whose parameters begin at ``at``; result types may hold braces."""
    after = closing(text, at, "()")
    if after < 0:
        return None
    for m in re.compile(r"[{\n]").finditer(text, after):
        if m[0] == "\n":
            return None
        if re.search(r"\b(?:interface|struct)\s*$", text[after : m.start()]):
            inner = closing(text, m.start())
            rest = re.compile(r"[^\n{]*\{").match(text, inner)
            return (rest.end() - 1, closing(text, rest.end() - 1)) if rest else None
        end = closing(text, m.start())
        return (m.start(), end) if end > 0 else None
    return None


def parse_go(source: str) -> Iterator[Found]:
    text = blanked(source)
    for m in re.finditer(r"^func\s+(?:\(([^)]*)\)\s*)?(\w+)\s*(?:\[[^\]]*\]\s*)?(?=\()", text, re.M):
        body = _go_body(text, m.end())
        if body:
            receiver = re.sub(r"\[.*", "", (m[1] or "").split()[-1].lstrip("*")) if (m[1] or "").strip() else ""
            yield ("method" if receiver else "function"), m[2], receiver, m.start(), body[1]
    for m in re.finditer(r"^type\s+(?:\(\s*)?(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\s*\{", text, re.M):
        grouped = re.match(r"type\s+\(", text[m.start() :])
        end = closing(text, m.start() + grouped.end() - 1, "()") if grouped else closing(text, m.end() - 1)
        if end > 0:
            yield m[2], m[1], "", m.start(), end
    for m in re.finditer(r"^const\s+(?:(\(\s*)(\w+)|(\w+)[^\n]*)", text, re.M):
        end = closing(text, m.start(1), "()") if m[1] else m.end()
        if end > 0:
            yield "const", m[2] or m[3], "", m.start(), end


def _classes(text: str, head: str, kinds: dict[str, str]) -> list[tuple[str, str, int, int, int]]:
    out = []
    for m in re.finditer(head, text, re.M):
        body = _body(text, m.end())
        if body:
            out.append((kinds[m["kind"]], m["name"], m.start("at"), body[0], body[1]))
    return out


def _owner(classes: list[tuple[str, str, int, int, int]], at: int) -> str:
    inside = [c for c in classes if c[3] < at < c[4]]
    return max(inside, key=lambda c: c[3])[1] if inside else ""


_NOT_METHODS = "if|for|while|switch|catch|return|function|else|do|new|with|synchronized|try"


def _script(typed: bool) -> Parser:
    kinds = {"class": "class"} | ({"interface": "interface"} if typed else {})

    def parse(source: str) -> Iterator[Found]:
        text = blanked(source)
        classes = _classes(text, rf"(?P<at>\b(?:abstract\s+)?(?P<kind>{'|'.join(kinds)})\s+(?P<name>[\w$]+))[^{{;()]*(?=\{{)", kinds)
        for kind, name, start, _, end in classes:
            yield kind, name, "", start, end
        for m in re.finditer(r"\b(?:async\s+)?function\s*\*?\s*([\w$]+)\s*(?:<[^>]*>\s*)?(?=\()", text):
            after = closing(text, m.end(), "()")
            body = _body(text, after) if after > 0 else None
            if body:
                yield "function", m[1], "", m.start(), body[1]
        for m in re.finditer(r"\b(?:const|let)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)(?:\s*:[^=]+?)?|[\w$]+)\s*=>\s*", text):
            brace = text[m.end() : m.end() + 1] == "{"
            end = closing(text, m.end()) if brace else re.compile(r"[;\n]|\Z").search(text, m.end()).start()
            if end > 0:
                owner = _owner([c for c in classes if c[0] == "class"], m.start())
                yield ("method" if owner else "function"), m[1], owner, m.start(), end
        for m in re.finditer(rf"^[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*(?!(?:{_NOT_METHODS})\b)(#?[\w$]+)\s*(?:<[^>]*>\s*)?(?=\()", text, re.M):
            owner = _owner([c for c in classes if c[0] == "class"], m.start(1))
            after = closing(text, m.end(), "()")
            tail = re.compile(r"\s*(?::[^;{=]+)?(?=\{)").match(text, after) if owner and after > 0 else None
            if tail:
                yield "method", m[1], owner, m.start() + len(m[0]) - len(m[0].lstrip()), closing(text, tail.end())

    return parse


def parse_java(source: str) -> Iterator[Found]:
    text = blanked(source)
    classes = _classes(text, r"(?P<at>\b(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?P<kind>class|interface)\s+(?P<name>\w+))[^{;]*(?=\{)", {"class": "class", "interface": "interface"})
    for kind, name, start, _, end in classes:
        yield kind, name, "", start, end
    for m in re.finditer(rf"(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*(?:<[^>]+>\s*)?\b(?!(?:{_NOT_METHODS}|throw|case)\b)[\w.$]+(?:<[^;{{}}()]*>)?(?:\[\])*\s+(?!(?:{_NOT_METHODS})\b)(\w+)\s*(?=\()", text):
        after = closing(text, m.end(), "()")
        tail = re.compile(r"\s*(?:throws[\w\s,.]+)?(?=\{)").match(text, after) if after > 0 else None
        if tail:
            yield "method" if _owner(classes, m.start()) else "function", m[1], _owner(classes, m.start()), m.start(), closing(text, tail.end())


def parse_rust(source: str) -> Iterator[Found]:
    text = blanked(source, rust=True)
    for m in re.finditer(r"\b(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe)\s+)*fn\s+(\w+)\s*(?:<[^()]*>\s*)?(?=\()", text):
        after = closing(text, m.end(), "()")
        body = _body(text, after) if after > 0 else None
        if body:
            yield "function", m[1], "", m.start(), body[1]
    for m in re.finditer(r"\b(?:pub(?:\([^)]*\))?\s+)?(struct|enum|trait)\s+(\w+)", text):
        tuple_ = re.compile(r"\s*(?:<[^>]*>)?\s*(?=\()").match(text, m.end()) if m[1] == "struct" else None
        body = (0, closing(text, tuple_.end(), "()")) if tuple_ else _body(text, m.end())
        if body and body[1] > 0:
            yield m[1], m[2], "", m.start(), body[1]


_parsers: dict[str, Parser] = {
    "python": parse_python,
    "go": parse_go,
    "typescript": _script(True),
    "javascript": _script(False),
    "java": parse_java,
    "rust": parse_rust,
}


def register_parser(language: str, parser: Parser) -> None:
    _parsers[language] = parser


def extract_symbols(files: DataFrame, least_lines: int = 3, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """``(file, symbol, type, lang, language, content, line, calls)`` of ``files(path, content)``.

    The first symbol found at an offset counts; those of fewer than ``least_lines`` lines do
    not. Files of languages without a parser give none.
    """
    chosen = dict(_parsers) if parsers is None else parsers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, language, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seen: set[int] = set()
                for kind, name, receiver, start, end in chosen[language](source or "") if language in chosen else ():
                    content = source[start:end]
                    if end <= start or start in seen or content.count("\n") + 1 < least_lines:
                        continue
                    seen.add(start)
                    rows.append((path, language, kind, name, receiver, content, source.count("\n", 0, start) + 1))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string()] * 6 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "lang", "type", "name", "receiver", "content", "line"])

    source = files.select("path", detect_language(F.col("path")).alias("lang"), "content").where("lang <> ''")
    found = source.mapInArrow(run, "file string, lang string, type string, name string, receiver string, content string, line int")
    return found.select(
        "file",
        qualified_name(F.col("receiver"), F.col("name")).alias("symbol"),
        "type",
        "lang",
        stored_language(F.col("file")).alias("language"),
        "content",
        "line",
        extract_calls(F.col("content")).alias("calls"),
    )
