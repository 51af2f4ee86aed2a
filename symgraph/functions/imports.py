"""Imports declared in source text, as arrays of (alias, path)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_REFS = "array<struct<alias:string,path:string>>"


@dataclass(frozen=True)
class Form:
    """A form of import statement: its languages, a pattern of two groups, and the refs of one match."""

    languages: tuple[str, ...]
    pattern: str
    refs: Callable[[Column, Column], Column]


def _ref(alias: Column, path: Column) -> Column:
    return F.struct(alias.alias("alias"), path.alias("path"))


def _aliased(separator: str) -> Callable[[Column, Column], Column]:
    """An alias, or the path's last part where there is none."""
    return lambda alias, path: F.array(_ref(F.when(alias == "", F.substring_index(path, separator, -1)).otherwise(alias), path))


def _named(join: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """A list of ``name`` or ``name as alias`` taken from a path; blanks and ``*`` say nothing."""

    def refs(path: Column, names: Column) -> Column:
        items = F.transform(F.split(names, ","), lambda x: F.split(F.btrim(x, F.lit("() \t\r\n")), " as ", 2))
        told = F.filter(items, lambda x: ~F.trim(x[0]).isin("", "*"))
        return F.transform(told, lambda x: _ref(F.trim(F.element_at(x, -1)), join(path, F.trim(x[0]))))

    return refs


_one = lambda alias, path: F.array(_ref(alias, path))
_swapped = lambda make: lambda a, b: make(b, a)

# The patterns are fixed values: what they match must be what other tools of this kind match.
FORMS = (
    Form(("go",), r'(?m)^\s*(?:(\w+)\s+)?"([^"]+)"\s*$', _aliased("/")),
    Form(("typescript", "javascript"), r"""import\s+\*\s+as\s+(\w+)\s+from\s+["'`]([^"'`]+)["'`]""", _one),
    Form(("typescript", "javascript"), r"""import\s+(\w+)\s*(?:,\s*\{[^}]*\})?\s+from\s+["'`]([^"'`]+)["'`]""", _one),
    Form(("typescript", "javascript"), r"""import\s+\{([^}]*)\}\s+from\s+["'`]([^"'`]+)["'`]""", _swapped(_named(lambda path, _: path))),
    Form(("python",), r"(?m)^\s*import\s+([\w.]+)(?:\s+as\s+(\w+))?", _swapped(_aliased("."))),
    Form(("python",), r"(?m)^\s*from\s+([\w.]+)\s+import\s+(.+)$", _named(lambda path, name: F.concat_ws(".", path, name))),
)


def _matches(form: Form, source: Column) -> Column:
    groups = [F.regexp_extract_all(source, F.lit(form.pattern), F.lit(g)) for g in (1, 2)]
    return F.flatten(F.zip_with(*groups, form.refs))


def extract_imports(language: Column, source: Column) -> Column:
    """``array<struct<alias, path>>`` in order of appearance within each form of statement.

    Imports for their side effects only (``_`` and ``.`` in place of an alias) are left out.
    """
    out = F.array().cast(_REFS)
    for spoken in dict.fromkeys(f.languages for f in FORMS):
        parts = [_matches(f, source) for f in FORMS if f.languages == spoken]
        out = F.when(language.isin(*spoken), F.concat(*parts).cast(_REFS)).otherwise(out)
    return F.filter(out, lambda r: ~r["alias"].isin("_", "."))


def local_import_candidates(language: Column, folder: Column, path: Column, module: Column) -> Column:
    """The folder an import would be in if it is of this code base; null if it cannot be."""
    inside = F.when(path == module, ".").when(path.startswith(F.concat(module, F.lit("/"))), F.substr(path, F.length(module) + 2))
    dotted = F.replace(path, F.lit("."), F.lit("/"))
    joined = F.when(folder == ".", path).otherwise(F.concat_ws("/", folder, path))
    relative = F.when(path.startswith("."), _clean(joined))
    return F.when(language == "go", F.when(module != "", inside)).when(language == "python", dotted).when(language.isin("typescript", "javascript"), relative)


def _clean(path: Column) -> Column:
    """``.`` and ``..`` segments resolved."""
    return F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s.isin("", "."), done)
        .when((s == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
        lambda done: F.array_join(done, "/"),
    )
