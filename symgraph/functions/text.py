"""Column functions over symbol text: identity, normalisation, chunking, tokens, rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names before a parenthesis that are not calls (fixed values).
CALL_KEYWORDS = [
    "if", "for", "switch", "select", "func", "make", "append", "len", "cap",
    "new", "delete", "close", "panic", "recover", "print", "println",
]

#: Characters that outer trimming removes (Unicode white space).
_WHITE = r"[\t-\r \u0085   -     　]"

_CALL = r"(?<![A-Za-z0-9_])([A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)?)[\t\n\f\r ]*\("


def normalize_content(text: Column) -> Column:
    """No trailing blanks on lines, runs of blank lines collapsed to one, outer white space trimmed."""
    stripped = F.regexp_replace(text, r"[ \t]+(?=\n|\z)", "")
    collapsed = F.regexp_replace(stripped, r"\n{3,}", "\n\n")
    return F.regexp_replace(collapsed, rf"\A{_WHITE}+|{_WHITE}+\z", "")


def chunk_id(branch: Column, symbol: Column, number: Column) -> Column:
    """SHA-256 of branch, symbol and chunk number, NUL between them."""
    nul = F.char(F.lit(0))
    return F.sha2(F.concat(branch, nul, symbol, nul, number.cast("string")), 256)


def storage_uuid(identity: Column) -> Column:
    """The first 32 hex digits as 8-4-4-4-12, padded with zeros when there are fewer."""
    padded = F.rpad(F.left(identity, F.lit(32)), 32, "0")
    parts = [F.substring(padded, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def content_hash(text: Column) -> Column:
    """Hash of normalised content; only its equality carries meaning."""
    return F.sha2(normalize_content(text), 256)


def embed_char_budget(tokens: int) -> int:
    """Code points that an embedding input may have: tokens (8192 if not positive) * 3 * 0.8."""
    return int((tokens if tokens > 0 else 8192) * 3.0 * 0.8)


def embed_header(
    symbol: Column, kind: Column, language: Column, summary: Column, context: Column, duties: Column, calls: Column, tags: Column
) -> Column:
    """What precedes the code in an embedding input; null parts read as empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    listed = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    return F.format_string(
        "%s [%s] in %s\nDoes: %s\nServes: %s\nDuties: %s\nUses: %s\nTopics: %s\n\n",
        text(symbol), text(kind), text(language), text(summary), text(context), listed(duties), listed(calls), listed(tags),
    )


def embed_chunks(header: Column, body: Column, budget: int) -> Column:
    """``array<struct<text, content>>``: the whole body, or slices that leave room for the header.

    A slice has ``budget`` less the header, but a quarter of the budget at least. There is
    always one chunk, also of an empty body.
    """
    whole = F.array(F.struct(F.concat(header, body).alias("text"), body.alias("content")))
    if budget <= 0:
        return whole
    width = F.greatest(F.lit(budget) - F.length(header), F.lit(max(budget // 4, 1)))
    slices = F.greatest(F.ceil(F.length(body) / width).cast("int"), F.lit(1))
    cut = F.transform(
        F.sequence(F.lit(0), slices - 1),
        lambda i: F.struct(
            F.concat(header, F.substring(body, i * width + 1, width)).alias("text"),
            F.substring(body, i * width + 1, width).alias("content"),
        ),
    )
    return F.when(F.length(header) + F.length(body) <= budget, whole).otherwise(cut)


def cap_chars(text: Column, limit: int) -> Column:
    """At most ``limit`` code points; all of them where the limit is not positive."""
    return F.left(text, F.lit(limit)) if limit > 0 else text


def clip_summary(text: Column, limit: int = 160) -> Column:
    """The first line, trimmed, cut to ``limit`` code points and an ellipsis."""
    line = F.trim(F.split(F.trim(text), "\n", 2)[0])
    return F.when(F.length(line) > limit, F.concat(F.left(line, F.lit(limit)), F.lit("…"))).otherwise(line)


def bare_name(symbol: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(symbol, ".", -1)


def receiver_name(symbol: Column) -> Column:
    """What precedes the last dot; empty without one."""
    return F.regexp_extract(symbol, r"^(.*)\.[^.]*$", 1)


def qualified_name(receiver: Column, name: Column) -> Column:
    return F.when(F.coalesce(receiver, F.lit("")) == "", name).otherwise(F.concat_ws(".", receiver, name))


def package_dir(path: Column) -> Column:
    """The folder of a file; ``.`` at the root."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(folder == "", ".").otherwise(folder)


def extract_calls(source: Column) -> Column:
    """Distinct called names in order of appearance, keywords dropped."""
    found = F.regexp_extract_all(source, F.lit(_CALL), F.lit(1))
    return F.array_distinct(F.filter(found, lambda c: ~c.isin(CALL_KEYWORDS) & ~bare_name(c).isin(CALL_KEYWORDS)))


def query_identifiers(query: Column, least: int = 3) -> Column:
    """Distinct identifier-like tokens of a query, in order of appearance."""
    found = F.regexp_extract_all(query, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= least))


def instructed_query(query: Column, instruction: str) -> Column:
    if not instruction:
        return query
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), query)


def branch_token(branch: Column) -> Column:
    """A branch as a folder name: other characters as underscores, plus eight digits of its hash."""
    safe = F.regexp_replace(branch, "[^A-Za-z0-9.-]", "_")
    return F.when(F.coalesce(branch, F.lit("")) == "", "_detached").otherwise(F.concat_ws("-", safe, F.left(F.sha2(branch, 256), F.lit(8))))


def definition_note(summary: Column, file: Column, line: Column) -> Column:
    """A symbol's summary and where it is defined."""
    place = F.format_string("%s:%d", file, line)
    return F.when(F.coalesce(summary, F.lit("")) == "", place).otherwise(F.concat_ws(" @ ", summary, place))


def edges_block(outgoing: Column, incoming: Column) -> Column:
    """Capped edge lists (arrays of struct(kind, other)), a line for each edge, outgoing ones first."""
    drawn = lambda arrow: lambda e: F.concat_ws(" ", e["kind"], F.lit(arrow), e["other"])
    return F.array_join(F.concat(F.transform(outgoing, drawn("\u2192")), F.transform(incoming, drawn("\u2190"))), "\n")


def result_text(number: Column, score: Column, symbol: Column, kind: Column, file: Column, branch: Column, chunk: Column, chunks: Column, purpose: Column, code: Column, lines: int = 20) -> Column:
    """A search hit for people: names, the fragment where there are several, and its first lines."""
    split = F.split(code, "\n", lines + 2)
    body = F.array_join(F.transform(F.slice(split, 1, lines), lambda x: F.concat(F.lit("    "), x)), "\n")
    told = lambda c, *shape: F.when(F.coalesce(c, F.lit("")) != "", F.format_string(*shape))
    return F.concat_ws(
        "\n",
        F.format_string("%d. %s (%s) in %s, score %.2f", number, symbol, kind, file, score),
        told(branch, "   on branch %s", branch),
        F.when(chunks > 1, F.format_string("   best of its parts: %d of %d", chunk + 1, chunks)),
        told(purpose, "   %s", purpose),
        F.when(F.coalesce(code, F.lit("")) != "", body),
        F.when(F.size(split) > lines, "    (more lines)"),
    )


def parse_reply(reply: Column) -> Column:
    """An enrichment reply's four JSON fields; if it is not JSON, all of it is the summary."""
    kind = "summary string, tags array<string>, responsibilities array<string>, business_context string, businessContext string"
    parsed = F.from_json(reply, kind)
    context = F.coalesce(parsed["business_context"], parsed["businessContext"])
    broken = parsed.isNull() | (parsed["summary"].isNull() & parsed["tags"].isNull() & parsed["responsibilities"].isNull() & context.isNull())
    nothing = F.array().cast("array<string>")
    return F.struct(
        F.when(broken, F.trim(reply)).otherwise(F.coalesce(parsed["summary"], F.lit(""))).alias("summary"),
        F.when(broken, nothing).otherwise(F.coalesce(parsed["tags"], nothing)).alias("tags"),
        F.when(broken, nothing).otherwise(F.coalesce(parsed["responsibilities"], nothing)).alias("responsibilities"),
        F.when(broken, F.lit("")).otherwise(F.coalesce(context, F.lit(""))).alias("business_context"),
    )


def sync_line(files: Column, chunks: Column, removed: Column) -> Column:
    return F.format_string("%d files changed, %d chunks embedded, %d removed", files, chunks, removed)


def summary_prompt(symbol: Column, kind: Column, language: Column, code: Column, overview: Column) -> Column:
    """What a model is asked about a symbol; ``overview`` tells it what the project is for."""
    about = F.when(F.trim(F.coalesce(overview, F.lit(""))) != "", F.format_string("The project, as background only:\n%s\n\n", overview)).otherwise("")
    asked = (
        "Document the code below. Reply with one JSON object and nothing else. Its fields: "
        '"summary" (what the code takes, does and gives, in at most 200 characters), "tags" (3 to 6 lower-case keywords), '
        '"business_context" (a sentence on what it is for), "responsibilities" (1 to 4 short phrases).\n\n'
    )
    return F.concat(F.lit(asked), about, F.format_string("%s %s in %s:\n%s", kind, symbol, language, code))


def readme_prompt(project: Column, languages: Column, source: Column) -> Column:
    """What a model is asked for a project's README."""
    asked = (
        "Write a README in Markdown for the project %s, for readers who do not know code: what it is for, which problems it "
        "solves, what one can do with it. Name the main technical choices at most. No code, no names of files or functions, "
        "no introduction. Languages: %s. Its source, as evidence only:\n%s"
    )
    return F.format_string(asked, project, F.array_join(languages, ", "), source)
