"""URL filters: pattern rules indexed by their rarest literal token.

Rules are lines of a filter syntax over the lower-cased URL:

- ``||`` at the beginning: where the host or one of its labels begins; ``|`` at either end:
  the URL begins or ends there;
- ``*``: any characters; ``^``: one character that is no letter or digit, or an end of the URL;
- ``@@`` before a rule makes it an exception, which wins over blocking rules;
- ``/.../`` is a regular expression; lines beginning with ``!`` and blank lines say nothing.

A rule's literal tokens are the runs of letters and digits in its pattern that something
bounds on both sides, so that every URL it fits has them as whole tokens. Token frequencies
are counted over all URLs, each rule is filed under its rarest token, and a URL fetches, by
its own tokens, the few candidate rules whose expressions are then run. A rule without a
literal token is a candidate for every URL. Host rules are filed the same way, under the
rarest label of their host.

Rules are dealt with in blocks of ``BLOCK_RULES``, each broadcast to one pass over the URLs,
so there may be any number of them. No row is moved between tasks; what the driver gathers is
a count for each token of a block's rules.

Defined cases: a null URL, or one without ``://``, has an empty host and path; no host rule
fits it, and pattern rules see an empty string for null. Repeated rows are judged one by
one. Columns are ignored unless listed in ``keep``, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules broadcast together (under a kilobyte each).
BLOCK_RULES = 50_000

_TOKEN = re.compile(r"[a-z0-9]+")
_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_EDGE = "(?:[^a-z0-9]|^|$)"


def _quoted(text: str) -> str:
    return re.sub(r"([^a-z0-9 /])", r"\\\1", text)


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> tuple[str, ...]:
        return tuple(_TOKEN.findall(self.host))

    def fits(self, host: str, path: str) -> bool:
        return (host == self.host or host.endswith("." + self.host)) and path.startswith(self.path)


@dataclass(frozen=True)
class PatternRule:
    """A line of the filter syntax."""

    line: str

    @property
    def action(self) -> str:
        return "allow" if self.line.startswith("@@") else "block"

    @property
    def name(self) -> str:
        return self.line

    @cached_property
    def _body(self) -> str:
        return self.line.removeprefix("@@").lower()

    @cached_property
    def _is_expression(self) -> bool:
        return len(self._body) > 2 and self._body[0] == self._body[-1] == "/"

    @cached_property
    def pattern(self) -> str:
        """The regular expression, for any of the usual dialects."""
        if self._is_expression:
            return self._body[1:-1]
        body, head, tail = self._body, "", ""
        if body.startswith("||"):
            head, body = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", body[2:]
        elif body.startswith("|"):
            head, body = "^", body[1:]
        if body.endswith("|"):
            tail, body = "$", body[:-1]
        parts = {"*": ".*", "^": _EDGE}
        return head + "".join(parts.get(x) or _quoted(x) for x in re.findall(r"\*+|\^|[^*^]+", re.sub(r"\*+", "*", body))) + tail

    @cached_property
    def tokens(self) -> tuple[str, ...]:
        if self._is_expression:
            return ()
        body = self._body
        begins = body.startswith("|")
        ends = body.endswith("|") and len(body) > 1
        body = body.removeprefix("||") if body.startswith("||") else body.removeprefix("|")
        body = body.removesuffix("|")
        found = []
        for m in _TOKEN.finditer(body):
            before = body[m.start() - 1] if m.start() else ("|" if begins else "*")
            after = body[m.end()] if m.end() < len(body) else ("|" if ends else "*")
            if before != "*" and after != "*":
                found.append(m[0])
        return tuple(found)


def parse_rules(lines: str) -> tuple[PatternRule, ...]:
    told = (x.strip() for x in lines.splitlines())
    return tuple(PatternRule(x) for x in told if x and not x.startswith("!"))


PATTERN_RULES = parse_rules("""
! advertising and tracking
^ads^
^adserver^
^adserv^
^ad^server^
^banner^
^banners^
||doubleclick.
^popup^
^pixel^
^beacon^
||track.
||tracker.
||tracking.
/ads/*/click^
^track^*^redirect^
! gambling
^casino^
^casinos^
^bet^
^bets^
^betting^
^poker^
^roulette^
^slots^
^jackpot^
^lottery^
^gambling^
! adult
^porn^
^porno^
^xxx^
^sex^
^nude^
^nudes^
^adult^
^adults^
^escort^
^escorts^
^webcam^
^hentai^
^camgirls^
! malware and fraud
^malware^
^phishing^
^spyware^
^ransomware^
^keylogger^
^trojan^
^botnet^
^exploit^
^payday^
^spam^
^clickbait^
! piracy and pharmacy
^warez^
^crack^
^cracks^
^keygen^
^torrent^
^torrents^
^pirate^
^viagra^
^cialis^
^pills^
^pharma^
! downloads and raw addresses
/\\.(?:exe|scr|apk|msi|bat)(?:[?#]|$)/
/^[a-z][a-z0-9+.-]*:\\/\\/[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?:[:\\/?#]|$)/
! pages about these things
@@||museum.
@@^sex^education^
@@^malware^research^
@@^phishing^report^
""")


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit("[a-z0-9]+"), F.lit(0)))


def token_counts(pages: DataFrame, tokens: Sequence[str], url: str = "url") -> dict[str, int]:
    """URLs that hold each of ``tokens``, over the whole table; at most one row for each token."""
    if not tokens:
        return {}
    wanted = pages.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    held = pages.select(F.explode(url_tokens(F.coalesce(F.col(url), F.lit("")))).alias("token"))
    rows = held.join(F.broadcast(wanted), "token").groupBy("token").count().collect()  # the tokens of one block of rules
    return {r["token"]: r["count"] for r in rows}


def build_index(rules: Sequence[HostRule | PatternRule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers by rarest literal token; ``""`` holds the rules without one."""
    index: dict[str, list[int]] = {}
    for number, rule in enumerate(rules):
        key = min(rule.tokens, key=lambda t: (counts.get(t, 0), t)) if rule.tokens else ""
        index.setdefault(key, []).append(number)
    return index


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    m = _HOST.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class _Block:
    """Rules of one block, filed by token; what a task holds."""

    def __init__(self, rules: Sequence, index: dict[str, list[int]]):
        self.rules, self.index, self.always = rules, index, index.get("", [])
        self._compiled: dict[int, re.Pattern] = {}

    def candidates(self, tokens: Iterable[str]) -> list[int]:
        found = list(self.always)
        for token in set(tokens):
            found += self.index.get(token, ())
        return found

    def fits(self, number: int, url: str) -> bool:
        known = self._compiled.get(number)
        if known is None:
            known = self._compiled[number] = re.compile(self.rules[number].pattern)
        return known.search(url) is not None

    def __getstate__(self):
        return self.__dict__ | {"_compiled": {}}


def _blocks(rules: Sequence, size: int) -> Iterator[Sequence]:
    for i in range(0, len(rules), size):
        yield rules[i : i + size]


def judge_urls(
    pages: DataFrame,
    host_rules: Sequence[HostRule],
    pattern_rules: Sequence[PatternRule] = PATTERN_RULES,
    url: str = "url",
    keep: Sequence[str] = ("page_id",),
    default: str = "allow",
    block_rules: int = BLOCK_RULES,
) -> DataFrame:
    """Host, path, the longest fitting host rule and the verdict of every URL.

    The verdict is the host rule's where one fits; else the pattern rules': ``allow`` if an
    exception fits, ``block`` if a blocking rule does, else ``default``. ``pattern_rule`` is
    the first line that fits, exceptions before others.
    """
    kept = F.struct(*(F.col(c) for c in keep)).alias("kept")
    nothing = F.lit(None).cast("string")
    rows = pages.select(kept, F.col(url).cast("string").alias("url"), nothing.alias("rule"), nothing.alias("action"), nothing.alias("pattern_rule"))
    kind = rows.schema
    # Of host rules the longest name wins, of pattern rules an exception, then the first line.
    hosts = sorted(host_rules, key=lambda r: (-len(r.name), r.name))
    patterns = sorted(pattern_rules, key=lambda r: r.action != "allow")
    for rules in (*_blocks(hosts, block_rules), *_blocks(patterns, block_rules)):
        counts = token_counts(pages, sorted({t for r in rules for t in r.tokens}), url)
        shared = pages.sparkSession.sparkContext.broadcast(_Block(rules, build_index(rules, counts)))
        rows = rows.mapInArrow(_pass(shared, isinstance(rules[0], HostRule)), kind)
    text = F.coalesce("url", F.lit(""))
    after = F.when(F.instr(text, "://") > 0, F.substr(text, F.instr(text, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_pattern = F.when(F.col("pattern_rule").startswith("@@"), "allow").when(F.col("pattern_rule").isNotNull(), "block")
    return rows.select(
        *(F.col("kept").getField(c).alias(c) for c in keep),
        host.alias("host"),
        F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1).alias("path"),
        "rule",
        F.coalesce("action", by_pattern, F.lit(default)).alias("verdict"),
        "pattern_rule",
    )


def _pass(shared, of_hosts: bool):
    """One pass over the URLs with a block of rules; what an earlier block found stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block = shared.value
        for batch in batches:
            found: list[int | None] = []
            known = batch.column(2 if of_hosts else 4)
            for i, url in enumerate(batch.column(1).to_pylist()):
                best = None
                if not known[i].is_valid and of_hosts:
                    host, path = split_url(url)
                    if host:
                        best = min((n for n in block.candidates(_TOKEN.findall(host)) if block.rules[n].fits(host, path)), default=None)
                elif not known[i].is_valid:
                    text = (url or "").lower()
                    best = next((n for n in sorted(block.candidates(_TOKEN.findall(text))) if block.fits(n, text)), None)
                found.append(best)
            columns = list(batch.columns)
            told = lambda at, value: pa.array([old if n is None else value(block.rules[n]) for n, old in zip(found, columns[at].to_pylist(), strict=True)], pa.string())
            if of_hosts:
                columns[2], columns[3] = told(2, lambda r: r.name), told(3, lambda r: r.action)
            else:
                columns[4] = told(4, lambda r: r.name)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run
