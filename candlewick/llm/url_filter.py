r"""URL filters: pattern rules behind an index of their rarest literal tokens.

A rule is a pattern over ``host + path + query``: ``^`` stands for a separator (any character but A-Z, a-z, 0-9, or
either end), ``*`` for any text, ``||`` at the start for the start of the host or of a parent domain of it, and all else
for itself, in any case. Tokens are the ``[a-z0-9]+`` runs of the lower-cased URL; those of a pattern that separators or
other signs bound on both sides are whole tokens of every match, so they follow from the pattern (``literal_tokens``).
Spark counts in how many URLs each such token occurs, and a rule is filed under its rarest one. A URL's tokens fetch the
candidate rules and only those run their regular expressions; rules without a literal token are candidates of every URL.
The index holds rules alone, so its size is that of the rule list; it is broadcast, and rules are compiled when first
fetched.

Host rules (``host_rule``) fit a host and its subdomains where the path, as written, starts with the rule's path; of
those that fit, the longest decides, the first listed of equal ones. Where none fits, a URL is blocked if any block
pattern matches, else allowed; the first listed match is named.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule, and are allowed. URLs of any length are
searched whole. Each row is judged by itself, so repeated rows and other columns make no difference; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile("[a-z0-9]+")
_WHOLE = re.compile(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])")
_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_A_Z, _a_z)
_SEPARATOR = "(?:[^A-Za-z0-9]|^|$)"
_LABEL = r"^(?:[^/?#]*\.)?"


@dataclass(frozen=True)
class Rule:
    """A pattern rule; with ``host_rule`` the pattern is a host and a path's beginning, see the module's text."""

    name: str
    pattern: str
    verdict: str = "block"
    host_rule: bool = False

    def regex(self) -> str:
        """The expression of the rule: for host rules over the URL's text as written, for others over the lower-cased one."""
        if self.host_rule:
            return f"{_LABEL}{re.escape(self.pattern)}"
        body = self.pattern.translate(_FOLD)
        head, body = (_LABEL, body[2:]) if body.startswith("||") else ("", body)
        return head + "".join({"^": _SEPARATOR, "*": ".*"}.get(c, re.escape(c)) for c in body)

    def literal_tokens(self) -> list[str]:
        """Tokens that every match holds whole. Where a pattern may begin or end inside a token, that one is left out."""
        text = self.pattern.translate(_FOLD)
        before = "" if self.host_rule or text.startswith("||") else "*"
        return _WHOLE.findall(f"{before}{text}*")


def host_rule(rule: str, verdict: str) -> Rule:
    """Fits the host before the first ``/`` and its subdomains, where the path starts with the rest."""
    return Rule(rule, rule, verdict, True)


def word_rule(word: str) -> Rule:
    return Rule(f"word:{word}", f"^{word}^")


def rules_of(table: DataFrame) -> tuple[Rule, ...]:
    """Rules of a table (name, pattern, verdict, host_rule): a rule list, which is held on the driver and in the tasks."""
    return tuple(Rule(*r) for r in table.select("name", "pattern", "verdict", "host_rule").where("pattern IS NOT NULL").orderBy("name", "pattern").collect())


#: Host rules that the query applies; fixed values.
HOST_RULES = (
    host_rule("org/", "allow"),
    host_rule("example.org/es/", "block"),
    host_rule("example.org/en/1", "block"),
    host_rule("com/fr/", "allow"),
    host_rule("com/de/", "block"),
)

#: Block patterns of the method, fixed values: account and shop pages, words of spam, adult and gambling sites, lists.
PATTERNS = (
    *map(word_rule, "login signup register cart checkout porn xxx adult escort casino poker bets betting lottery viagra spam torrent warez".split()),
    Rule("cheap-pills", "^cheap-pills^"),
    Rule("tag-page", "/tag/"),
    Rule("tags-page", "/tags/"),
    Rule("wp-admin", "/wp-admin^"),
    Rule("print-view", "^print=1^"),
)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1), _A_Z, _a_z)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def url_text(url: Column) -> Column:
    """What rules are matched in: lower-cased host, path and query as written, without the fragment."""
    return F.concat(url_host(url), F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^#]*)", 1))


def token_index(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, list[int]]:
    """Rule numbers by the rarest literal token of each rule; ``""`` holds the rules without one.

    ``urls`` has the column ``url_text``. Counts come back for the rules' own tokens only.
    """
    tokens = [rule.literal_tokens() for rule in rules]
    known = sorted({t for own in tokens for t in own})
    counts: dict[str, int] = {}
    if known:
        of_rules = urls.sparkSession.createDataFrame([(t,) for t in known], "token string")
        held = urls.select(F.explode(F.array_distinct(F.split(F.translate("url_text", _A_Z, _a_z), "[^a-z0-9]+"))).alias("token"))
        counts = {r["token"]: r["count"] for r in held.join(F.broadcast(of_rules), "token").groupBy("token").count().collect()}  # a row a rule token
    index: dict[str, list[int]] = {}
    for k, own in enumerate(tokens):
        index.setdefault(min(own, key=lambda t: (counts.get(t, 0), t), default=""), []).append(k)
    return index


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = HOST_RULES + PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (the first block pattern that matched) and candidates of every row."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), url_text(url).alias("url_text"))
    shared = pages.sparkSession.sparkContext.broadcast((tuple(rules), token_index(parts, rules)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, index = shared.value
        compiled: dict[int, re.Pattern] = {}
        for batch in batches:
            rule_of, verdicts, patterns, tried = [], [], [], []
            for text in batch.column("url_text").to_pylist():
                lower = text.translate(_FOLD)
                found = sorted({k for t in {*_TOKEN.findall(lower), ""} for k in index.get(t, ())}) if text else []
                for k in found:
                    if k not in compiled:
                        compiled[k] = re.compile(given[k].regex(), re.S)
                hits = [given[k] for k in found if compiled[k].search(text if given[k].host_rule else lower)]
                fits = max((r for r in hits if r.host_rule), key=lambda r: len(r.name), default=None)
                pattern = next((r for r in hits if not r.host_rule), None)
                rule_of.append(fits and fits.name)
                patterns.append(pattern and pattern.name)
                verdicts.append(fits.verdict if fits else pattern.verdict if pattern else "allow")
                tried.append(len(found))
            made = [pa.array(rule_of, pa.string()), pa.array(verdicts, pa.string()), pa.array(patterns, pa.string()), pa.array(tried, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["page_id", "host", "path", "rule", "verdict", "pattern", "candidates"])

    return parts.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, pattern string, candidates int")


def digest(pages: DataFrame) -> DataFrame:
    return filter_urls(pages).drop("candidates")


def _oracle() -> str:
    others = ", ".join(f"CASE WHEN regexp_matches(t, '{r.regex()}') THEN '{r.name}' END" for r in PATTERNS)
    fits = ", ".join(
        f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN {{'n': {len(r.name)}, 'rule': '{r.name}', 'verdict': '{r.verdict}'}} END"
        for r in HOST_RULES
        for h, _, p in [r.name.partition("/")]
    )
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{_A_Z}', '{_a_z}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path,
             translate(regexp_extract(rest, '(?s)^([^#]*)', 1), '{_A_Z}', '{_a_z}') AS t FROM u),
m AS (SELECT page_id, host, path, list_max([{fits}]) AS fit, coalesce({others}) AS pattern FROM s)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern FROM m
"""


ORACLE = _oracle()
