"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with a verdict, a rank and
the literal tokens that every match must contain whole.  The index files each
rule under that one of its tokens that is rarest, by counts over the URLs and
then over the rules.  A URL's tokens fetch candidate rules, and only those run
their regular expressions; of the rules that match, the one of the highest
rank wins.

Host rules are written ``host/path``: they fit the host and all its
subdomains if the path starts with the rule's path, and the longest rule that
fits wins.  Generic rules (``Rule.of``) give a verdict where no host rule fits;
without any, the URL is allowed.

Rules of the text language (``Rule.parse``, a list, or a table by
``rules_from``) may have wildcards and anchors: ``*`` is anything, ``^`` a
separator or the end, ``||`` at the start the host or one of its subdomains, ``|`` at the
start or end the start or end of host and path; ``@@`` in front makes a rule an
exception that allows.  Exceptions win over blocking rules, and host rules over both.

Edge cases: a URL that is null or has no ``://`` has an empty host and path,
and fits no host rule; a rule without tokens is tried on every URL; rules of
equal rank are taken in their order; input columns named like the results are
replaced by them; a URL of any length is judged whole; repeated rows are judged
alike; an empty table gives an empty result; bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches
from ._text import passed_on, strings

TOKEN = re.compile(r"[0-9a-z]+|[^\x00-\x7f]+")


@dataclass(frozen=True)
class Rule:
    pattern: str  # searched in host + path
    verdict: str
    rank: int
    tokens: tuple[str, ...]
    name: str | None = None  # host rules and those of the text language are reported by it
    exact: bool = False  # whether capitals in the path matter
    place: int = 0  # in the list: of rules of equal rank the first wins

    @staticmethod
    def host(rule: str, verdict: str) -> Rule:
        """A host rule such as ``example.net/en/``."""
        host, slash, path = rule.partition("/")
        whole = TOKEN.findall(host)
        # the last token of the path may be the start of a longer one
        in_path = TOKEN.findall(path.lower())
        if in_path and TOKEN.match(path.lower()[-1]):
            in_path.pop()
        return Rule(rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", verdict, 1_000 + len(rule), (*whole, *in_path), rule, True)

    @staticmethod
    def of(words: str, verdict: str = "block") -> Rule:
        """A generic rule: the words next to each other, as whole tokens, anywhere."""
        parts = words.split()
        return Rule(r"(?<![0-9a-z])" + "[^0-9a-z]+".join(map(re.escape, parts)) + r"(?![0-9a-z])", verdict, 0, tuple(parts))

    @staticmethod
    def parse(text: str) -> Rule:
        """A rule of the text language, such as ``||ads.example^``, ``*/track/*.gif|`` or ``@@||example.org/about``."""
        body = text.removeprefix("@@").lower()
        allows = body != text.lower()
        at_host, at_start = body.startswith("||"), body.startswith("|")
        body = body.removeprefix("||") if at_host else body.removeprefix("|")
        at_end = body.endswith("|")
        body = body.removesuffix("|")
        if not body.strip("*^|"):
            raise ValueError(f"a rule that says nothing: {text!r}")
        pattern = "".join(".*" if c == "*" else r"(?:[^0-9a-z_.%-]|$)" if c == "^" else re.escape(c) for c in body)
        pattern = (r"\A(?:[^/]*\.)?" if at_host else r"\A" if at_start else "") + pattern + (r"\Z" if at_end else "")
        # a token is certain to be whole in a match if what is next to it in the rule cannot belong to it
        tokens, edge = [], "|" if at_start or at_host else "*"
        framed = edge + body + ("|" if at_end else "*")
        for m in TOKEN.finditer(framed):
            if framed[m.start() - 1] != "*" and framed[m.end()] != "*":
                tokens.append(m[0])
        return Rule(pattern, "allow" if allows else "block", 500 if allows else 100, tuple(tokens), text)


def rules_from(table: DataFrame, rule: str = "rule", most: int = 1_000_000) -> list[Rule]:
    """Rules of the text language from a table; nulls, blanks and comments (``!``) are left out, and more than `most` rules raise an error."""
    c = F.trim(F.col(f"`{rule}`"))
    rows = table.select(c.alias("r")).where(c.isNotNull() & (c != "") & ~c.startswith("!")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rules, which are more than tasks should carry")
    return [Rule.parse(r["r"]) for r in sorted(rows)]


#: Words of addresses that sell, spam or offend.
GENERIC = tuple(Rule.of(x) for x in ("cheap pills", "spam farm", "casino", "viagra", "porn", "xxx", "free money", "payday loans", "replica watches", "adult", "betting", "phishing", "malware"))


def index(rules: Iterable[Rule], frequency: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by rarest token; those without tokens under the empty one."""
    rules = [replace(r, place=k) for k, r in enumerate(rules)]
    own = Counter(t for r in rules for t in set(r.tokens))
    out: dict[str, list[Rule]] = defaultdict(list)
    for r in rules:
        out[min(r.tokens, key=lambda t: (frequency.get(t, 0), own[t], t)) if r.tokens else ""].append(r)
    return dict(out)


def split(url: str | None) -> tuple[str, str]:
    """Host, A-Z small, and path."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = re.search(r"[/?#]", rest)
    host = rest[: end.start()] if end else rest
    tail = rest[end.start() :] if end else ""
    path = re.split(r"[?#]", tail, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), host), path


def judge(host: str, path: str, by_token: dict[str, list[tuple[Rule, re.Pattern]]], tried: list[Rule] | None = None) -> Rule | None:
    """The winning rule, by an index whose rules are compiled; `tried` gets the rules whose expressions ran."""
    where = host + path
    best = None
    for token in ("", *dict.fromkeys(TOKEN.findall(where.lower()))):
        for rule, pattern in by_token.get(token, ()):
            if best is None or (rule.rank, -rule.place) > (best.rank, -best.place):
                if tried is not None:
                    tried.append(rule)
                if pattern.search(where if rule.exact else where.lower()):
                    best = rule
    return best


def frequencies(pages: DataFrame, rules: Iterable[Rule], url: str) -> dict[str, int]:
    """How many URLs hold each token of the rules: as many rows as the rules have tokens, at most."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    known = pages.sparkSession.createDataFrame([(t,) for t in wanted], "t string")  # as many rows as rules have tokens
    tokens = F.array_distinct(F.split(F.lower(F.col(f"`{url}`")), r"[\x00-/:-`{-\x7f]+"))
    counts = pages.select(F.explode(tokens).alias("t")).join(F.broadcast(known), "t", "left_semi").groupBy("t").count()
    return {r["t"]: r["count"] for r in counts.collect()}


def filter_urls(pages: DataFrame, host_rules: Iterable[tuple[str, str]], generic: Iterable[Rule] = GENERIC, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """pages (or the columns `keep`) with ``host``, ``path``, ``rule`` and ``verdict``.

    host_rules: (rule, verdict) pairs.  Rules are a parameter and travel with
    the tasks; their number does not follow the data.
    """
    rules = [*(Rule.host(r, v) for r, v in host_rules), *generic]
    filed = index(rules, frequencies(pages, rules, url))
    rest = passed_on(pages.columns if keep is None else keep, ("host", "path", "rule", "verdict"))
    bound_batches(pages.sparkSession)
    src = pages.select(F.col(f"`{url}`").cast("string").alias("__url"), F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in rest]).alias("__row"))
    names = ["host", "path", "rule", "verdict"]
    schema = T.StructType([src.schema["__row"], *[T.StructField(c, T.StringType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {t: [(r, re.compile(r.pattern, re.DOTALL)) for r in rs] for t, rs in filed.items()}
        for batch in batches:
            out = []
            for x in strings(batch.column(0)):
                host, path = split(x)
                hit = judge(host, path, ready)
                out.append((host, path, hit.name if hit else None, hit.verdict if hit else "allow"))
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array([r[k] for r in out], pa.string()) for k in range(4)]], names=schema.names)

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col("__row")[c].alias(c) for c in rest], *names)
