"""URL filter by pattern rules, each indexed under its rarest literal token. DataFrame functions only.

* A pattern rule names the literal tokens (runs of [0-9a-z], A-Z lowered) that every url it matches
  has in full, so none that the url may carry on. How many urls have each of them is counted over the whole table, and the rule is
  indexed under the rarest.
* The distinct tokens of a url look up rules in that index, a literal of hash buckets; only the rules
  found run their regular expressions. Of those that match, the longest pattern gives the verdict
  (then the smallest pattern); a url that none matches is allowed.
* Host rules (host, path prefix) go before: a rule fits its host and all subdomains where the url's
  path starts with the rule's; the longest of those that fit decides (then the smallest). The host and
  each part of it behind a dot are looked up in hash buckets of the rules' hosts.

Row by row, no shuffle but for the count of tokens (partial sums of at most as many keys as the rules
have tokens), so hot hosts do not matter. ``RULES`` bounds the literal; more rules are refused.

Defined cases: a null url, or one without ``://``, has an empty host and path and no token to match;
an empty path starts with no rule's path; repeated rows are judged alike; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Pattern:
    verdict: str
    regex: str
    tokens: tuple[str, ...]


#: Host, path, verdict.
HOST_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Regular expressions in the common part of Java's and RE2's syntax, on the url with A-Z lowered.
PATTERNS = (
    Pattern("block", "[?&]utm_source=", ("utm", "source")),
    Pattern("block", "[?&]ref=[0-9a-z]+", ("ref",)),
    Pattern("block", "[?&]page=[0-9]+&ref=", ("page", "ref")),
    Pattern("allow", "/[a-z][a-z]/[0-9]+[.]html(?:[?#]|$)", ("html",)),
    Pattern("block", "://m[.][0-9a-z.-]+/de/", ("m", "de")),
    Pattern("block", "://blog[.][0-9a-z.-]+/", ("blog",)),
    Pattern("block", "[/.-](?:online-)?casino[/.-]", ("casino",)),
    Pattern("block", "/wp-login[.]php", ("wp", "login")),
    Pattern("block", "/track/click[?/]", ("track", "click")),
)


def lowered(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.regexp_replace(url, "[^0-9a-z]+", " "), " "), ""))


def rarest_tokens(urls: DataFrame, patterns: tuple[Pattern, ...]) -> dict[Pattern, str]:
    """The literal token of each pattern that the fewest urls have."""
    wanted = sorted({t for p in patterns for t in p.tokens})
    found = urls.select(F.explode(F.array_intersect(_tokens(F.col("low")), F.array(*map(F.lit, wanted)))).alias("t"))
    seen = {r["t"]: r["count"] for r in found.groupBy("t").count().collect()}  # one row for each token of a rule
    return {p: min(p.tokens, key=lambda t: (seen.get(t, 0), t)) for p in patterns}


def _index(of: dict[Pattern, str]) -> tuple[Column, int]:
    """Hash buckets (token -> its rules), as a literal."""
    from zlib import crc32

    n = max(1, len(of))
    buckets: list[dict[str, list[Pattern]]] = [{"": []} for _ in range(n)]
    for p, token in of.items():
        buckets[crc32(token.encode()) % n].setdefault(token, []).append(p)
    kind = "array<struct<regex:string,verdict:string>>"
    rule = lambda p: F.struct(F.lit(p.regex).alias("regex"), F.lit(p.verdict).alias("verdict"))
    maps = [F.create_map(*[c for t, rules in b.items() for c in (F.lit(t), F.array(*map(rule, rules)).cast(kind))]) for b in buckets]
    return F.array(*maps), n


def _host_index(rules) -> tuple[Column, int]:
    """Hash buckets of (length below 0, host, path, verdict), as a literal."""
    from zlib import crc32

    n = max(1, len(rules))
    buckets: list[list] = [[] for _ in range(n)]
    for h, p, v in rules:
        buckets[crc32(h.encode()) % n].append(F.struct(F.lit(-len(h + p)).alias("n"), F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")))
    return F.array(*[F.array(*b).cast("array<struct<n:int,host:string,path:string,verdict:string>>") for b in buckets]), n


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules=HOST_RULES, patterns: tuple[Pattern, ...] = PATTERNS, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every row."""
    if len(patterns) > RULES or len(host_rules) > RULES:
        raise ValueError("too many rules for a literal")
    urls = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    urls = urls.withColumn("low", lowered(F.col("url"))).withColumn("at", F.instr("url", "://"))
    rest = F.when(F.col("at") > 0, F.expr("substring(url, at + 3)")).otherwise("")
    urls = urls.withColumn("rest", rest)
    urls = urls.withColumn("host", lowered(F.regexp_extract("rest", "^[^/?#]*", 0))).withColumn("path", F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1))

    hosts, m = _host_index(host_rules)
    labels = F.split("host", r"\.")
    behind = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    here = lambda h: F.filter(F.element_at(hosts, (F.pmod(F.crc32(h.cast("binary")), F.lit(m)) + 1).cast("int")), lambda r: (r["host"] == h) & F.startswith(F.col("path"), r["path"]))
    urls = urls.withColumn("fits", F.array_min(F.flatten(F.transform(behind, here))))
    rule, verdict = F.concat("fits.host", "fits.path"), F.col("fits.verdict")

    index, n = _index(rarest_tokens(urls, patterns))
    urls = urls.withColumn("tokens", _tokens(F.col("low")))
    bucket = lambda t: F.element_at(index, (F.pmod(F.crc32(t.cast("binary")), F.lit(n)) + 1).cast("int"))
    candidates = F.flatten(F.transform("tokens", lambda t: F.coalesce(F.try_element_at(bucket(t), t), F.array().cast("array<struct<regex:string,verdict:string>>"))))
    urls = urls.withColumn("candidates", candidates)
    matched = F.filter("candidates", lambda r: F.regexp_like(F.col("low"), r["regex"]))
    best = F.array_min(F.transform(matched, lambda r: F.struct((-F.length(r["regex"])).alias("n"), r["regex"].alias("regex"), r["verdict"].alias("verdict"))))
    urls = urls.withColumn("rule", rule).withColumn("given", verdict).withColumn("best", best)
    return urls.select("page_id", "host", "path", "rule", F.coalesce("given", "best.verdict", F.lit(default)).alias("verdict"), F.col("best.regex").alias("pattern"))


def oracle(host_rules=HOST_RULES, patterns=PATTERNS, default: str = "allow", table: str = "pages") -> str:
    """The same in DuckDB, every pattern run on every url."""
    hosts = sorted(host_rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in hosts]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, hosts, strict=True))
    given = " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, hosts, strict=True))
    order = sorted(patterns, key=lambda p: (-len(p.regex), p.regex))
    best = " ".join(f"WHEN regexp_matches(low, '{p.regex}') THEN '{p.regex}'" for p in order)
    verdict = " ".join(f"WHEN '{p.regex}' THEN '{p.verdict}'" for p in order)
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url FROM {table}),
b AS (SELECT *, translate(url, '{UPPER}', '{LOWER}') AS low,
  CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM a),
c AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
d AS (SELECT *, CASE {rule} END AS rule, CASE {given} END AS given, CASE {best} END AS pattern FROM c)
SELECT page_id, host, path, rule, coalesce(given, CASE pattern {verdict} END, '{default}') AS verdict, pattern FROM d
"""
