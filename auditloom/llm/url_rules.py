"""URL filters with redirect equivalence.

A url is judged by the longest rule that fits its host (or a domain above it) and the start of its path. Where no rule
fits, the url shares the fate of its aliases: redirects (`<meta http-equiv=refresh>`, a crawl log) and canonical links
tie urls together, connected components make the groups, and a block decision on any member reaches all members
without a rule of their own. A rule that allows a url takes precedence over what its aliases would bring.

Rules meet urls by equality on (domain, path prefix): a url asks for each domain above its host and each path length
that rules have. Groups are found by the rounds of :func:`groups.components`; nothing of them comes to the driver but
one number a round. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .groups import components

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
_TAG = r"""(?i)<(?:link|meta)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_LIKELY = r"(?i)<link\b[^>]*canonical|<meta\b[^>]*refresh"


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, rule_verdict string")


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(rows: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """``rows`` with scheme (up to `://`, lower case), host (lower case), path and query of a url: empty without `://`.

    Columns step by step, so that no expression is written out more than once.
    """
    at = F.instr(url, "://")
    rows = rows.withColumn("__rest", F.coalesce(F.when(at > 0, F.substr(F.col(url), at + 3)), F.lit("")))
    return rows.withColumns({
        f"{prefix}scheme": F.coalesce(F.when(at > 0, _ascii_lower(F.substr(F.col(url), F.lit(1), at + 2))), F.lit("")),
        f"{prefix}host": _ascii_lower(F.regexp_extract("__rest", r"(?s)\A[^/?#]*", 0)),
        f"{prefix}path": F.regexp_extract("__rest", r"(?s)\A[^/?#]*([^?#]*)", 1),
        f"{prefix}query": F.regexp_extract("__rest", r"(?s)\A[^?#]*([^#]*)", 1),
    }).drop("__rest")


def _slashed(path: Column) -> Column:
    return F.when(path == "", F.lit("/")).otherwise(path)


def with_key(rows: DataFrame, url: str, key: str) -> DataFrame:
    """``rows`` with one spelling of a url: scheme and host in lower case, an empty path as `/`, no fragment. Null without `://`."""
    rows = with_parts(rows, url, "__")
    spelt = F.concat("__scheme", "__host", _slashed(F.col("__path")), "__query")
    return rows.withColumn(key, F.when(F.col("__scheme") != "", spelt)).drop("__scheme", "__host", "__path", "__query")


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, unquoted; empty if it has none."""
    value = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"""\A["']|["']\z""", ""), r"(?i)&amp;", "&"))


def _with_resolved(rows: DataFrame, target: str, base: str, name: str) -> DataFrame:
    """``rows`` with the absolute url of a link's target on the page ``base``; dot segments are taken away."""
    rows, to = with_parts(rows, base, "__"), F.col(target)
    origin, path = F.concat("__scheme", "__host"), _slashed(F.col("__path"))
    full = (
        F.when(to.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:"), to)
        .when(F.startswith(to, F.lit("//")), F.concat(F.regexp_replace("__scheme", "//", ""), to))
        .when(F.startswith(to, F.lit("/")), F.concat(origin, to))
        .when(F.startswith(to, F.lit("?")), F.concat(origin, path, to))
        .when((to != "") & ~F.startswith(to, F.lit("#")), F.concat(origin, F.regexp_extract(path, r"(?s)\A(.*/)", 1), to))
    )
    rows = with_parts(rows.withColumn(name, full), name, "__")
    rows = rows.withColumn("__parts", F.when(F.col("__path").rlike(r"/\.\.?(/|\z)"), F.split("__path", "/")))
    kept = F.aggregate(F.slice("__parts", 2, F.size("__parts")), F.array().cast("array<string>"), lambda acc, x: (
        F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    ))
    rows = rows.withColumn("__kept", F.when(F.col("__parts").isNotNull(), kept))
    ends = F.when(F.element_at("__parts", -1).isin(".", "..") & (F.size("__kept") > 0), F.lit("/")).otherwise(F.lit(""))
    plain = F.concat("__scheme", "__host", F.lit("/"), F.array_join("__kept", "/"), ends, "__query")
    return rows.withColumn(name, F.when(F.col("__parts").isNotNull(), plain).otherwise(F.col(name))).drop(*[c for c in rows.columns if c.startswith("__")])


def page_links(pages: DataFrame) -> DataFrame:
    """(u, v): url keys of pages and of what their canonical links and refresh redirects name.

    Comments are no markup. Scripts that move on are not run. A page without a proper url has no links, nor
    has one that names itself.
    """
    html = F.when(F.col("html").rlike(_LIKELY), F.regexp_replace("html", r"(?s)<!--.*?-->", ""))
    tag = F.col("tag")
    rows = pages.select("url", F.explode(F.regexp_extract_all(html, F.lit(_TAG), F.lit(0))).alias("tag"))
    canonical = F.when(tag.rlike(r"(?i)\A<link"), F.when(F.lower(_attribute(tag, "rel")).rlike(r"(?:\A|\s)canonical(?:\s|\z)"), _attribute(tag, "href")))
    refresh = F.when(tag.rlike(r"(?i)\A<meta"), F.when(F.lower(_attribute(tag, "http-equiv")) == "refresh", F.regexp_extract(_attribute(tag, "content"), r"""(?is)[;,]\s*(?:url\s*=)?\s*["']?([^"']*)""", 1)))
    named = rows.select("url", F.trim(F.coalesce(canonical, refresh)).alias("target")).filter("target is not null")
    return link_edges(_with_resolved(named, "target", "url", "to_url").select(F.col("url").alias("from_url"), "to_url"))


def link_edges(links: DataFrame) -> DataFrame:
    """(u, v) from rows of (from_url, to_url), such as a crawler's log of redirects."""
    keyed = with_key(with_key(links, "from_url", "u"), "to_url", "v")
    # A plain filter on u and v would be pushed below the steps that make them, and write each of them out many times.
    unlike = F.filter(F.array(F.struct("u", "v")), lambda x: x["u"] != x["v"])
    return keyed.select(F.explode_outer(unlike).alias("x")).select("x.u", "x.v").filter("u is not null").distinct()


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) of the distinct ``urls`` (url) for which a rule fits: the longest one.

    Equal rules that differ in their verdict: allow wins. Rules with null parts fit nothing. The path lengths that
    rules have are the only thing read to the driver: at most as many small numbers as the longest path has characters.
    """
    rules = (
        rules.select(F.col("rule_host").alias("h"), F.col("rule_path").alias("p"), F.col("rule_verdict").alias("verdict")).dropna()
        .groupBy("h", "p").agg(F.min("verdict").alias("verdict"))
    )
    lengths = sorted(r[0] for r in rules.select(F.char_length("p")).distinct().collect())
    if not lengths:
        return urls.select("url", F.lit("").alias("rule"), F.lit("").alias("verdict")).filter(F.lit(False))
    labels = F.split("__host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    long_enough = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.char_length("__path"))
    asked = (
        with_parts(urls.select("url"), "url", "__")
        .select("url", "__path", F.explode(domains).alias("h"), long_enough.alias("__lengths"))
        .select("url", "h", F.explode(F.transform("__lengths", lambda n: F.substr(F.col("__path"), F.lit(1), n))).alias("p"))
    )
    # Domains above one host and starts of one path are nested, so hosts and paths order the rules that fit.
    best = F.max(F.struct(F.char_length("h") + F.char_length("p"), F.char_length("h"), F.concat("h", "p").alias("rule"), "verdict"))
    return asked.join(rules, ["h", "p"]).groupBy("url").agg(best.alias("b")).select("url", "b.rule", "b.verdict")


def judge(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict (replaced, if pages has columns of these names).

    ``links`` are further edges (u, v) of url keys. A url without a rule is blocked if any url of its group, whether
    among the pages or only named by a link, is blocked by a rule; else it is allowed. Rows with a null url or one
    without `://` have empty hosts and paths, fit no rule and have no aliases: allowed. Repeated urls are judged
    alike; an empty table gives an empty one, empty rules allow everything.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    edges = page_links(pages)
    edges = cut_lineage(edges if links is None else edges.unionByName(links.select("u", "v")).distinct(), "links")
    own = pages.select("url").distinct()
    ruled = fitting_rules(own, rules).select(F.col("url").alias("__url"), "rule", F.col("verdict").alias("__own"))
    blocked = _blocked(edges, rules)
    rows = pages.join(ruled, F.col("url") == F.col("__url"), "left").drop("__url")
    rows = with_parts(with_key(rows, "url", "__key").join(blocked, "__key", "left"), "url")
    verdict = F.coalesce("__own", F.when(F.col("__blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(*[F.col(f"`{c}`") for c in pages.columns], "host", "path", "rule", verdict.alias("verdict"))


def _blocked(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(__key, __blocked) of every linked url whose group has a url that a rule blocks."""
    groups = cut_lineage(components(edges), "aliases")
    ruled = fitting_rules(groups.select(F.col("node").alias("url")), rules).filter("verdict = 'block'")
    roots = groups.join(ruled.select(F.col("url").alias("node")), "node").select("root").distinct()
    return groups.join(roots, "root", "left_semi").select(F.col("node").alias("__key"), F.lit(True).alias("__blocked"))
