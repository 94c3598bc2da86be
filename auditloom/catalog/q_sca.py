"""Dependency queries: versions, requirements, advisories, lockfiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import reference as REF
from ..functions import versions as V
from ..operators import sca
from ..sources import lockfiles as L, readers as RD
from . import base as B
from .base import q, query, ql, with_ctes

# ---- versions derived from the part table ------------------------------------------------

VERS = """vers AS (SELECT p_partkey, (CASE WHEN p_partkey % 5 = 0 THEN 'v' ELSE '' END) || (p_size % 3) || '.' || (p_partkey % 12) || CASE WHEN p_partkey % 4 > 0 THEN '.' || (p_partkey % 7) ELSE '' END
  || CASE p_partkey % 9 WHEN 1 THEN '-beta' WHEN 2 THEN '.post1' WHEN 3 THEN 'rc2' WHEN 4 THEN '+build5' WHEN 5 THEN '-' ELSE '' END AS ver FROM part)"""


def _ver(k="p_partkey", s="p_size"):
    p = F.col(k)
    tag = F.when(p % 9 == 1, "-beta").when(p % 9 == 2, ".post1").when(p % 9 == 3, "rc2").when(p % 9 == 4, "+build5").when(p % 9 == 5, "-").otherwise("")
    return F.concat(
        F.when(p % 5 == 0, "v").otherwise(""), (F.col(s) % 3).cast("string"), F.lit("."), (p % 12).cast("string"),
        F.when(p % 4 > 0, F.concat(F.lit("."), (p % 7).cast("string"))).otherwise(""), tag)


_CORE = "string_split(string_split(string_split(regexp_replace(ver, '^v', ''), '+')[1], '-')[1], '.')"
KEYED = f"""kv AS (SELECT p_partkey, ver, list_transform(list_filter(list_transform(c, lambda x: regexp_extract(x, '^[0-9]*')), lambda x: x <> ''), lambda x: CAST(x AS BIGINT)) AS core,
  CASE WHEN contains(split_part(regexp_replace(ver, '^v', ''), '+', 1), '-') THEN regexp_extract(split_part(regexp_replace(ver, '^v', ''), '+', 1), '-(.*)$', 1)
    WHEN len(list_filter(c, lambda x: NOT regexp_matches(x, '^[0-9]+$'))) > 0 THEN regexp_replace(list_filter(c, lambda x: NOT regexp_matches(x, '^[0-9]+$'))[1], '^[0-9]*', '') END AS tag
  FROM (SELECT *, {_CORE} AS c FROM vers)),
key AS (SELECT p_partkey, ver, list_transform(range(1, 5), lambda i: coalesce(core[i], 0)) AS core, CASE WHEN tag IS NULL THEN 1 WHEN starts_with(tag, 'post') THEN 2 ELSE 0 END AS rank, coalesce(tag, '') AS tag FROM kv)"""


def _four(core):
    """The first four components, missing ones as zeros."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.coalesce(F.get(core, i), F.lit(0)).cast("string")), ".")


@query("f6_version_key", with_ctes(VERS, KEYED, body="SELECT p_partkey, ver, CAST(rank AS INT) AS rank, tag, array_to_string(core, '.') AS core FROM key"))
def f6(spark, sf):
    v = B.table(spark, sf, "part").select("p_partkey", _ver().alias("ver")).withColumn("k", V.version_key(F.col("ver")))
    return v.select("p_partkey", "ver", "k.rank", "k.tag", _four("k.core").alias("core"))


@query("f6_version_order", with_ctes(VERS, KEYED, body="""
SELECT a.p_partkey, CASE WHEN row(a.core, a.rank, a.tag) < row(b.core, b.rank, b.tag) THEN -1 WHEN row(a.core, a.rank, a.tag) > row(b.core, b.rank, b.tag) THEN 1 ELSE 0 END AS cmp
FROM key a JOIN key b ON b.p_partkey = a.p_partkey + 1"""))
def f6b(spark, sf):
    v = B.table(spark, sf, "part").select("p_partkey", _ver().alias("ver"))
    nxt = v.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("ver").alias("other"))
    return v.join(nxt, "p_partkey").select("p_partkey", V.compare_versions(F.col("ver"), F.col("other")).alias("cmp"))


REQS = (">=1.2, <2", "^0.3", "^1.4.2", "~1.5", "~2", "= 0.0.3", "1.2.3", ">0.11", "<=2.4.4, >=0.5", "^0.0.3", ">= bogus")


def _req_sql(i: int, req: str) -> str:
    """Plain-SQL reading of one requirement over key columns."""
    out = []
    for part in [p.strip() for p in req.split(",")]:
        op = next((o for o in ("<=", ">=", "<", ">", "=", "^", "~") if part.startswith(o)), "")
        target = part[len(op):].strip()
        nums = target.split(".")
        if not all(n.isdigit() for n in nums):
            return f"WHEN {i} THEN false"
        core = [int(n) for n in nums] + [0] * (4 - len(nums))
        t = f"row([{', '.join(f'CAST({c} AS BIGINT)' for c in core)}], 1, '')"
        v = "row(core, rank, tag)"
        same = lambda n: " AND ".join(f"core[{j + 1}] = {core[j]}" for j in range(n))
        if op in ("<", "<=", ">", ">="):
            out.append(f"{v} {op} {t}")
        elif op == "=":
            out.append(f"{v} = {t}")
        elif op == "~":
            out.append(f"{v} >= {t} AND {same(1 if len(nums) < 2 else 2)}")
        else:
            n = 1 if core[0] else 2 if core[1] else 3
            out.append(f"{v} >= {t} AND {same(n)}")
    return f"WHEN {i} THEN " + " AND ".join(f"({c})" for c in out)


@query("f7_req_matches", with_ctes(VERS, KEYED, body=f"SELECT p_partkey, r.i AS req_no, CASE r.i {' '.join(_req_sql(i, r) for i, r in enumerate(REQS))} END AS ok FROM key, (SELECT unnest(range({len(REQS)})) AS i) r"))
def f7(spark, sf):
    # A narrow table comes as few parts; its rows are dealt before each becomes eleven tests.
    v = B.table(spark, sf, "part").select("p_partkey", _ver().alias("ver")).repartition(64, "p_partkey")
    each = v.select("p_partkey", "ver", F.posexplode(F.array(*[F.lit(r) for r in REQS])).alias("req_no", "req"))
    return each.select("p_partkey", F.col("req_no").cast("long").alias("req_no"), V.req_matches(F.col("ver"), F.col("req")).alias("ok"))


_VEC = """vec AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size / 5.0 AS VARCHAR) WHEN p_partkey % 13 = 0 THEN NULL
  ELSE 'CVSS:3.1/AV:' || CASE WHEN p_partkey % 2 = 0 THEN 'N' ELSE 'L' END || '/C:' || CASE WHEN p_size % 2 = 0 THEN 'H' ELSE 'L' END || '/I:' || CASE WHEN p_size % 3 = 0 THEN 'H' ELSE 'N' END || '/A:' || CASE WHEN p_size % 5 = 0 THEN 'H' ELSE 'N' END END AS vec,
  CASE WHEN p_partkey % 10 = 7 THEN 'unmaintained' END AS info FROM part)"""
_SCORED = """sc AS (SELECT *, CASE WHEN TRY_CAST(vec AS DOUBLE) IS NOT NULL THEN CAST(vec AS DOUBLE) WHEN vec IS NOT NULL THEN
  CASE WHEN n = 3 AND net THEN 9.8 WHEN n = 3 THEN 7.8 WHEN n = 2 AND net THEN 8.1 WHEN n = 1 AND net THEN 7.5 WHEN n = 0 THEN 5.3 ELSE 6.5 END END AS score
  FROM (SELECT *, contains(vec, '/C:H')::INT + contains(vec, '/I:H')::INT + contains(vec, '/A:H')::INT AS n, contains(vec, 'AV:N') AS net FROM vec))"""


def _vectors(spark, sf):
    p, s = F.col("p_partkey"), F.col("p_size")
    vec = F.when(p % 6 == 0, (s / F.lit(5.0)).cast("string")).when(p % 13 == 0, None).otherwise(F.concat(
        F.lit("CVSS:3.1/AV:"), F.when(p % 2 == 0, "N").otherwise("L"), F.lit("/C:"), F.when(s % 2 == 0, "H").otherwise("L"),
        F.lit("/I:"), F.when(s % 3 == 0, "H").otherwise("N"), F.lit("/A:"), F.when(s % 5 == 0, "H").otherwise("N")))
    return B.table(spark, sf, "part").select("p_partkey", vec.alias("vec"), F.when(p % 10 == 7, "unmaintained").alias("info"))


@query("f8_cvss_score", with_ctes(_VEC, _SCORED, body="SELECT p_partkey, CAST(round(score, 4) AS DOUBLE) AS score FROM sc"))
def f8(spark, sf):
    return _vectors(spark, sf).select("p_partkey", F.round(V.cvss_score(F.col("vec")), 4).alias("score"))


@query("f9_cvss_severity", with_ctes(_VEC, _SCORED, body="""SELECT p_partkey, CASE WHEN info IS NOT NULL THEN 'Low' WHEN score IS NULL THEN 'High' WHEN score >= 9 THEN 'Critical' WHEN score >= 7 THEN 'High' WHEN score >= 4 THEN 'Medium' ELSE 'Low' END AS severity FROM sc"""))
def f9(spark, sf):
    return _vectors(spark, sf).select("p_partkey", V.cvss_severity(V.cvss_score(F.col("vec")), F.col("info")).alias("severity"))


ECO = ("npm", "PyPI", "crates.io", "Go")


@query("f10_normalize_package_name", f"SELECT p_partkey, CASE WHEN p_size % 4 = 1 THEN translate(lower(replace(p_name, ' ', '_') || '.X'), '_.', '--') ELSE replace(p_name, ' ', '_') || '.X' END AS name FROM part")
def f10(spark, sf):
    eco = F.get(F.array(*[F.lit(e) for e in ECO]), F.col("p_size") % 4)
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".X"))
    return B.table(spark, sf, "part").select("p_partkey", V.normalize_package_name(eco, raw).alias("name"))


@query("f11_purl", with_ctes(VERS, body=f"SELECT p_partkey, 'pkg:' || {ql(['npm', 'pypi', 'cargo', 'golang'])}[p_size % 4 + 1] || '/' || lower(p_type) || '@' || ver AS purl FROM part JOIN vers USING (p_partkey)"))
def f11(spark, sf):
    eco = F.get(F.array(*[F.lit(e) for e in ECO]), F.col("p_size") % 4)
    return B.table(spark, sf, "part").select("p_partkey", V.purl(eco, F.lower("p_type"), _ver()).alias("purl"))


# OSV events per supplier: introduced, then fixed or last_affected, sometimes reopened.
@query("f12_osv_ranges", """
SELECT s_suppkey, CASE k WHEN 0 THEN '1.' || s_suppkey WHEN 1 THEN '0' ELSE '2.0' END AS intro, CASE k WHEN 0 THEN '1.9' WHEN 1 THEN '3.1' END AS "end", k = 1 AS inclusive
FROM (SELECT s_suppkey, unnest(CASE s_suppkey % 3 WHEN 0 THEN [0] WHEN 1 THEN [1, 2] ELSE [0, 2] END) AS k FROM supplier)""")
def f12(spark, sf):
    s = F.col("s_suppkey")
    none = F.lit(None).cast("string")
    ev = lambda i=none, f=none, l=none: F.struct(i.alias("introduced"), f.alias("fixed"), l.alias("last_affected"))
    a = [ev(i=F.concat(F.lit("1."), s.cast("string"))), ev(f=F.lit("1.9"))]
    b = [ev(i=F.lit("0")), ev(l=F.lit("3.1")), ev(f=F.lit("9.9"))]
    tail = [ev(i=F.lit("2.0"))]
    events = F.when(s % 3 == 0, F.array(*a)).when(s % 3 == 1, F.array(*b, *tail)).otherwise(F.array(*a, *tail))
    return B.table(spark, sf, "supplier").select("s_suppkey", F.inline(V.osv_ranges(events)))


# ---- packages and advisories ----------------------------------------------------------------

PKGS = f"""pkgs AS (SELECT p_brand AS repo, {ql(ECO)}[p_size % 4 + 1] AS ecosystem, lower(p_type) || (p_partkey % 3) AS name,
  (p_size % 5) || '.' || (p_size % 10) || '.' || (p_partkey % 20) AS version, 'lock' || (p_partkey % 4) AS source_file FROM part)"""


def packages(spark, sf):
    p, s = F.col("p_partkey"), F.col("p_size")
    return B.table(spark, sf, "part").select(
        F.col("p_brand").alias("repo"), F.get(F.array(*[F.lit(e) for e in ECO]), s % 4).alias("ecosystem"),
        F.concat(F.lower("p_type"), (p % 3).cast("string")).alias("name"),
        F.concat_ws(".", (s % 5).cast("string"), (s % 10).cast("string"), (p % 20).cast("string")).alias("version"),
        F.concat(F.lit("lock"), (p % 4).cast("string")).alias("source_file"))


TYPES = ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE")
ADV = f"""adv AS (SELECT 'ADV-' || s_suppkey AS id, {ql(ECO)}[CAST(s_suppkey % 4 AS INT) + 1] AS ecosystem, {ql(TYPES)}[CAST(s_suppkey % 6 AS INT) + 1] || (s_suppkey % 3) AS name,
  CAST(s_suppkey % 3 AS BIGINT) AS lo, CAST(s_suppkey % 3 + 1 + s_suppkey % 2 AS BIGINT) AS hi, s_suppkey % 5 = 0 AS incl, s_suppkey % 7 = 0 AS lists,
  CASE WHEN s_suppkey % 11 > 0 THEN CAST(s_suppkey % 10 AS DOUBLE) END AS score, CASE WHEN s_suppkey % 9 = 0 THEN 'unmaintained' END AS info FROM supplier)"""


def advisories(spark, sf):
    s = F.col("s_suppkey")
    lo, hi = (s % 3).cast("string"), (s % 3 + 1 + s % 2).cast("string")
    none = F.array().cast("array<string>")
    rng = F.array(F.struct(F.concat(lo, F.lit(".0")).alias("intro"), F.concat(hi, F.lit(".0.0")).alias("end"), (s % 5 == 0).alias("inclusive")))
    lists = s % 7 == 0
    return B.table(spark, sf, "supplier").select(
        F.concat(F.lit("ADV-"), s.cast("string")).alias("id"), F.get(F.array(*[F.lit(e) for e in ECO]), (s % 4).cast("int")).alias("ecosystem"),
        F.concat(F.get(F.array(*[F.lit(t) for t in TYPES]), (s % 6).cast("int")), (s % 3).cast("string")).alias("name"),
        rng.alias("ranges"), F.array(F.lit("4.4.4"), F.lit("4.9.9")).alias("versions"),
        F.when(lists, F.array(F.concat(F.lit(">= "), hi))).otherwise(none).alias("patched"),
        F.when(lists, F.array(F.concat(F.lit("< "), lo))).otherwise(none).alias("unaffected"),
        F.when(s % 11 > 0, (s % 10).cast("double")).alias("score"), F.when(s % 9 == 0, "unmaintained").alias("informational"))


_HIT = """row(maj, min, pat) AS v"""


@query("j3_vulnerable_packages", with_ctes(PKGS, ADV, body="""
, n AS (SELECT *, row(CAST(split_part(version, '.', 1) AS BIGINT), CAST(split_part(version, '.', 2) AS BIGINT), CAST(split_part(version, '.', 3) AS BIGINT)) AS v FROM pkgs)
SELECT repo, source_file, n.ecosystem, n.name, version, id AS advisory, CASE WHEN info IS NOT NULL THEN 'sca_unmaintained_dependency' ELSE 'sca_vulnerable_dependency' END AS invariant_id,
  CASE WHEN info IS NOT NULL THEN 'Low' WHEN score IS NULL THEN 'High' WHEN score >= 9 THEN 'Critical' WHEN score >= 7 THEN 'High' WHEN score >= 4 THEN 'Medium' ELSE 'Low' END AS severity,
  'pkg:' || CASE n.ecosystem WHEN 'crates.io' THEN 'cargo' WHEN 'Go' THEN 'golang' ELSE lower(n.ecosystem) END || '/' || n.name || '@' || version AS purl
FROM n JOIN adv a ON a.ecosystem = n.ecosystem AND lower(a.name) = lower(n.name)
WHERE CASE WHEN lists THEN NOT (v >= row(hi, CAST(0 AS BIGINT), CAST(0 AS BIGINT)) OR v < row(lo, CAST(0 AS BIGINT), CAST(0 AS BIGINT)))
  ELSE version IN ('4.4.4', '4.9.9') OR (v >= row(lo, CAST(0 AS BIGINT), CAST(0 AS BIGINT)) AND (v < row(hi, CAST(0 AS BIGINT), CAST(0 AS BIGINT)) OR (incl AND v = row(hi, CAST(0 AS BIGINT), CAST(0 AS BIGINT))))) END"""))
def j3(spark, sf):
    # A row of this narrow table meets many advisories: it is dealt over tasks first.
    return sca.vulnerable_packages(packages(spark, sf).repartition(64), advisories(spark, sf))


# Names a customer might type: a popular name, one edit away, or unrelated.
_EDIT = """CASE k % 6 WHEN 0 THEN n WHEN 1 THEN n || 'x' WHEN 2 THEN substr(n, 2) WHEN 3 THEN substr(n, 1, 1) || substr(n, 3, 1) || substr(n, 2, 1) || substr(n, 4) WHEN 4 THEN n || (k % 9) ELSE substr(n, 1, 2) || 'q' || substr(n, 4) END"""
_POP = {e: tuple(REF.POPULAR[e]) for e in ("npm", "PyPI", "crates.io")}
NAMES = "names AS (SELECT DISTINCT eco AS ecosystem, " + _EDIT + " AS name FROM (SELECT c_custkey AS k, e.eco, e.l[CAST(c_custkey % len(e.l) AS INT) + 1] AS n FROM customer, (VALUES " + ", ".join(
    f"({q(e)}, {ql(l)})" for e, l in _POP.items()) + ") e(eco, l)))"
POPULAR = "pop AS (SELECT eco, unnest(l) AS p, generate_subscripts(l, 1) AS pos FROM (VALUES " + ", ".join(f"({q(e)}, {ql(l)})" for e, l in _POP.items()) + ") e(eco, l))"


def typed_names(spark, sf):
    k = F.col("c_custkey")
    rows = None
    for e, l in _POP.items():
        n = F.get(F.array(*[F.lit(x) for x in l]), (k % len(l)).cast("int"))
        name = (F.when(k % 6 == 0, n).when(k % 6 == 1, F.concat(n, F.lit("x"))).when(k % 6 == 2, n.substr(F.lit(2), F.length(n)))
                .when(k % 6 == 3, F.concat(n.substr(1, 1), n.substr(3, 1), n.substr(2, 1), n.substr(F.lit(4), F.length(n))))
                .when(k % 6 == 4, F.concat(n, (k % 9).cast("string"))).otherwise(F.concat(n.substr(1, 2), F.lit("q"), n.substr(F.lit(4), F.length(n)))))
        part = B.table(spark, sf, "customer").select(F.lit("r").alias("repo"), F.lit(e).alias("ecosystem"), name.alias("name"), F.lit("1").alias("version"), F.lit("lock").alias("source_file"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


_N, _P = "replace(lower(n.name), '_', '-')", "replace(p, '_', '-')"


@query("j6_typosquats", with_ctes(NAMES, POPULAR, body=f"""
SELECT n.ecosystem, n.name, first(p ORDER BY pos) AS target FROM names n JOIN pop ON eco = n.ecosystem
WHERE length({_N}) >= 5 AND NOT EXISTS (SELECT 1 FROM pop x WHERE x.eco = n.ecosystem AND x.p = {_N})
  AND NOT (starts_with({_N}, {_P}) AND regexp_matches(substr({_N}, length({_P}) + 1), '^[0-9]*$')) AND damerau_levenshtein({_N}, {_P}) = 1
GROUP BY ALL"""))
def j6(spark, sf):
    return sca.typosquats(typed_names(spark, sf)).select("ecosystem", "name", "target")


@query("u4_distinct_packages", with_ctes(PKGS, body="SELECT DISTINCT ecosystem, name, version FROM pkgs"))
def u4(spark, sf):
    p = packages(spark, sf)
    return sca.distinct_packages(p.filter("source_file = 'lock0'"), p)


@query("w10_sorted_packages", with_ctes(PKGS, body="SELECT DISTINCT repo, ecosystem, name, version FROM pkgs ORDER BY ALL"))
def w10(spark, sf):
    return sca.sorted_packages(packages(spark, sf))


@query("s13_sbom_components", with_ctes(PKGS, body="""SELECT DISTINCT repo, ecosystem, name, version,
  'pkg:' || CASE ecosystem WHEN 'crates.io' THEN 'cargo' WHEN 'Go' THEN 'golang' ELSE lower(ecosystem) END || '/' || name || '@' || version AS purl FROM pkgs"""))
def s13(spark, sf):
    return sca.sbom_components(packages(spark, sf))


@query("s13_sbom_documents", with_ctes(PKGS, body="SELECT repo, count(DISTINCT ecosystem || name || version) AS n_components, true AS valid FROM pkgs GROUP BY repo"))
def s13b(spark, sf):
    d = sca.sbom(packages(spark, sf))
    return d.select("repo", "n_components", (F.get_json_object("document", "$.specVersion") == "1.5").alias("valid"))


@query("s13_sbom_files", with_ctes(PKGS, body="SELECT repo, count(DISTINCT ecosystem || name || version) AS n_components FROM pkgs GROUP BY repo"))
def s13c(spark, sf):
    from ..session import scratch_path
    from ..sources import tree

    path = scratch_path(spark, "sbom")
    tree.write_sbom_documents(sca.sbom_components(packages(spark, sf)), path)
    docs = spark.read.option("multiLine", True).schema("specVersion string, components array<struct<purl:string>>").json(path)
    name = F.regexp_replace(F.substring_index(F.input_file_name(), "/", -1), r"\.cdx\.json$", "")
    # The name escapes the repository, and the path read back escapes the name.
    return docs.filter("specVersion = '1.5'").select(F.url_decode(F.url_decode(name)).alias("repo"), F.size("components").cast("long").alias("n_components"))


# ---- manifests, lockfiles and requirement files built from orders -------------------------------

MANIFEST = """mf AS (SELECT 'r' || (o_custkey % 60) AS repo, 'd' || o_orderkey || '/' || CASE o_orderkey % 8 WHEN 0 THEN 'package.json' WHEN 1 THEN 'go.mod' WHEN 2 THEN 'requirements.txt' WHEN 3 THEN 'package.json'
    WHEN 4 THEN 'pyproject.toml' WHEN 5 THEN 'requirements-dev.txt' WHEN 6 THEN 'pip.conf' ELSE 'Pipfile' END AS path,
  CASE WHEN o_orderkey % 8 = 0 THEN '{"dependencies": {"@s' || (o_custkey % 9) || '/x": "1.0", "lodash": "4"}}' WHEN o_orderkey % 8 = 3 THEN '{"name": "x"}'
    WHEN o_orderkey % 8 IN (2, 5, 6) THEN 'flask==' || (o_custkey % 3) || '.1 # pinned' || chr(10) || 'requests>=2' || chr(10) || '# note' || chr(10) || '--extra-index-url http://x' || chr(10) || 'a @ http://y' || chr(10) || 'numpy' ELSE '' END AS source, o_orderkey, o_custkey FROM orders),
lk AS (SELECT repo, regexp_extract(path, '^(.*/)', 1) || CASE o_orderkey % 8 WHEN 0 THEN 'yarn.lock' WHEN 1 THEN 'go.sum' WHEN 7 THEN 'Pipfile.lock' ELSE 'poetry.lock' END AS path, '' AS source FROM mf WHERE o_custkey % 3 = 0),
allf AS (SELECT repo, path, source FROM mf UNION ALL SELECT * FROM lk)"""


def manifest_files(spark, sf):
    o, k, c = B.table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    names = ("package.json", "go.mod", "requirements.txt", "package.json", "pyproject.toml", "requirements-dev.txt", "pip.conf", "Pipfile")
    req = F.concat(F.lit("flask=="), (c % 3).cast("string"), F.lit(".1 # pinned\nrequests>=2\n# note\n--extra-index-url http://x\na @ http://y\nnumpy"))
    src = (F.when(k % 8 == 0, F.concat(F.lit('{"dependencies": {"@s'), (c % 9).cast("string"), F.lit('/x": "1.0", "lodash": "4"}}')))
           .when(k % 8 == 3, '{"name": "x"}').when((k % 8).isin(2, 5, 6), req).otherwise(""))
    m = o.select(F.concat(F.lit("r"), (c % 60).cast("string")).alias("repo"), F.concat(F.lit("d"), k.cast("string"), F.lit("/")).alias("dir"),
                 F.get(F.array(*[F.lit(n) for n in names]), (k % 8).cast("int")).alias("name"), src.alias("source"), k.alias("k"), c.alias("c"))
    lock = F.when(F.col("k") % 8 == 0, "yarn.lock").when(F.col("k") % 8 == 1, "go.sum").when(F.col("k") % 8 == 7, "Pipfile.lock").otherwise("poetry.lock")
    locks = m.filter(F.col("c") % 3 == 0).select("repo", F.concat("dir", lock).alias("path"), F.lit("").alias("source"))
    return m.select("repo", F.concat("dir", "name").alias("path"), "source").unionByName(locks)


@query("j7_missing_lockfile", with_ctes(MANIFEST, body="""
SELECT repo, path AS file, regexp_extract(path, '[^/]*$') AS manifest FROM mf WHERE (o_orderkey % 8 IN (1, 4, 7) OR (o_orderkey % 8 = 0)) AND NOT (o_custkey % 3 = 0)"""))
def j7(spark, sf):
    return sca.missing_lockfile(manifest_files(spark, sf))


_RL = ", rl AS (SELECT repo, path, i AS line, l AS raw FROM (SELECT repo, path, unnest(string_split(source, chr(10))) AS l, generate_subscripts(string_split(source, chr(10)), 1) AS i FROM allf WHERE {0}))"


@query("f30_unpinned_requirements", with_ctes(MANIFEST, body=_RL.format("regexp_matches(path, '/requirements[^/]*\\.txt$')") + """
, t AS (SELECT repo, path AS file, line, trim(split_part(raw, '#', 1)) AS requirement FROM rl)
SELECT * FROM t WHERE requirement <> '' AND NOT regexp_matches(requirement, '^-|==| @ |://')"""))
def f30(spark, sf):
    return sca.unpinned_requirements(manifest_files(spark, sf))


@query("f31_extra_index", with_ctes(MANIFEST, body=_RL.format("regexp_extract(path, '[^/]*$') IN ('requirements.txt', 'requirements-dev.txt', 'pip.conf', 'pip.ini')") +
       " SELECT repo, path AS file, line, trim(raw) AS snippet FROM rl WHERE regexp_matches(trim(raw), '^(--)?extra-index-url')"))
def f31(spark, sf):
    return sca.extra_index(manifest_files(spark, sf))


@query("j8_unmapped_scopes", """
WITH asked AS (SELECT DISTINCT 'r' || (o_custkey % 60) AS repo, 'd' || (o_orderkey % 5) || '/' AS dir, list_extract(['acme', 'types', 'corp', 'inner', 'babel'], CAST(o_orderkey % 5 AS INT) + 1) || (o_custkey % 4) AS scope FROM orders WHERE o_orderkey % 7 > 0),
lock AS (SELECT 'r' || (o_custkey % 60) AS repo, 'd' || (o_orderkey % 5) || '/' AS dir, 'acme' || (o_custkey % 4) AS scope, bool_and(o_orderkey % 3 > 0) AS pub FROM orders WHERE o_orderkey % 11 = 0 GROUP BY ALL),
rc AS (SELECT DISTINCT 'r' || (c_custkey % 60) AS repo, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'd2/' END AS dir, 'corp' || (c_custkey % 4) AS scope FROM customer WHERE c_custkey % 13 = 0)
SELECT a.repo, a.dir, a.scope FROM asked a WHERE NOT EXISTS (SELECT 1 FROM lock l WHERE l.repo = a.repo AND l.dir = a.dir AND l.scope = a.scope AND l.pub)
  AND NOT EXISTS (SELECT 1 FROM rc WHERE rc.repo = a.repo AND rc.scope = a.scope AND (rc.dir = a.dir OR rc.dir = ''))""")
def j8(spark, sf):
    o, k, c = B.table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    repo, dir_ = F.concat(F.lit("r"), (c % 60).cast("string")).alias("repo"), F.concat(F.lit("d"), (k % 5).cast("string"), F.lit("/")).alias("dir")
    word = F.get(F.array(*[F.lit(w) for w in ("acme", "types", "corp", "inner", "babel")]), (k % 5).cast("int"))
    deps = o.select(repo, dir_, F.concat(F.lit("@"), word, (c % 4).cast("string"), F.lit("/x")).alias("name"), F.when(k % 7 > 0, "1.0").otherwise("workspace:*").alias("spec"))
    lock = o.filter(k % 11 == 0).select(repo, dir_, F.concat(F.lit("@acme"), (c % 4).cast("string"), F.lit("/y")).alias("name"),
                                        F.when(k % 3 > 0, "https://registry.npmjs.org/y").otherwise("https://private/y").alias("resolved"))
    ck = F.col("c_custkey")
    rc = B.table(spark, sf, "customer").filter(ck % 13 == 0).select(
        F.concat(F.lit("r"), (ck % 60).cast("string")).alias("repo"), F.when(ck % 2 == 0, "").otherwise("d2/").alias("dir"),
        F.concat(F.lit("@corp"), (ck % 4).cast("string"), F.lit(":registry=https://x")).alias("source"))
    return sca.unmapped_scopes(deps, lock, rc)


# npm lockfile documents: one per order, entries from its line items.
LOCKS = """ent AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax FROM lineitem),
one AS (SELECT l_orderkey, 'node_modules/p' || l_partkey AS key, max(l_suppkey) AS s, max(l_tax) AS t FROM ent GROUP BY ALL)"""


def npm_locks(spark, sf):
    one = B.table(spark, sf, "lineitem").groupBy("l_orderkey", F.concat(F.lit("node_modules/p"), F.col("l_partkey").cast("string")).alias("key")).agg(
        F.max("l_suppkey").alias("s"), F.max("l_tax").alias("t"))
    s = F.col("s")
    entry = F.struct(
        F.concat(F.lit("1."), s.cast("string")).alias("version"),
        F.when(s % 9 == 0, "file:../x").when(s % 4 > 0, "https://registry.npmjs.org/z").alias("resolved"),
        F.when(F.col("t") > 0.02, "sha512-x").alias("integrity"), F.when(s % 13 == 0, True).alias("link"),
        F.when(s % 5 == 0, True).alias("hasInstallScript"))
    docs = one.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("key", entry))).alias("packages"))
    return docs.select(
        F.concat(F.lit("r"), (F.col("l_orderkey") % 50).cast("string")).alias("repo"),
        F.concat(F.lit("d"), F.col("l_orderkey").cast("string"), F.lit("/package-lock.json")).alias("path"),
        F.to_json(F.struct("packages")).alias("source"))


_LIVE = "NOT (s % 13 = 0 OR s % 9 = 0)"


@query("s6_read_lockfiles", with_ctes(LOCKS, body="""SELECT 'r' || (l_orderkey % 50) AS repo, 'npm' AS ecosystem, substr(key, 14) AS name, '1.' || s AS version, 'd' || l_orderkey || '/package-lock.json' AS source_file FROM one"""))
def s6(spark, sf):
    return L.read_lockfiles(npm_locks(spark, sf))


@query("a14_missing_integrity", with_ctes(LOCKS, body=f"""SELECT 'r' || (l_orderkey % 50) AS repo, 'd' || l_orderkey || '/package-lock.json' AS path, count(*) FILTER (WHERE t <= 0.02 AND s % 4 > 0) AS missing, count(*) AS total
FROM one WHERE {_LIVE} GROUP BY l_orderkey HAVING missing > 0"""))
def a14(spark, sf):
    return sca.missing_integrity(npm_locks(spark, sf))


@query("a15_install_scripts", with_ctes(LOCKS, body=f"""SELECT 'r' || (l_orderkey % 50) AS repo, 'd' || l_orderkey || '/package-lock.json' AS file, substr(key, 14) AS package FROM one WHERE {_LIVE} AND s % 5 = 0"""))
def a15(spark, sf):
    return sca.install_scripts(npm_locks(spark, sf))


# OSV and RustSec documents from suppliers.
@query("s4_normalize_osv", f"""
SELECT 'OSV-' || s_suppkey AS id, 'note ' || s_name AS summary, CASE WHEN s_suppkey % 4 = 0 THEN CAST(7.5 AS DOUBLE) END AS score, CASE WHEN s_suppkey % 6 = 0 THEN 'unmaintained' END AS informational,
  CASE s_suppkey % 3 WHEN 0 THEN 'PyPI' ELSE 'npm' END AS ecosystem, lower(s_name) AS name, CASE WHEN s_suppkey % 5 > 0 THEN 1 ELSE 0 END AS n_ranges FROM supplier WHERE s_suppkey % 3 < 2""")
def s4(spark, sf):
    s, none = F.col("s_suppkey"), F.lit(None).cast("string")
    ev = F.array(F.struct(F.lit("0").alias("introduced"), none.alias("fixed"), none.alias("last_affected")), F.struct(none.alias("introduced"), F.lit("1.2").alias("fixed"), none.alias("last_affected")))
    docs = B.table(spark, sf, "supplier").select(
        F.concat(F.lit("OSV-"), s.cast("string")).alias("id"), F.concat(F.lit("note "), "s_name", F.lit("\nmore")).alias("summary"), none.alias("details"),
        F.array().cast("array<string>").alias("aliases"),
        F.when(s % 4 == 0, F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.lit("AV:N/C:H").alias("score")))).alias("severity"),
        F.struct(F.when(s % 6 == 0, "unmaintained").alias("informational")).alias("database_specific"),
        F.array(F.struct(
            F.struct(F.when(s % 3 == 0, "pypi").when(s % 3 == 1, "npm").otherwise("Debian").alias("ecosystem"), F.lower("s_name").alias("name")).alias("package"),
            F.array(F.struct(F.when(s % 5 > 0, "SEMVER").otherwise("GIT").alias("type"), ev.alias("events"))).alias("ranges"),
            F.array().cast("array<string>").alias("versions"))).alias("affected"))
    return RD.normalize_osv(docs).select("id", "summary", "score", "informational", "ecosystem", "name", F.size("ranges").alias("n_ranges"))


@query("s5_normalize_rustsec", """
SELECT 'RUSTSEC-' || s_suppkey AS id, lower(s_name) AS name, 'Title ' || s_suppkey AS summary, CASE WHEN s_suppkey % 2 = 0 THEN '>= 1.0, < 2.0|>= 2.1' ELSE '' END AS patched,
  CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END AS n_ranges FROM supplier""")
def s5(spark, sf):
    s = F.col("s_suppkey")
    text = F.concat(
        F.lit("```toml\n[advisory]\nid = \"RUSTSEC-"), s.cast("string"), F.lit("\"\npackage = \""), F.lower("s_name"), F.lit("\"\n\n[versions]\npatched = ["),
        F.when(s % 2 == 0, "\n  \">= 1.0, < 2.0\",\n  \">= 2.1\",\n").otherwise(""), F.lit("]\n```\n\n# Title "), s.cast("string"), F.lit("\nBody"))
    d = RD.normalize_rustsec(B.table(spark, sf, "supplier").select(text.alias("text")))
    return d.select("id", "name", "summary", F.array_join("patched", "|").alias("patched"), F.size("ranges").alias("n_ranges"))
