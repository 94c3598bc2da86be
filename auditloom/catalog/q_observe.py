"""Posture queries: observations derived from pages, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import reference as REF
from ..operators import observe as O, secrets
from . import base as B
from .base import q, query, ql, with_ctes

# Each page answers with headers decided by its id.
HTTP = """obs AS (SELECT page_id, regexp_extract(url, '://([^/:?#]+)', 1) AS host, url, CASE WHEN page_id % 5 = 0 THEN replace(url, 'http://', 'https://') ELSE url END AS final_url,
  page_id % 3 = 0 AS hsts, page_id % 4 > 0 AS html, page_id % 6 AS csp, page_id % 7 = 0 AS xfo, page_id % 2 = 0 AS nosniff, page_id % 8 AS srv,
  CASE WHEN page_id % 9 > 0 THEN 301 END AS hop, CASE WHEN page_id % 2 = 0 THEN 'https://x' WHEN page_id % 3 = 0 THEN 'http://x' END AS loc FROM pages)"""


def http(spark, sf):
    p, k = B.table(spark, sf, "pages"), F.col("page_id")
    h = lambda n, v, c: F.when(c, F.struct(F.lit(n).alias("name"), (v if not isinstance(v, str) else F.lit(v)).alias("value")))
    cookie = F.concat(F.when(k % 2 == 0, "sid").otherwise("theme"), F.lit("=v"), k.cast("string"), F.when(k % 3 == 0, "; Secure").otherwise(""), F.when(k % 5 == 0, "; HttpOnly; Path=/").otherwise(""))
    return p.select(
        F.regexp_extract("url", B.HOST_RE, 1).alias("host"), "url", F.when(k % 5 == 0, F.replace("url", F.lit("http://"), F.lit("https://"))).otherwise(F.col("url")).alias("final_url"),
        F.lit(200).alias("status"),
        F.array_compact(F.array(
            h("Strict-Transport-Security", "max-age=1", k % 3 == 0), h("content-type", "text/HTML; charset=utf-8", k % 4 > 0),
            h("content-security-policy", "default-src 'self'", k % 6 == 0), h("content-security-policy-report-only", "frame-Ancestors 'none'", k % 6 == 1),
            h("x-frame-options", "DENY", k % 7 == 0), h("x-content-type-options", " NoSniff ", k % 2 == 0),
            h("server", "nginx/1.18.0", k % 8 == 0), h("server", "nginx", k % 8 == 1), h("x-powered-by", "PHP/8.1", k % 8 == 2),
            h("set-cookie", cookie, k % 10 < 7), h("Set-Cookie", "jwt_token=abc; secure", k % 10 == 3))).alias("headers"),
        F.when(k % 9 > 0, 301).alias("first_hop_status"), F.when(k % 2 == 0, "https://x").when(k % 3 == 0, "http://x").alias("first_hop_location"), "page_id")


@query("f16_header_rules", with_ctes(HTTP, body="""
, r AS (SELECT *, starts_with(final_url, 'https://') AS https FROM obs)
SELECT host, url, 'rt_missing_hsts' AS invariant_id, 'Medium' AS severity, '' AS subject FROM r WHERE https AND NOT hsts
UNION ALL SELECT host, url, 'rt_missing_csp', 'Low', '' FROM r WHERE html AND csp > 1
UNION ALL SELECT host, url, 'rt_missing_frame_options', 'Low', '' FROM r WHERE html AND NOT (xfo OR csp = 1)
UNION ALL SELECT host, url, 'rt_missing_content_type_options', 'Low', '' FROM r WHERE NOT nosniff
UNION ALL SELECT host, url, 'rt_server_banner', 'Low', 'server' FROM r WHERE srv = 0
UNION ALL SELECT host, url, 'rt_server_banner', 'Low', 'x-powered-by' FROM r WHERE srv = 2
UNION ALL SELECT host, url, 'rt_no_https_redirect', 'Medium', '' FROM r WHERE starts_with(url, 'http://') AND hop IS NOT NULL AND NOT coalesce(starts_with(loc, 'https://'), false)"""))
def f16(spark, sf):
    return O.header_rules(http(spark, sf))


@query("f17_cookie_rules", with_ctes(HTTP, body="""
, c AS (SELECT host, url, starts_with(final_url, 'https://') AS https, CASE WHEN page_id % 2 = 0 THEN 'sid' ELSE 'theme' END AS cookie, page_id % 3 = 0 AS sec, page_id % 5 = 0 AS ho, page_id % 2 = 0 AS ses FROM obs WHERE page_id % 10 < 7
  UNION ALL SELECT host, url, starts_with(final_url, 'https://'), 'jwt_token', true, false, true FROM obs WHERE page_id % 10 = 3),
m AS (SELECT *, CASE WHEN https AND NOT sec AND ses AND NOT ho THEN 'Secure or HttpOnly' WHEN https AND NOT sec THEN 'Secure' WHEN ses AND NOT ho THEN 'HttpOnly' ELSE '' END AS missing FROM c)
SELECT host, url, cookie, missing, CASE WHEN ses THEN 'Medium' ELSE 'Low' END AS severity FROM m WHERE missing <> ''"""))
def f17(spark, sf):
    return O.cookie_rules(http(spark, sf))


@query("r12_redact_cookie", "SELECT page_id, 'sid' || (page_id % 3) || '=<redacted>' || CASE WHEN page_id % 2 = 0 THEN '; Secure; Path=/' ELSE '' END AS cookie FROM pages")
def r12c(spark, sf):
    k = F.col("page_id")
    raw = F.concat(F.lit("sid"), (k % 3).cast("string"), F.lit("=v=x"), k.cast("string"), F.when(k % 2 == 0, "; Secure; Path=/").otherwise(""))
    return B.table(spark, sf, "pages").select("page_id", secrets.redact_cookie(raw).alias("cookie"))


@query("f18_reveals_version", "SELECT doc_id, regexp_matches(text, '[0-9]\\.[0-9]') AS reveals FROM documents")
def f18(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", O.reveals_version(F.col("text")).alias("reveals"))


PORTS = (21, 22, 23, 25, 80, 443, 445, 2375, 3306, 5432, 6379, 8080, 9200, 27017, 31337)


@query("f19_port_rules", f"""
WITH p AS (SELECT 'h' || (c_custkey % 300) AS host, {str(list(PORTS))}[CAST(c_custkey % 15 AS INT) + 1] AS port, c_custkey % 4 > 0 AS open, CASE WHEN c_custkey % 5 = 0 THEN 6379 ELSE 443 END AS target FROM customer)
SELECT host, port, CASE port {" ".join(f"WHEN {p} THEN {q(n)}" for p, n in REF.SERVICE_NAMES.items())} ELSE 'unknown' END AS service, 'rt_open_port' AS invariant_id,
  CASE WHEN port IN (23, 2375, 6379, 9200, 11211, 27017) THEN 'High' WHEN port IN (21, 445, 3306, 3389, 5432, 5900) THEN 'Medium' ELSE 'Low' END AS severity
FROM p WHERE open AND port <> target AND port NOT IN (80, 443, 8080, 8443)""")
def f19(spark, sf):
    k = F.col("c_custkey")
    obs = B.table(spark, sf, "customer").select(
        F.concat(F.lit("h"), (k % 300).cast("string")).alias("host"), F.get(F.array(*[F.lit(p) for p in PORTS]), (k % 15).cast("int")).alias("port"),
        (k % 4 > 0).alias("open"), F.when(k % 5 == 0, 6379).otherwise(443).alias("target_port"))
    return O.port_rules(obs)


NOW = 1704067200
TLS = f"""tls AS (SELECT c_custkey, 'h' || c_custkey AS host, 443 AS port, {NOW} + (c_custkey % 60 - 20) * 86400 + c_custkey % 1000 AS na, c_custkey % 3 > 0 AS ok, c_custkey % 5 = 0 AS self, c_custkey % 7 > 0 AS nm, c_custkey % 41 = 0 AS weak FROM customer)"""


def tls(spark, sf):
    k = F.col("c_custkey")
    return B.table(spark, sf, "customer").select(
        F.concat(F.lit("h"), k.cast("string")).alias("host"), F.lit(443).alias("port"), (F.lit(NOW) + (k % 60 - 20) * 86400 + k % 1000).alias("not_after"),
        (k % 3 > 0).alias("chain_verified"), (k % 5 == 0).alias("self_signed"), (k % 7 > 0).alias("hostname_matches"), F.when(k % 41 == 0, "incompatible").alias("handshake"))


@query("f20_tls_rules", with_ctes(TLS, body=f"""
SELECT host, port, 'rt_tls_weak_protocol' AS invariant_id, 'High' AS severity, 'no modern protocol' AS subject FROM tls WHERE weak
UNION ALL SELECT host, port, 'rt_tls_expired', 'High', 'expired ' || CAST(floor(({NOW} - na) / 86400) AS BIGINT) || ' day(s) ago' FROM tls WHERE NOT weak AND na < {NOW}
UNION ALL SELECT host, port, 'rt_tls_expired', 'Medium', 'expires in ' || CAST(floor((na - {NOW}) / 86400) AS BIGINT) || ' day(s)' FROM tls WHERE NOT weak AND na >= {NOW} AND na - {NOW} < 14 * 86400
UNION ALL SELECT host, port, 'rt_tls_untrusted_cert', 'High', CASE WHEN self THEN 'self-signed' WHEN NOT nm THEN 'wrong host' ELSE 'untrusted chain' END FROM tls WHERE NOT weak AND NOT ok AND na >= {NOW}"""))
def f20(spark, sf):
    return O.tls_rules(tls(spark, sf), NOW)


@query("j12_san_match", """
WITH c AS (SELECT c_custkey, 'A' || (c_custkey % 9) || '.example.com' AS host, CASE c_custkey % 4 WHEN 0 THEN ['*.EXAMPLE.com'] WHEN 1 THEN ['a' || (c_custkey % 6) || '.example.com', 'x'] WHEN 2 THEN ['*.a1.example.com'] ELSE [] END AS sans,
  'O=x, CN=a' || (c_custkey % 5) || '.example.com' AS subject FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN list_contains(sans, lower(host)) WHEN 2 THEN false ELSE lower(host) = 'a' || (c_custkey % 5) || '.example.com' END AS matches FROM c""")
def j12(spark, sf):
    k, s = F.col("c_custkey"), lambda m: (F.col("c_custkey") % m).cast("string")
    sans = (F.when(k % 4 == 0, F.array(F.lit("*.EXAMPLE.com"))).when(k % 4 == 1, F.array(F.concat(F.lit("a"), s(6), F.lit(".example.com")), F.lit("x")))
            .when(k % 4 == 2, F.array(F.lit("*.a1.example.com"))).otherwise(F.array().cast("array<string>")))
    host = F.concat(F.lit("A"), s(9), F.lit(".example.com"))
    return B.table(spark, sf, "customer").select("c_custkey", O.san_match(host, sans, F.concat(F.lit("O=x, CN=a"), s(5), F.lit(".example.com"))).alias("matches"))


_PATHS = [p for p, _, _ in REF.SENSITIVE_PATHS] + ["/index.html"]


@query("f21_exposed_path_rules", f"""
WITH p AS (SELECT 'h' || (o_custkey % 700) AS host, {ql(_PATHS)}[CAST(o_orderkey % 10 AS INT) + 1] AS path, 200 AS status, o_orderkey % 3 = 0 AS m FROM orders)
SELECT host, path, status, 'rt_exposed_sensitive_path' AS invariant_id, CASE path {" ".join(f"WHEN {q(p)} THEN {q('High' if c else 'Medium')}" for p, _, c in REF.SENSITIVE_PATHS)} END AS severity,
  CASE path {" ".join(f"WHEN {q(p)} THEN {q(w)}" for p, w, _ in REF.SENSITIVE_PATHS)} END AS signature FROM p WHERE m AND path <> '/index.html'""")
def f21(spark, sf):
    k = F.col("o_orderkey")
    return O.exposed_path_rules(B.table(spark, sf, "orders").select(
        F.concat(F.lit("h"), (F.col("o_custkey") % 700).cast("string")).alias("host"), F.get(F.array(*[F.lit(p) for p in _PATHS]), (k % 10).cast("int")).alias("path"),
        F.lit(200).alias("status"), (k % 3 == 0).alias("matched")))


# Hosts: page hosts and addresses made from customers; scope: suppliers name networks and domains.
HOSTS = """hosts AS (SELECT DISTINCT regexp_extract(url, '://([^/:?#]+)', 1) AS host FROM pages
  UNION SELECT (c_custkey % 200) || '.' || (c_custkey % 7) || '.' || (c_custkey % 11) || '.' || (c_custkey % 251) FROM customer UNION SELECT '127.0.0.' || (c_custkey % 3) FROM customer UNION SELECT 'localhost')"""
SCOPE = """scope AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN (s_suppkey % 200) || '.' || (s_suppkey % 7) || '.0.0/' || (8 + s_suppkey % 17) WHEN 1 THEN (s_suppkey % 200) || '.' || (s_suppkey % 7) || '.' || (s_suppkey % 11) || '.' || (s_suppkey % 251)
  WHEN 2 THEN CASE WHEN s_suppkey % 8 = 2 THEN 'example.net' ELSE 'nothing' || s_suppkey || '.org' END ELSE '300.1.1.1/8' END AS entry FROM supplier)"""


def hosts(spark, sf):
    k = F.col("c_custkey")
    c = B.table(spark, sf, "customer")
    a = B.table(spark, sf, "pages").select(F.regexp_extract("url", B.HOST_RE, 1).alias("host"))
    b = c.select(F.concat_ws(".", (k % 200).cast("string"), (k % 7).cast("string"), (k % 11).cast("string"), (k % 251).cast("string")).alias("host"))
    l = c.select(F.concat(F.lit("127.0.0."), (k % 3).cast("string")).alias("host"))
    return a.unionByName(b).unionByName(l).unionByName(c.select(F.lit("localhost").alias("host"))).distinct()


def scope(spark, sf):
    k, t = F.col("s_suppkey"), lambda m: (F.col("s_suppkey") % m).cast("string")
    return B.table(spark, sf, "supplier").select(
        F.when(k % 4 == 0, F.concat(F.concat_ws(".", t(200), t(7), F.lit("0"), F.lit("0")), F.lit("/"), (8 + k % 17).cast("string")))
        .when(k % 4 == 1, F.concat_ws(".", t(200), t(7), t(11), t(251)))
        .when(k % 8 == 2, "example.net").when(k % 4 == 2, F.concat(F.lit("nothing"), k.cast("string"), F.lit(".org"))).otherwise("300.1.1.1/8").alias("entry"))


_IP = "CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT)"


@query("j11_in_scope", with_ctes(HOSTS, SCOPE, body=f"""
, v4 AS (SELECT {_IP.format("split_part(entry, '/', 1)")} AS net, CAST(pow(2, 32 - CASE WHEN contains(entry, '/') THEN CAST(split_part(entry, '/', 2) AS INT) ELSE 32 END) AS BIGINT) AS size FROM scope WHERE regexp_matches(entry, '^[0-9]') AND NOT starts_with(entry, '300')),
dm AS (SELECT entry AS d FROM scope WHERE NOT regexp_matches(entry, '^[0-9]')),
ip AS (SELECT host, {_IP.format("host")} AS n FROM hosts WHERE regexp_matches(host, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$'))
SELECT h.host, h.host = 'localhost' OR starts_with(h.host, '127.') OR h.host = '0.0.0.0'
  OR EXISTS (SELECT 1 FROM ip JOIN v4 ON ip.n // v4.size = v4.net // v4.size WHERE ip.host = h.host) OR EXISTS (SELECT 1 FROM dm WHERE h.host = d OR h.host LIKE '%.' || d) AS in_scope FROM hosts h"""))
def j11(spark, sf):
    return O.in_scope(hosts(spark, sf), O.parse_scope(scope(spark, sf)))
