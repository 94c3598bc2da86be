"""Posture rules over crawled responses, certificates, ports and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..dims import reference as REF
from ..functions import scoring as S
from ..functions import text as TX

# Cookie names that carry a session, and version-bearing headers.
SESSION_WORDS = ("session", "sess", "token", "auth", "sid", "jwt", "csrf", "xsrf", "remember", "login")
BANNER_HEADERS = ("server", "x-powered-by", "x-aspnet-version", "x-generator")


def reveals_version(value: Column) -> Column:
    return value.rlike(r"[0-9]\.[0-9]")


def _header(name: str) -> Column:
    return F.get(F.filter("headers", lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def _finding(rule: str, severity, subject) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(rule).alias("invariant_id"), as_col(severity).alias("severity"), as_col(subject).alias("subject")
    )


def header_rules(observations: DataFrame) -> DataFrame:
    """HSTS, CSP, framing, sniffing, banner and redirect rules; one row per finding."""
    https = F.col("final_url").startswith("https://")
    html = F.coalesce(F.contains(F.lower(_header("content-type")), F.lit("text/html")), F.lit(False))
    csp = F.coalesce(_header("content-security-policy"), _header("content-security-policy-report-only"))
    framed = _header("x-frame-options").isNotNull() | F.coalesce(
        F.contains(F.lower(csp), F.lit("frame-ancestors")), F.lit(False)
    )
    nosniff = F.coalesce(F.lower(F.trim(_header("x-content-type-options"))) == "nosniff", F.lit(False))
    redirected = F.coalesce(F.lower("first_hop_location").startswith("https://"), F.lit(False))
    cases = [
        F.when(https & _header("strict-transport-security").isNull(), _finding("rt_missing_hsts", "Medium", "")),
        F.when(html & csp.isNull(), _finding("rt_missing_csp", "Low", "")),
        F.when(html & ~framed, _finding("rt_missing_frame_options", "Low", "")),
        F.when(~nosniff, _finding("rt_missing_content_type_options", "Low", "")),
        *[F.when(reveals_version(_header(h)), _finding("rt_server_banner", "Low", h)) for h in BANNER_HEADERS],
        F.when(
            F.col("url").startswith("http://") & F.col("first_hop_status").isNotNull() & ~redirected,
            _finding("rt_no_https_redirect", "Medium", ""),
        ),
    ]
    return observations.select("host", "url", F.inline(F.array_compact(F.array(*cases))))


def cookie_rules(observations: DataFrame) -> DataFrame:
    """Cookies missing Secure or HttpOnly; the value itself is never carried."""
    cookies = observations.select(
        "host", "url", F.col("final_url").startswith("https://").alias("https"),
        F.explode(F.filter("headers", lambda h: F.lower(h["name"]) == "set-cookie")).alias("h"),
    )
    attrs = F.transform(F.slice(F.split("h.value", ";"), F.lit(2), F.size(F.split("h.value", ";"))), lambda a: F.lower(F.trim(a)))
    name = F.trim(F.regexp_extract("h.value", "^([^=]*)", 1))
    session = F.lower(name).rlike("|".join(SESSION_WORDS))
    missing = F.array_compact(F.array(
        F.when(F.col("https") & ~F.array_contains(attrs, "secure"), F.lit("Secure")),
        F.when(session & ~F.array_contains(attrs, "httponly"), F.lit("HttpOnly")),
    ))
    return cookies.select(
        "host", "url", name.alias("cookie"), F.array_join(missing, " or ").alias("missing"),
        F.when(session, "Medium").otherwise("Low").alias("severity"),
    ).filter(F.col("missing") != "")


def port_severity(port: Column, target: Column) -> Column:
    """How bad an open port is; NULL when it is expected."""
    return (
        F.when(port == target, None)
        .when(port.isin(80, 443, 8080, 8443), None)
        .when(port.isin(23, 2375, 6379, 9200, 11211, 27017), "High")
        .when(port.isin(21, 445, 3306, 3389, 5432, 5900), "Medium")
        .otherwise("Low")
    )


def service_name(port: Column) -> Column:
    return F.coalesce(S.lookup(REF.SERVICE_NAMES, port.cast("int")), F.lit("unknown"))


def port_rules(observations: DataFrame) -> DataFrame:
    sev = port_severity(F.col("port"), F.col("target_port"))
    return observations.filter(F.col("open") & sev.isNotNull()).select(
        "host", "port", service_name(F.col("port")).alias("service"),
        F.lit("rt_open_port").alias("invariant_id"), sev.alias("severity"),
    )


DAY = 86_400
RENEWAL_DAYS = 14


def tls_rules(observations: DataFrame, now: int) -> DataFrame:
    """Expiry, trust and protocol of a handshake at a given time."""
    left = F.col("not_after") - now
    expired = left < 0
    weak = F.coalesce(F.col("handshake") == "incompatible", F.lit(False))
    reason = F.when(F.col("self_signed"), "self-signed").when(
        ~F.col("hostname_matches"), "wrong host"
    ).otherwise("untrusted chain")
    cases = [
        F.when(weak, _finding("rt_tls_weak_protocol", "High", "no modern protocol")),
        F.when(~weak & expired, _finding(
            "rt_tls_expired", "High", F.concat(F.lit("expired "), F.floor(-left / DAY).cast("string"), F.lit(" day(s) ago")))),
        F.when(~weak & ~expired & (left < RENEWAL_DAYS * DAY), _finding(
            "rt_tls_expired", "Medium", F.concat(F.lit("expires in "), F.floor(left / DAY).cast("string"), F.lit(" day(s)")))),
        F.when(~weak & ~F.col("chain_verified") & ~expired, _finding("rt_tls_untrusted_cert", "High", reason)),
    ]
    return observations.select("host", "port", F.inline(F.array_compact(F.array(*cases))))


def san_match(host: Column, sans: Column, subject: Column) -> Column:
    """A name equals the host or is a one-label wildcard; the CN counts only without SANs."""
    h = F.lower(host)
    cns = F.transform(
        F.filter(F.transform(F.split(subject, ","), lambda p: F.trim(p)), lambda p: p.startswith("CN=")),
        lambda p: p.substr(F.lit(4), F.length(p)),
    )
    names = F.transform(F.when(F.size(F.coalesce(sans, F.array().cast("array<string>"))) == 0, cns).otherwise(sans), F.lower)
    parent = F.regexp_extract(h, r"^[^.]*\.(.*)$", 1)
    return F.exists(
        names, lambda n: (n == h) | (n.startswith("*.") & F.contains(h, F.lit(".")) & (n.substr(F.lit(3), F.length(n)) == parent))
    )


def exposed_path_rules(paths: DataFrame) -> DataFrame:
    """Sensitive paths whose body carried the expected signature."""
    creds = F.create_map(*[x for p, _, c in REF.SENSITIVE_PATHS for x in (F.lit(p), F.lit(c))])[F.col("path")]
    what = F.create_map(*[x for p, w, _ in REF.SENSITIVE_PATHS for x in (F.lit(p), F.lit(w))])[F.col("path")]
    return paths.filter(F.col("matched") & creds.isNotNull()).select(
        "host", "path", "status", F.lit("rt_exposed_sensitive_path").alias("invariant_id"),
        F.when(creds, "High").otherwise("Medium").alias("severity"), what.alias("signature"),
    )


# ---- scope ------------------------------------------------------------------------

IPV4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def ipv4_number(text: Column) -> Column:
    """An IPv4 address as a number; NULL when it is not one."""
    octets = [F.regexp_extract(text, IPV4, i).try_cast("bigint") for i in range(1, 5)]
    ok = text.rlike(IPV4)
    for o in octets:
        ok = ok & (o <= 255)
    number = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(F.coalesce(ok, F.lit(False)), number)


def ipv6_hex(text: Column) -> Column:
    """An IPv6 address as 32 hex digits, so ranges compare as strings."""

    def groups(s: Column) -> Column:
        return F.filter(F.split(s, ":"), lambda g: g != "")

    def sides(parts: Column) -> Column:
        right = F.when(F.size(parts) > 1, groups(F.get(parts, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        return F.struct(
            F.size(parts).alias("n"), groups(F.get(parts, F.lit(0))).alias("left"), right.alias("right")
        )

    def fill(p: Column) -> Column:
        gap = 8 - F.size(p["left"]) - F.size(p["right"])
        whole = F.concat(p["left"], F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), p["right"])
        fits = F.when(p["n"] == 2, gap >= 1).otherwise((p["n"] == 1) & (F.size(p["left"]) == 8))
        return F.when(fits, whole)

    def join(full: Column) -> Column:
        return F.when(
            ~F.exists(full, lambda g: F.length(g) > 4),
            F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""),
        )

    t = F.lower(text)
    return F.when(
        t.rlike("^[0-9a-f:]+$") & F.contains(t, F.lit(":")),
        TX.let(F.split(t, "::"), lambda parts: TX.let(sides(parts), lambda p: TX.let(fill(p), join))),
    )


def parse_scope(entries: DataFrame) -> DataFrame:
    """Scope lines to ranges: ``kind`` v4, v6 or domain with ``lo``/``hi``; malformed lines go."""
    lines = entries.select(TX.once(F.trim(F.substring_index("entry", "#", 1))).alias("line")).filter(F.col("line") != "")
    line, addr = F.col("line"), F.substring_index("line", "/", 1)
    cidr = F.contains(line, F.lit("/"))
    prefix = F.when(cidr, F.regexp_extract(line, r"/(\d{1,3})$", 1).try_cast("int")).otherwise(F.lit(-1))
    parsed = lines.select(
        "line", cidr.alias("cidr"), F.lower(F.regexp_replace(addr, r"\.+$", "")).alias("domain"),
        TX.once(F.struct(ipv4_number(addr).alias("v4"), ipv6_hex(addr).alias("v6"), prefix.alias("prefix"))).alias("a"),
    ).select("line", "cidr", "domain", "a.*")
    v4, v6 = F.col("v4"), F.col("v6")
    p4 = F.when(F.col("prefix") == -1, 32).otherwise(F.col("prefix"))
    block = F.pow(F.lit(2.0), 32 - p4).cast("bigint")
    p6 = F.when(F.col("prefix") == -1, 128).otherwise(F.col("prefix"))
    # Nibbles before the boundary stay; the one it cuts is masked; the rest is filled.
    whole = F.floor(p6 / 4).cast("int")
    cut = (p6 % 4).cast("int")
    nibble = F.conv(F.substr(v6, whole + 1, F.lit(1)), 16, 10).cast("int")
    size = F.when(cut == 1, 8).when(cut == 2, 4).when(cut == 3, 2)
    low = F.when(cut == 0, F.lit("")).otherwise(F.lower(F.conv((nibble - nibble % size).cast("string"), 10, 16)))
    high = F.when(cut == 0, F.lit("")).otherwise(F.lower(F.conv((nibble - nibble % size + size - 1).cast("string"), 10, 16)))
    head = F.substr(v6, F.lit(1), whole)
    rows = parsed.select(
        F.when(v4.isNotNull() & (p4 <= 32), F.struct(
            F.lit("v4").alias("kind"),
            F.lpad((v4 - v4 % block).cast("string"), 10, "0").alias("lo"),
            F.lpad((v4 - v4 % block + block - 1).cast("string"), 10, "0").alias("hi")))
        .when(v6.isNotNull() & (p6 <= 128), F.struct(
            F.lit("v6").alias("kind"),
            F.rpad(F.concat(head, low), 32, "0").alias("lo"), F.rpad(F.concat(head, high), 32, "f").alias("hi")))
        .when(v4.isNull() & v6.isNull() & ~F.col("cidr"), F.struct(
            F.lit("domain").alias("kind"), F.col("domain").alias("lo"), F.col("domain").alias("hi"))).alias("s")
    )
    return rows.filter(F.col("s").isNotNull()).select("s.*").distinct()


def in_scope(hosts: DataFrame, scope: DataFrame) -> DataFrame:
    """Hosts with ``in_scope``; loopback always is, an empty scope allows nothing else.

    Domains expand to their suffixes and join by equality. Address ranges join
    on leading digits, so the range test runs inside a hash bucket instead of
    against every range.
    """
    labels = F.split("h", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    named = hosts.select("host").distinct().withColumn("h", F.lower(F.regexp_replace("host", r"\.+$", "")))
    parsed = named.withColumn(
        "a", TX.once(F.struct(ipv4_number(F.col("h")).alias("v4"), ipv6_hex(F.col("h")).alias("v6")))
    )
    distinct = parsed.select(
        "host", "h",
        F.when(F.col("a.v4").isNotNull(), F.lpad(F.col("a.v4").cast("string"), 10, "0")).otherwise(F.col("a.v6")).alias("addr"),
        F.when(F.col("a.v4").isNotNull(), "v4").when(F.col("a.v6").isNotNull(), "v6").otherwise("domain").alias("kind"),
        suffixes.alias("suffixes"),
    )
    by_name = distinct.filter(F.col("kind") == "domain").select("host", F.explode("suffixes").alias("lo")).join(
        scope.filter(F.col("kind") == "domain").select("lo"), "lo", "left_semi"
    ).select("host")
    parts = [by_name, *(_in_ranges(distinct, scope, kind) for kind in ("v4", "v6"))]
    allowed = parts[0]
    for p in parts[1:]:
        allowed = allowed.unionByName(p)
    allowed = allowed.distinct().withColumn("listed", F.lit(True))
    loopback = (
        (F.col("h") == "localhost") | ((F.col("kind") == "v4") & F.col("h").rlike(r"^127\."))
        | F.col("h").isin("0.0.0.0", "::1", "::")
    )
    verdict = distinct.join(allowed, "host", "left").select(
        "host", (loopback | F.coalesce("listed", F.lit(False))).alias("in_scope")
    )
    return hosts.join(verdict, "host")


def _bits(kind: str, address: str) -> Column:
    """An address's 32 or 128 bits as text, from its ten decimal or 32 hexadecimal digits."""
    if kind == "v4":
        return F.lpad(F.conv(F.col(address), 10, 2), 32, "0")
    halves = [F.lpad(F.conv(F.substring(address, at, 16), 16, 2), 64, "0") for at in (1, 17)]
    return F.concat(*halves)


def _in_ranges(hosts: DataFrame, scope: DataFrame, kind: str) -> DataFrame:
    """The hosts (host) of one kind whose address lies in a range of ``scope`` (kind, lo, hi).

    A range from an address and a prefix length is one aligned block, the bits that its two ends share. An address
    lies in it if it begins with these bits: it asks once for each block length that occurs, by equality, so no key
    gathers more than the addresses of its own block. Lengths are at most 129 small numbers.
    """
    ranges = scope.filter(F.col("kind") == kind).select(_bits(kind, "lo").alias("a"), _bits(kind, "hi").alias("b"))
    width = 32 if kind == "v4" else 128
    shared = F.array_max(F.filter(
        F.sequence(F.lit(0), F.lit(width)), lambda n: F.substr(F.col("a"), F.lit(1), n) == F.substr(F.col("b"), F.lit(1), n)
    ))
    blocks = ranges.select(F.substr(F.col("a"), F.lit(1), shared).alias("block")).distinct()
    lengths = sorted(r[0] for r in blocks.select(F.char_length("block")).distinct().collect())
    if not lengths:
        return hosts.select("host").filter(F.lit(False))
    bits = hosts.filter(F.col("kind") == kind).select("host", _bits(kind, "addr").alias("bits"))
    asked = bits.select("host", F.explode(F.array(*[F.substring("bits", 1, n) for n in lengths])).alias("block"))
    # A block that holds all addresses is no key: it is one for everybody.
    whole = F.col("block") == ""
    if lengths[0] == 0:
        return asked.filter(whole).select("host")
    return asked.join(blocks, "block", "left_semi").select("host")
