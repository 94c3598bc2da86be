"""Explicit schemas; nothing in the library infers one."""

from pyspark.sql import types as T

FINDING = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("invariant_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.LongType()),
    T.StructField("col", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("evidence", T.StringType()),
])

FILES = "repo string, path string, source string"

REPORT = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("ran", T.BooleanType()),
    T.StructField("findings", T.ArrayType(T.StructType([
        T.StructField("invariant_id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.LongType()),
        T.StructField("col", T.LongType()),
        T.StructField("message", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("evidence", T.StringType()),
    ]))),
])

OSV = """
  id string, summary string, details string, aliases array<string>,
  severity array<struct<type:string,score:string>>,
  database_specific struct<informational:string>,
  affected array<struct<
    package:struct<ecosystem:string,name:string>,
    ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,
    versions:array<string>>>
"""

EXPLOITS = """
  id string, name string, chain string, date date, loss_usd bigint,
  invariant_ids array<string>
"""

HTTP_OBSERVATION = """
  host string, url string, final_url string, status int,
  headers array<struct<name:string,value:string>>,
  first_hop_status int, first_hop_location string
"""

TLS_OBSERVATION = """
  host string, port int, protocol string, chain_verified boolean, verify_error string,
  subject string, issuer string, sans array<string>, not_before bigint, not_after bigint,
  self_signed boolean, hostname_matches boolean, handshake string, failure string
"""

PORT_OBSERVATION = "host string, port int, open boolean, target_port int"
PATH_OBSERVATION = "host string, path string, status int, matched boolean, bytes bigint"

ACCEPTANCE = """
  pos bigint, id string, path string, `match` string, reason string, owner string, until string
"""

COMMIT = "repo string, sha string, date date, author string, subject string, is_merge boolean"
COMMIT_FILE = """
  repo string, sha string, path string, added bigint, deleted bigint, is_source boolean, is_test boolean
"""
