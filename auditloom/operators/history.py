"""Change history: commit scoring, churn, late changes, areas, authorship."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as TX
from ..session import cut_lineage
from . import corpus
from .keyed import first_by, join_keys

# Commit intent in priority order (pattern, base score, reason).
INTENT = (
    ("security_explicit", r"(?i)\b(security|vulnerab|exploit|attack|CVE-\d|audit)\b|\b(reentran|overflow|underflow|front.?run|malleab|replay)\w*", 8, "explicit security language"),
    ("urgent_fix", r"(?i)\b(hotfix|emergency|critical|IMPT)\b", 6, "urgent/critical fix"),
    ("bug_fix", r"(?i)\bfix(es|ed)?\b|\bbug\b|\bpatch\b|\bbroken\b", 4, "bug fix"),
    ("hardening", r"(?i)\b(harden|mitigat|protect|restrict|sanitiz|validat)\w*", 2, "hardening/validation"),
    ("feature", r"(?i)^\s*(feat|add|implement|introduce|support)\b", -1, "feature addition"),
    ("maintenance", r"(?i)^\s*(docs?|chore|ci|test|style|build)\s*:|\b(readme|typo|format|lint|rename|refactor|cleanup|comment)\b|\bchange\s+\w+\s+to\s+\w+\b", -3, "maintenance/cosmetic"),
)
KNOWN_VULNERABILITY = "involves known vulnerability pattern"
TOPICS = (
    (r"(?i)\b(oracle|price|liquidat|slippage|MEV|pyth|switchboard|chainlink)\w*", "involves oracle/pricing"),
    (r"(?i)\b(reentran|overflow|underflow|front.?run)\w*", KNOWN_VULNERABILITY),
    (r"(?i)\b(ecrecover|permit|signature|nonce|signer|ed25519|secp256k1)\w*", "involves signatures/auth"),
    (r"(?i)\b(upgrade|proxy|migrat|authority|admin|owner|cap(ability)?)\w*", "involves admin/upgrade authority"),
    (r"(?i)\b(rent|lamport|pda|seed|bump|cpi|sysvar)\w*", "involves Solana account model"),
    (r"(?i)\b(ttl|storage|require_auth|instance|persistent|temporary)\w*", "involves Soroban storage/auth"),
)
_GUARDS = r"\b(require|revert|assert|require!|assert!|ensure!|abort|require_auth|checked_(add|sub|mul|div))\b"
_ACCESS = r"(\b(onlyOwner|onlyRole|onlyAdmin|nonReentrant|whenNotPaused|initializer|modifier\s+only)\b|Signer<|has_one\s*=|constraint\s*=|#\[access_control|require_auth\(|&signer\b|[A-Z]\w*Cap\b)"
DIFF_CHANGES = (
    (r"(\b(safeTransfer\w*|transferFrom)\b|\.transfer\(|\.call\{value|lamports\(\)|token::transfer|coin::(withdraw|deposit|take|split|join)|balance::(join|split)|transfer::(public_)?transfer|env\.storage\(\))", 2, "changes value-transfer logic"),
    (r"\b(ecrecover|permit|ECDSA|EIP.?712|nonce|ed25519|secp256k1|durable|require_auth)\b", 2, "changes signature/auth handling"),
    (r"\b(_authorizeUpgrade|upgradeTo\w*|upgrade_authority|update_current_contract_wasm|deploy_with_address|set_upgrade|UpgradeCap|publish_upgrade|code_object)\b", 2, "changes upgrade path"),
    (r"\b(balance\w*|totalSupply|total_supply|exchangeRate|index\b|reserve\w*|supply\b)", 1, "changes accounting/balance logic"),
)
# Security areas by content.
AREAS = {
    "access_control": r"onlyOwner|onlyRole|modifier\s+only|OwnableRoles|AccessControl|require\(msg\.sender|Ownable2Step|_checkOwner|hasRole|_checkRole|onlyAdmin|Signer<|has_one\s*=|is_signer|#\[access_control|signer::address_of|&signer\b|[A-Z]\w*Cap\b|friend\s+|require_auth\(",
    "fund_flows": r"\.deposit\(|\.withdraw\(|\.transfer\(|\.mint\(|\.burn\(|collateral|safeTransfer|balanceOf|allowance|approve|_pay\b|_collect\b|function\s+deposit|function\s+withdraw|lamports|token::transfer|token::mint_to|token::burn|CpiContext|coin::(withdraw|deposit|take|split|join|mint|burn)|balance::(join|split)|Coin<|Balance<|transfer::(public_)?transfer|env\.storage\(\)|token::Client|StellarAssetClient",
    "oracle_price": r"oracle|[Pp]rice|[Ff]eed|TWAP|markPrice|indexPrice|latestRoundData|getPrice|EMA|pyth|switchboard",
    "liquidation": r"liquidat|backstop|ADL|[Dd]eleverage|[Ii]nsurance|insolvenc|bankruptcy|badDebt|isLiquidatable|health_factor",
    "signatures": r"ecrecover|permit|[Ss]ignature|EIP.?712|ECDSA|nonce|digest|_hashTypedData|v,\s*r,\s*s|ed25519|secp256k1|durable|Instructions::|sysvar::instructions",
    "state_machines": r"[Ss]tatus\s*=|[Ss]tate\s*=|Phase\b|Stage\b|[Ll]ifecycle|[Tt]ransition|[Pp]aused|[Ff]rozen|isActive|onlyActive|whenNotPaused|is_initialized|initialized\s*[:=]",
    "upgrade_paths": r"_authorizeUpgrade|upgradeTo|UUPSUpgradeable|TransparentUpgradeableProxy|ERC1967|delegatecall|upgrade_authority|bpf_loader_upgradeable|update_current_contract_wasm|deployer\(\)|UpgradeCap|publish_upgrade|code_object|managed_coin|resource_account",
}
FIX_THRESHOLD = 5
BULK_SHARE = 0.85

# Vendored libraries (label, name patterns, expected compiler pragmas).
KNOWN_LIBS = (
    ("OpenZeppelin", ("openzeppelin-contracts", "openzeppelin"), ("0.8.",)),
    ("Solady", ("solady",), ("0.8.",)),
    ("Solmate", ("solmate",), (">=0.8.", "0.8.")),
    ("Uniswap V2", ("uniswap", "univ2", "gte-univ2", "v2-core", "v2-periphery"), (">=0.5.", "=0.5.", ">=0.6.", "=0.6.")),
    ("Uniswap V3", ("v3-core", "v3-periphery", "uniswap-v3"), (">=0.5.", "=0.7.", ">=0.7.")),
    ("Uniswap V4", ("v4-core", "v4-periphery"), ("0.8.",)),
    ("Aave", ("aave",), ("0.8.",)),
    ("Chainlink", ("chainlink",), ("0.8.", "0.6.")),
    ("Permit2", ("permit2",), ("0.8.",)),
    ("LayerZero", ("layerzero", "lz-"), ("0.8.",)),
    ("Anchor (Solana)", ("anchor-lang", "anchor-spl", "anchor"), ()),
    ("SPL (Solana)", ("spl-token", "solana-program-library", "spl"), ()),
    ("Soroban SDK", ("soroban-sdk", "soroban"), ()),
    ("Aptos Framework", ("aptos-framework", "aptos-core", "aptos"), ()),
    ("Sui Framework", ("sui-framework", "sui"), ()),
    ("Pyth", ("pyth",), ("0.8.",)),
)


def commit_intent(subject: Column) -> dict[str, Column]:
    """Category, score and reasons of a commit message (first category wins)."""
    category = base = reason = None
    for name, pattern, score, why in INTENT:
        hit = subject.rlike(pattern)
        category = F.when(hit, name) if category is None else category.when(hit, name)
        base = F.when(hit, score) if base is None else base.when(hit, score)
        reason = F.when(hit, why) if reason is None else reason.when(hit, why)
    base, reason = base.otherwise(0), reason.otherwise("unclassified")
    category = category.otherwise("unclassified")
    tags = F.array_compact(F.array(*[
        F.when(
            subject.rlike(p) & (F.lit(t != KNOWN_VULNERABILITY) | (category != "security_explicit")), F.lit(t)
        )
        for p, t in TOPICS
    ]))
    tags = F.when(base >= 0, tags).otherwise(F.array().cast("array<string>"))
    return {
        "category": category,
        "intent_score": base + 2 * F.size(tags),
        "intent_reasons": F.concat(F.array(reason), tags),
    }


def diff_structure(diff: Column) -> Column:
    """Array of (points, reason) from added and removed lines of a diff."""
    count = lambda sign, p: F.size(F.regexp_extract_all(diff, F.lit(rf"(?m)^{sign}[^{sign}].*{p}"), F.lit(0)))

    def balance(pattern: str, more: str, fewer: str, same: str) -> Column:
        a, r = count(r"\+", pattern), count("-", pattern)
        label = lambda text: F.concat(F.lit(f"{text} (+"), a.cast("string"), F.lit("/-"), r.cast("string"), F.lit(")"))
        return F.when(a + r > 0, F.struct(
            F.when(a == r, 2).otherwise(3).alias("points"),
            F.when(a > r, label(more)).when(r > a, label(fewer)).otherwise(label(same)).alias("reason"),
        ))

    return F.array_compact(F.array(
        balance(_GUARDS, "adds runtime guards", "removes runtime guards", "rewrites runtime guards"),
        balance(_ACCESS, "tightens access control", "loosens access control", "rewrites access control"),
        *[
            F.when(diff.rlike(rf"(?m)^[+-][^+-].*{p}"), F.struct(F.lit(n).alias("points"), F.lit(why).alias("reason")))
            for p, n, why in DIFF_CHANGES
        ],
    ))


def diff_points(diff: Column) -> Column:
    return F.coalesce(F.aggregate(diff_structure(diff), F.lit(0), lambda a, x: a + x["points"]), F.lit(0))


def file_areas(files: DataFrame, areas: dict[str, str] = AREAS) -> DataFrame:
    """Security areas a file's content touches, one row per (file, area)."""
    found = F.array_compact(F.array(*[F.when(TX.search(F.col("source"), p), F.lit(a)) for a, p in areas.items()]))
    return files.select("repo", "path", F.explode(found).alias("area"))


#: A commit and a file are known by their repository and sha or path; histories of several repositories share both.
COMMIT, FILE = ["repo", "sha"], ["repo", "path"]


#: Areas that one word of bits holds.
WORD = 63


def _area_bits(areas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo, path, word, bits) of every file, and (word, bit, area): areas as bits of as many words as they need.

    Both are written aside, so that Spark sees their size.
    """
    known = cut_lineage(areas.select(*FILE, "area").distinct(), "areas")
    no = F.row_number().over(Window.orderBy("area")) - 1
    names = known.select("area").distinct().withColumn("_no", no).select(
        F.floor(F.col("_no") / WORD).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_no") % WORD).alias("bit"), "area",
    )
    names = cut_lineage(names, "areas")
    files = join_keys(known, names, ["area"]).groupBy(*FILE, "word").agg(F.bit_or("bit").alias("bits"))
    return cut_lineage(files, "areas"), names


def _commit_bits(commit_files: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, sha, word, bits): the areas of a commit's files. A file's areas are one number, not a row each, until its commit is one row."""
    return commit_files.select(*COMMIT, "path").join(files, FILE).groupBy(*COMMIT, "word").agg(F.bit_or("bits").alias("bits"))


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with one row an area instead of their bits."""
    return rows.join(names, "word").filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).drop("word", "bits", "bit")


def commit_domains(commit_files: DataFrame, areas: DataFrame) -> DataFrame:
    """(repo, commit, area) of a commit's files."""
    files, names = _area_bits(areas)
    return _named(_commit_bits(commit_files, files), names).select(*COMMIT, "area")


def commit_shape(commit_files: DataFrame) -> DataFrame:
    """Per commit: source files, added and deleted source lines, test files."""
    src = F.col("is_source")
    return commit_files.groupBy(*COMMIT).agg(
        F.count_if(src).alias("n_source"), F.count_if("is_test").alias("n_test"),
        F.sum(F.when(src, F.col("added")).otherwise(0)).alias("src_added"),
        F.sum(F.when(src, F.col("deleted")).otherwise(0)).alias("src_deleted"),
    )


def _live(commits: DataFrame, *columns: str) -> DataFrame:
    """Commits that are no merges."""
    return commits.filter(~F.col("is_merge")).select(*COMMIT, *columns)


def _top(rows: DataFrame, k: int, order: list[Column], keys: Sequence[str] = ("repo",)) -> DataFrame:
    """The first ``k`` rows of every key. The limit is applied before rows are sent, so a key of any size costs a task k rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def score_commits(
    commits: DataFrame, commit_files: DataFrame, areas: DataFrame, diff: str | None = None
) -> DataFrame:
    """Intent + structure + domain + shape, never below zero; merges excluded. ``diff`` names a column of commits."""
    files, _ = _area_bits(areas)
    domains = _commit_bits(commit_files.filter("is_source"), files).groupBy(*COMMIT).agg(
        F.sum(F.bit_count("bits")).alias("n_domains")
    )
    m = commits.filter(~F.col("is_merge")).join(commit_shape(commit_files), COMMIT, "left").join(domains, COMMIT, "left")
    m = m.na.fill(0, ["n_source", "n_test", "src_added", "src_deleted", "n_domains"])
    churn = F.col("src_added") + F.col("src_deleted")
    shape = (
        F.when(F.col("n_source").between(1, 3), 2).otherwise(0)
        + F.when(F.col("src_deleted") > F.col("src_added"), 1).otherwise(0)
        - F.when(churn > 2000, 4).when(churn > 500, 2).otherwise(0)
        + F.when(F.col("n_test") > 0, 1).otherwise(0)
    )
    domain = F.when(F.col("n_domains") >= 2, 3).when(F.col("n_domains") == 1, 1).otherwise(0)
    structure = diff_points(F.col(diff)) if diff else F.lit(0)
    intent = commit_intent(F.col("subject"))
    total = F.when(F.col("n_source") > 0, intent["intent_score"] + structure + domain + shape).otherwise(intent["intent_score"])
    return m.select(
        *commits.columns, "n_source", "n_test", churn.alias("source_churn"), "n_domains",
        intent["category"].alias("category"),
        F.greatest(total, F.lit(0)).cast("long").alias("score"),
    )


def fix_candidates(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` commits of every repository that most look like fixes."""
    order = [F.desc("score"), F.desc("date"), F.desc("sha")]
    return _top(scored.filter(F.col("score") > 0), k, order).drop("rank")


def fix_stats(scored: DataFrame, commit_files: DataFrame) -> DataFrame:
    fixes = scored.filter(F.col("score") >= FIX_THRESHOLD).select(*COMMIT, "score")
    return commit_files.filter("is_source").join(fixes, COMMIT).groupBy(*FILE).agg(
        F.count("*").alias("fix_commits"), F.sum("score").alias("fix_score")
    )


def churn_hotspots(commits: DataFrame, commit_files: DataFrame, live: DataFrame, fixes: DataFrame, k: int) -> DataFrame:
    """Most-changed live files of every repository with fix share and last touch."""
    touched = commit_files.filter("is_source").join(_live(commits, "date"), COMMIT)
    per_file = touched.groupBy(*FILE).agg(F.count("*").alias("changes"), F.max("date").alias("last_touched"))
    rows = per_file.join(live.select(*FILE).distinct(), FILE, "left_semi").join(fixes, FILE, "left").na.fill(0, ["fix_commits"])
    return _top(rows, k, [F.desc("changes"), F.col("path")]).select(
        *FILE, "changes", "fix_commits", (F.col("fix_commits") / F.col("changes")).alias("fix_ratio"), "last_touched"
    )


def fix_prone_files(scored: DataFrame, commit_files: DataFrame, k: int) -> DataFrame:
    return _top(fix_stats(scored, commit_files), k, [F.desc("fix_score"), F.desc("fix_commits"), F.col("path")]).drop("rank")


def repo_shape(commits: DataFrame, commit_files: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Whole-history shape of every repository: empty, squashed import or normal development.

    ``repos(repo)`` adds repositories without a commit.
    """
    shape = commit_shape(commit_files).filter(F.col("n_source") > 0)
    source = shape.join(commits.select(*COMMIT), COMMIT, "left_semi").groupBy("repo").agg(
        F.count("*").alias("source_commits"), F.sum("src_added").alias("total_added"),
        F.max(F.struct("src_added", "sha")).alias("biggest"),
    )
    # One row per author first: no repository's commits meet in one task.
    authors = commits.groupBy("repo", "author").agg(
        F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_if("is_merge").alias("merges"),
    )
    overall = authors.groupBy("repo").agg(
        F.sum("n").alias("commits"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("merges").alias("merges"),
        F.count_if(F.col("author").isNotNull()).alias("contributors"), F.max("n").alias("top"),
    )
    if repos is not None:
        overall = repos.select("repo").distinct().join(overall, "repo", "left")
    one = overall.join(source, "repo", "left").na.fill(0, ["commits", "merges", "contributors", "source_commits"])
    days = F.coalesce(F.datediff("last", "first"), F.lit(0))
    bulk = F.coalesce(F.try_divide(F.col("biggest.src_added").cast("double"), F.col("total_added")), F.lit(0.0)) > BULK_SHARE
    return one.select(
        "repo",
        F.when(F.col("commits") == 0, "empty")
        .when(F.col("source_commits") <= 1, "squashed_import")
        .when((F.col("source_commits") <= 3) & (days < 7), "squashed_import")
        .otherwise("normal_dev").alias("classification"),
        "commits", "source_commits", days.cast("long").alias("spread_days"), "contributors",
        F.round(F.coalesce(F.try_divide(F.col("top").cast("double"), F.col("commits")), F.lit(0.0)), 3).alias("top_author_share"),
        "merges", F.when(bulk, F.col("biggest.sha")).alias("bulk_import"),
    )


def dangerous_areas(commits: DataFrame, commit_files: DataFrame, areas: DataFrame) -> DataFrame:
    """Per repository and area: distinct commits and files."""
    touched = commit_files.join(_live(commits), COMMIT, "left_semi").join(areas.select(*FILE, "area").distinct(), FILE)
    return touched.groupBy("repo", "area").agg(
        F.countDistinct("sha").alias("commits"), F.countDistinct("path").alias("files")
    )


def area_commits(commits: DataFrame, commit_files: DataFrame, areas: DataFrame, k: int = 15) -> DataFrame:
    """The newest k commits of every area of a repository."""
    files, names = _area_bits(areas)
    pairs = _named(_commit_bits(commit_files, files).join(_live(commits, "date"), COMMIT), names)
    return _top(pairs.select(*COMMIT, "area", "date"), k, [F.desc("date"), F.desc("sha")], ["repo", "area"])


def late_changes(commits: DataFrame, commit_files: DataFrame, days: int) -> DataFrame:
    """Source commits within ``days`` of their repository's newest commit; do they change tests?"""
    shape = commit_shape(commit_files).filter(F.col("n_source") > 0)
    newest = commits.groupBy("repo").agg(F.max("date").alias("_newest"))
    late = commits.join(newest, "repo").filter(F.col("date") >= F.date_sub("_newest", days)).drop("_newest")
    return late.join(shape, COMMIT).select(
        *commits.columns, (F.col("src_added") + F.col("src_deleted")).alias("source_churn"),
        (F.col("n_test") > 0).alias("test_changed"),
    )


def dev_patterns(commits: DataFrame, commit_files: DataFrame, scored: DataFrame, bulk: DataFrame | None = None) -> DataFrame:
    """Per repository: test co-change, untested fixes, average size, top author share.

    ``bulk(repo, bulk_import)``, as from :func:`repo_shape`, names commits that do not count for the average size.
    """
    src = commit_shape(commit_files).filter(F.col("n_source") > 0).join(_live(commits, "author"), COMMIT)
    if bulk is not None:
        src = src.join(bulk.select("repo", F.col("bulk_import").alias("_bulk")), "repo", "left")
    sized = F.coalesce(F.col("sha") != F.col("_bulk"), F.lit(True)) if bulk is not None else F.lit(True)
    lines = src.groupBy("repo", "author").agg(F.sum("src_added").alias("lines"))
    top = lines.groupBy("repo").agg(F.max(F.struct("lines", "author")).alias("t"))
    rates = src.groupBy("repo").agg(
        F.round(F.avg(F.when(F.col("n_test") > 0, 1.0).otherwise(0.0)), 3).alias("test_co_change"),
        F.round(F.avg(F.when(sized, F.col("src_added") + F.col("src_deleted"))), 1).alias("avg_commit_size"),
        F.sum("src_added").alias("total_added"),
    )
    fixes = scored.filter(F.col("score") > 0).groupBy("repo").agg(
        F.round(F.avg(F.when(F.col("n_test") == 0, 1.0).otherwise(0.0)), 3).alias("fix_without_test")
    )
    return rates.join(top, "repo").join(fixes, "repo", "left").select(
        "repo", "test_co_change", "fix_without_test", "avg_commit_size",
        F.round(F.try_divide(F.col("t.lines").cast("double"), F.col("total_added")), 3).alias("top_share"),
        F.col("t.author").alias("top_author"),
    )


def contributor_shares(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Added source lines and share per author of a repository."""
    src = commit_shape(commit_files).filter(F.col("n_source") > 0).join(_live(commits, "author"), COMMIT)
    per = src.groupBy("repo", "author").agg(F.sum("src_added").alias("lines_added"))
    total = per.groupBy("repo").agg(F.sum("lines_added").alias("_total"))
    return per.join(total, "repo").select("repo", "author", "lines_added", F.round(F.try_divide("lines_added", "_total"), 6).alias("share"))


def blame(items: DataFrame, blame_rows: DataFrame, max_files: int | None = None) -> DataFrame:
    """Author and date for debt items, of all files or the first ``max_files`` of a repository."""
    if max_files is None:
        return items.join(blame_rows, ["repo", "path", "line"], "left")
    firsts = items.select("repo", "path").distinct().withColumn(
        "rn", F.row_number().over(Window.partitionBy("repo").orderBy("path"))
    ).filter(F.col("rn") <= max_files).drop("rn")
    known = blame_rows.join(firsts, ["repo", "path"], "left_semi")
    return items.join(known, ["repo", "path", "line"], "left")


def vendor_drift(files: DataFrame, touched: DataFrame, submodules: DataFrame) -> DataFrame:
    """Vendored libraries: origin, compiler mismatch, local edits.

    ``touched(repo, path)`` are paths changed by the repository's own commits,
    ``submodules(repo, path)`` declared submodule folders.
    """
    lib = r"^((?:lib|vendor|deps)/([^/]+))/"
    src = files.filter(F.col("path").rlike(lib) & F.col("path").rlike(r"\.(sol|vy|rs|move|cairo)$")).select(
        "repo", "path", F.regexp_extract("path", lib, 1).alias("dir"), F.regexp_extract("path", lib, 2).alias("name"),
        F.trim(F.regexp_extract("source", r"(?m)^\s*pragma\s+solidity\s+(.+?)\s*;", 1)).alias("pragma"),
    ).filter(~F.col("name").isin("forge-std", "ds-test", "forge-std-1"))
    # The longest matching pattern names the library.
    matches = F.array(*[
        F.struct(F.lit(-len(p)).alias("n"), F.lit(no).alias("lib"), F.lit(p).alias("p"))
        for no, (_, patterns, _) in enumerate(KNOWN_LIBS) for p in patterns
    ])
    best = F.array_min(F.filter(matches, lambda m: F.contains(F.lower("name"), m["p"])))
    known = src.withColumn("lib", best["lib"])
    labels = F.array(*[F.lit(l) for l, _, _ in KNOWN_LIBS])
    expected = F.array(*[F.array(*[F.lit(x) for x in e]).cast("array<string>") for _, _, e in KNOWN_LIBS])
    allowed = F.get(expected, F.col("lib"))
    odd = (F.col("pragma") != "") & (F.size(allowed) > 0) & ~F.exists(allowed, lambda x: F.contains(F.col("pragma"), x))
    edits = touched.select("repo", "path", F.lit(1).alias("edited")).distinct()
    per_lib = known.withColumn("odd", F.coalesce(odd, F.lit(False))).join(edits, ["repo", "path"], "left").groupBy("repo", "dir").agg(
        F.max(F.get(labels, F.col("lib"))).alias("upstream"), F.count("*").alias("source_files"),
        F.count_if("odd").alias("pragma_mismatches"), F.count_if(F.col("edited") == 1).alias("locally_modified"),
    )
    subs = submodules.select("repo", F.col("path").alias("dir"), F.lit(1).alias("_sub")).distinct()
    return per_lib.join(subs, ["repo", "dir"], "left").withColumn("internalized", F.col("_sub").isNull()).drop("_sub")
