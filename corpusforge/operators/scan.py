"""Content scan: files to lines, lines to findings, findings to a verdict.

Every check is a query on one table of lines (bundle_id, path, kind, line_no, line). All line rules are tried in one pass, as
one array expression over the line; structural checks are windows and minima over a file's lines.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from corpusforge.functions import rules as R
from corpusforge.functions.text import explode_lines
from corpusforge.sources.tables import saved

FILE = ["bundle_id", "path"]
FINDING = ["bundle_id", "rule_id", "category", "severity", "locus", "message"]


def file_kind(path: str | Column) -> Column:
    """manifest, script, markdown or other, by the file's name."""
    name = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
    dot = F.lower(name)
    return (
        F.when(name.isin("pyproject.toml", "package.json", "Pipfile") | name.rlike(r"^requirements.*\.txt$"), "manifest")
        .when(dot.rlike(r"\.(sh|bash|zsh|py|js|mjs|cjs|ts|rb|ps1|bat|cmd)$"), "script")
        .when(dot.rlike(r"\.(md|markdown|rst|txt)$"), "markdown")
        .otherwise("other")
    )


def readable(files: DataFrame, most: int = R.MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files (bundle_id, path, content binary) as text, and notices for those of more than `most` bytes; binary ones are left out silently."""
    large = F.length("content") > most
    binary = F.contains(F.substring(F.col("content"), 1, 8192), F.lit(b"\0"))
    text = files.filter(~large & ~binary).select(*FILE, file_kind("path").alias("kind"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return text, files.filter(large).select("bundle_id", *_notice(F.concat("path", F.lit(": larger than the limit, skipped"))))


def lines_of(texts: DataFrame) -> DataFrame:
    return explode_lines(texts.select(*FILE, "kind", "text"))


def _notice(message: Column) -> list[Column]:
    return [F.lit("core:scan-notice").alias("rule_id"), F.lit("meta").alias("category"), F.lit("info").alias("severity"), F.lit("-").alias("locus"), message.alias("message")]


def _finding(rule: str, category: str, severity: str | Column, locus: Column, message: str | Column) -> list[Column]:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return ["bundle_id", F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), as_col(severity).alias("severity"), locus.alias("locus"), as_col(message).alias("message")]


def _java(pattern: str, any_case: bool) -> str:
    return ("(?iuU)" if any_case else "(?U)") + pattern


#: Texts, in lower case, one of which every line that meets a rule has; looking for them is cheaper than the rule's pattern.
HINTS = {
    "core:instruction-override": ["ignore"], "core:instruction-disregard": ["disregard"], "core:covert-action": ["user"], "core:conceal-from-user": ["user"], "core:system-prompt-extraction": ["prompt"],
    "core:reverse-shell": ["/dev/tcp/", "bash", "nc", "mkfifo"], "core:fork-bomb": [":()"], "core:destructive-rm": ["rm"], "core:no-preserve-root": ["--no-preserve-root"], "core:disk-overwrite": ["of=/dev/"],
    "core:eval-remote": ["eval", "exec"], "core:eval-encoded": ["eval", "exec"], "core:history-tamper": ["hist"], "core:install-hook": ["install\""], "core:raw-ip-url": ["://"],
    "core:password-archive": ["unzip", "7z"], "core:pipe-to-shell": ["curl", "wget"], "core:remote-script-exec": ["<("], "core:git-http-dependency": ["git+http://"], "core:remote-instructions": ["://"],
    "core:aws-access-key": ["akia"], "core:github-token": ["gh"], "core:slack-token": ["xox"], "core:anthropic-key": ["sk-ant-"], "core:private-key-block": ["private key"],
    "core:generic-api-key": ["key", "secret", "token", "password"], "core:wallet-material": ["phrase", "mnemonic", "wallet"],
}


#: The same for secret paths and network use; "nc" stands in many words and is tried as the end of one.
SECRET_HINTS = [".aws/", ".ssh/", "id_rsa", "id_ed25519", ".netrc", ".npmrc", ".pypirc", "/etc/", ".env", "keychain", ".kube/", ".docker/", "authorized_keys", ".git-credentials"]
NETWORK_HINTS = ["curl", "wget", "requests.", "urllib", "urlopen", "fetch", "httpx", "http.client", "scp", "rsync", "invoke-webrequest"]


def _with_low(lines: DataFrame) -> DataFrame:
    """lines with __low, made once a line: what filters on it isn't pushed below the array that it comes from."""
    # letters that patterns without regard to case take for ASCII ones, and lower-casing doesn't make so
    return lines.withColumn("__low", F.explode(F.array(F.lower(F.translate("line", "\u017f\u0131\u0130\u212a", "siik")))))


def _any_of(hints: list[str]) -> Column:
    return reduce(or_, [F.contains(F.col("__low"), F.lit(h)) for h in hints])


def _meets(r: R.Rule) -> Column:
    return F.col("kind").isin(list(r.kinds)) & _any_of(HINTS.get(r.id, [""])) & F.col("line").rlike(_java(r.pattern, r.any_case))


def _secret() -> Column:
    return _any_of(SECRET_HINTS) & F.col("line").rlike(_java(R.SECRET_PATH, True))


def _network() -> Column:
    as_word = F.contains(F.col("__low"), F.lit("nc")) & F.col("__low").rlike("nc(?:at)?(?![a-z0-9_])")
    return (_any_of(NETWORK_HINTS) | as_word) & F.col("line").rlike(_java(R.NETWORK, True))


def of_interest(lines: DataFrame) -> DataFrame:
    """The lines that any check of the scan may report; each is tried once, and the checks then see these alone."""
    hidden = (F.octet_length("line") > F.length("line")) & (F.col("line").rlike(f"[{R.BIDI_CONTROLS}{R.ZERO_WIDTH}]") | _mixed(F.col("line")))
    checks = [F.col("kind") == "manifest", F.contains("line", F.lit("://")), hidden, _long_run(F.col("line")), _secret(), _network(), *map(_meets, R.LINE_RULES)]
    return _with_low(lines).filter(reduce(or_, checks)).drop("__low")


def rule_hits(lines: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """lines with rule_id, and the columns named in also: one row for each rule that a line meets. A line is read once, by one array of conditions; a rule's
    pattern is tried only where one of its hints stands."""
    low = _with_low(lines)
    tried = F.array_compact(F.array(*[F.when(_meets(r), F.lit(i)) for i, r in enumerate(R.LINE_RULES)]))
    named = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity")) for r in R.LINE_RULES])
    hit = low.withColumn("hit", F.explode(tried))
    return hit.withColumn("rule", F.element_at(named, F.col("hit") + 1)).select(*FILE, *also, "kind", "line_no", "rule.*")


def line_findings(lines: DataFrame, most: int = R.MAX_FINDINGS) -> DataFrame:
    """Up to `most` findings of each rule in a file, and a notice where there are more; hits are found once."""
    of_rule = Window.partitionBy(*FILE, "rule_id")
    ranked = rule_hits(lines).withColumn("n", F.row_number().over(of_rule.orderBy("line_no"))).withColumn("total", F.count("*").over(of_rule))
    finding = F.struct("rule_id", "category", "severity", F.concat_ws(":", "path", "line_no").alias("locus"), F.lit("a line meets this rule").alias("message"))
    capped = F.struct(*_notice(F.format_string(f"%s: %s capped (%d matches, kept {most})", "path", "rule_id", "total")))
    both = F.array_compact(F.array(F.when(F.col("n") <= most, finding), F.when((F.col("n") == 1) & (F.col("total") > most), capped)))
    return ranked.select("bundle_id", F.explode(both).alias("f")).select("bundle_id", "f.*")


def credential_findings(lines: DataFrame, window: int = R.CREDENTIAL_WINDOW) -> DataFrame:
    """Secret paths on a line with network use, near such a line, or in an executable file."""
    marked = _with_low(lines).select(*FILE, "kind", "line_no", _secret().alias("secret"), _network().alias("network"))
    marked = marked.filter("secret or network")
    near = Window.partitionBy(*FILE).orderBy("line_no").rangeBetween(-window, window)
    seen = marked.withColumn("near", F.max("network").over(near)).filter("secret")
    exfil = seen.filter("network").select(*_finding("core:credential-exfil", "credential-handling", "critical", F.concat_ws(":", "path", "line_no"), "a secret path and a network call on one line"))
    by_file = seen.groupBy(*FILE, "kind").agg(
        F.min(F.when(~F.col("network") & F.col("near"), F.col("line_no"))).alias("first_near"), F.max("network").alias("any_exfil"), F.min("line_no").alias("first")
    )
    close = by_file.filter("first_near is not null").select(*_finding("core:credential-near-network", "credential-handling", "high", F.concat_ws(":", "path", "first_near"), "a secret path near network use"))
    plain = by_file.filter((F.col("kind").isin("script", "manifest")) & ~F.col("any_exfil") & F.col("first_near").isNull())
    return exfil.unionByName(close).unionByName(plain.select(*_finding("core:secret-path-access", "credential-handling", "medium", F.concat_ws(":", "path", "first"), "an executable file names secret paths")))


def _mixed(line: Column) -> Column:
    return line.rlike("[Ѐ-ӿ]") & line.rlike(r"(?U)\b\w*[a-zA-Z]\w*[Ѐ-ӿ]\w*\b|\b\w*[Ѐ-ӿ]\w*[a-zA-Z]\w*\b")


def unicode_findings(lines: DataFrame) -> DataFrame:
    """First line of each file with a bidi control, a zero-width character, a word that mixes Latin and Cyrillic."""
    line = F.col("line")
    lone_bom = (F.col("line_no") == 1) & line.startswith("﻿") & ~F.substring(line, 2, 1 << 30).contains("﻿")
    checks = [
        ("core:bidi-control", "high", line.rlike(f"[{R.BIDI_CONTROLS}]")),
        ("core:zero-width", "high", line.rlike(f"[{R.ZERO_WIDTH}]") & ~lone_bom),
        ("core:homoglyph-mix", "medium", _mixed(line)),
    ]
    firsts = lines.filter(F.octet_length("line") > F.length("line")).groupBy(*FILE).agg(*[F.min(F.when(hit, F.col("line_no"))).alias(f"n{i}") for i, (_, _, hit) in enumerate(checks)])
    found = F.array_compact(F.array(*[F.when(F.col(f"n{i}").isNotNull(), F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col(f"n{i}").alias("line_no"))) for i, (rule, severity, _) in enumerate(checks)]))
    return firsts.select(*FILE, F.explode(found).alias("f")).select("bundle_id", "f.rule_id", F.lit("prompt-injection").alias("category"), "f.severity", F.concat_ws(":", "path", "f.line_no").alias("locus"), F.lit("characters that hide or change text").alias("message"))


def allowed_host(host: Column, domains: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))


def hosts(lines: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """First line of each file that names each host that isn't allowed; hosts of digits and dots alone are left out."""
    host = F.regexp_replace(F.lower("host"), r"\.+$", "")
    named = lines.filter(F.contains("line", F.lit("://")))
    found = named.select(*FILE, "kind", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"https?://([A-Za-z0-9.-]+)"), 1)).alias("host")).withColumn("host", host)
    return found.filter(~allowed_host(F.col("host"), R.ALLOWED_DOMAINS if domains is None else domains) & ~F.col("host").rlike(r"^[\d.]+$")).groupBy(*FILE, "kind", "host").agg(F.min("line_no").alias("line_no"))


def domain_findings(lines: DataFrame, domains: list[str] | None = None) -> DataFrame:
    executable = F.col("kind").isin("script", "manifest")
    return hosts(lines, domains).select(
        "bundle_id",
        F.when(executable, "core:unlisted-domain").otherwise("core:external-url").alias("rule_id"),
        F.lit("suspicious-download").alias("category"),
        F.when(executable, "medium").otherwise("info").alias("severity"),
        F.concat_ws(":", "path", "line_no").alias("locus"),
        F.concat(F.lit("names a host that isn't allowed: "), "host").alias("message"),
    )


@F.pandas_udf(BooleanType())
def _printable(texts: pd.Series) -> pd.Series:
    """Whether four fifths of a text's characters can be printed or are white space."""
    return texts.map(lambda t: bool(t) and sum(c.isprintable() or c.isspace() for c in t) / len(t) >= 0.8)


def _long_run(line: Column) -> Column:
    return (F.length(line) >= 40) & line.rlike("(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}")


def encoded_payloads(lines: DataFrame) -> DataFrame:
    """The first blobs of base64 in each file, decoded once, whose text meets a line rule."""
    blobs = lines.filter(_long_run(F.col("line"))).select(*FILE, "kind", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit("([A-Za-z0-9+/]{40,}={0,2})"), 1)).alias("place", "blob"))
    first = blobs.withColumn("n", F.row_number().over(Window.partitionBy(*FILE).orderBy("line_no", "place"))).filter(F.col("n") <= R.MAX_BLOBS)
    padded = F.concat("blob", F.repeat(F.lit("="), F.pmod(-F.length("blob"), F.lit(4))))
    raw = F.try_to_binary(padded, F.lit("base64"))
    decoded = first.withColumn("text", F.make_valid_utf8(F.substring(raw, 1, R.MAX_DECODED).cast("string")))
    decoded = decoded.filter(F.col("text").isNotNull() & _printable("text"))
    inner = explode_lines(decoded.select("bundle_id", "path", "kind", F.struct("line_no", "n").alias("at"), "text"))
    met = rule_hits(inner, ("at",)).groupBy(*FILE, "at").agg(F.array_join(F.sort_array(F.collect_set("rule_id")), ", ").alias("rules"))
    return met.select(*_finding("core:encoded-payload", "prompt-injection", "critical", F.concat(F.col("path"), F.lit(":"), F.col("at.line_no").cast("string")), F.concat(F.lit("base64 hides what meets: "), "rules")))


def dependency_name(line: Column) -> Column:
    """The package a manifest line names: a quoted JSON key, or a leading name; null for others."""
    stripped = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    quoted = F.regexp_extract(line, r'^\s*"([A-Za-z0-9][A-Za-z0-9._-]*)"\s*:', 1)
    plain = F.regexp_extract(stripped, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    name = F.when(quoted != "", quoted).otherwise(plain)
    return F.when((stripped == "") | stripped.rlike(r"^[#\-\[{}]"), None).otherwise(F.nullif(F.lower(name), F.lit("")))


def squatted(name: Column) -> Column:
    """The first popular package, by name, one edit away from a name that isn't known itself; else null."""
    popular = F.array(*map(F.lit, sorted(R.POPULAR_PACKAGES)))
    near = F.filter(popular, lambda p: (F.abs(F.length(p) - F.length(name)) <= 1) & (F.levenshtein(name, p, 1) >= 0))
    return F.when(~name.isin(R.POPULAR_PACKAGES + R.TYPOSQUAT_EXCEPTIONS), F.get(near, F.lit(0)))


def dependency_findings(lines: DataFrame) -> DataFrame:
    # rows of arrays without nulls, not filters: those would be pushed down, and find the name again for each popular package
    named = lines.filter("kind = 'manifest'").withColumn("name", F.explode(F.array_compact(F.array(dependency_name(F.col("line"))))))
    squats = named.withColumn("target", F.explode(F.array_compact(F.array(squatted(F.col("name"))))))
    found = squats.select(*_finding("core:typosquat-dependency", "unverifiable-dependency", "high", F.concat_ws(":", "path", "line_no"), F.format_string("dependency %s is one edit from %s", "name", "target")))
    loose = named.filter(F.element_at(F.split("path", "/"), -1).startswith("requirements") & ~F.col("line").rlike(r"[=<>!~]|@|\bgit\+")).groupBy(*FILE).agg(F.count("*").alias("n"))
    return found.unionByName(loose.select(*_finding("core:unpinned-dependency", "unverifiable-dependency", "low", F.concat("path", F.lit(":1")), F.format_string("%d dependencies without a version", "n"))))


def walk_key(path: str | Column) -> Column:
    """A key in whose order paths stand as a walk gives them: by their parts, not as strings ("a/x" before "a-b")."""
    return F.replace(F.col(path) if isinstance(path, str) else path, F.lit("/"), F.lit("\0"))


def bundle_walk(files: DataFrame, root: str | Column = "") -> DataFrame:
    """files (bundle_id, path) with position, from 1, in the order of the walk, without those below an ignored folder.

    Parts of the root count too: a bundle that lies below an ignored folder has no files. A part is what its whole name says,
    a file's name as well.
    """
    root = F.lit(root) if isinstance(root, str) else root
    parts = F.concat(F.split(root, "/"), F.split("path", "/"))
    kept = files.filter(~F.arrays_overlap(parts, F.array(*map(F.lit, R.IGNORED_FOLDERS))))
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("bundle_id").orderBy(walk_key("path"))))


def update_index(index: DataFrame, files: DataFrame, scanner_version: str, ruleset_version: str, scanned_at: str) -> tuple[DataFrame, DataFrame]:
    """The verdict index brought up to date with bundles of files (bundle_id, path, content), and the records that were made for it.

    index: position, bundle_hash, scanner_version, ruleset_version, verdict, scanned_at. Of records with one hash the first
    stands. Only bundles are scanned whose hash has no record, or one of other versions; bundles of one hash are scanned once.
    Records of hashes that no bundle has stay.
    """
    kept = index.groupBy("bundle_hash").agg(F.min_by(F.struct("scanner_version", "ruleset_version", "verdict", "scanned_at"), "position").alias("r")).select("bundle_hash", "r.*")
    current = kept.filter((F.col("scanner_version") == scanner_version) & (F.col("ruleset_version") == ruleset_version))
    hashes = bundle_hashes(files.select("bundle_id", "path", F.sha2("content", 256).alias("sha256")))
    due = saved(hashes.join(current, "bundle_hash", "left_anti").groupBy("bundle_hash").agg(F.min("bundle_id").alias("bundle_id")), "due")
    chosen = files.join(due.select("bundle_id"), "bundle_id", "left_semi")
    judged = verdicts(scan(chosen), chosen).join(due, "bundle_id")
    made = judged.select("bundle_hash", F.lit(scanner_version).alias("scanner_version"), F.lit(ruleset_version).alias("ruleset_version"), "verdict", F.lit(scanned_at).alias("scanned_at"))
    made = saved(made, "records")
    return kept.join(made.select("bundle_hash"), "bundle_hash", "left_anti").unionByName(made), made


def scan(files: DataFrame) -> DataFrame:
    """All findings of bundles of files (bundle_id, path, content), in the order of the walk."""
    crowded = saved(files.groupBy("bundle_id").agg(F.count("*").alias("files")).filter(F.col("files") > R.MAX_FILES), "crowded")
    over = crowded.select("bundle_id", *_notice(F.lit(f"more than {R.MAX_FILES} files, the rest isn't scanned")))
    if not crowded.isEmpty():  # else no file is moved
        files = files.withColumn("n", F.row_number().over(Window.partitionBy("bundle_id").orderBy(walk_key("path")))).filter(F.col("n") <= R.MAX_FILES).drop("n")
    texts, notices = readable(files)
    lines = saved(of_interest(lines_of(texts)), "lines")
    out = notices.unionByName(over)
    for part in (line_findings, credential_findings, unicode_findings, domain_findings, encoded_payloads, dependency_findings):
        out = out.unionByName(part(lines))
    return out


def severity_rank(severity: str | Column) -> Column:
    severity = F.col(severity) if isinstance(severity, str) else severity
    return F.element_at(F.create_map(*[F.lit(x) for kv in R.SEVERITY_RANK.items() for x in kv]), severity)


def verdict_of(rank: Column) -> Column:
    return F.when(rank >= 4, "block").when(rank >= 2, "review").otherwise("pass")


def verdict_rank(verdict: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, R.VERDICTS)), verdict)


def worse(a: Column, b: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, R.VERDICTS)), F.greatest(verdict_rank(a), verdict_rank(b)).cast("int"))


def verdicts(findings: DataFrame, bundles: DataFrame) -> DataFrame:
    """bundle_id and verdict of every bundle, by its worst finding."""
    worst = findings.groupBy("bundle_id").agg(F.max(severity_rank("severity")).alias("rank"))
    return bundles.select("bundle_id").distinct().join(worst, "bundle_id", "left").select("bundle_id", verdict_of(F.coalesce("rank", F.lit(0))).alias("verdict"))


def verdict_counts(judged: DataFrame) -> DataFrame:
    """verdict and n of each possible verdict, also of those that no bundle has."""
    all_ = judged.sparkSession.createDataFrame([(v,) for v in R.VERDICTS], "verdict string")
    return F.broadcast(judged.groupBy("verdict").agg(F.count("*").alias("found"))).join(all_, "verdict", "right").select("verdict", F.coalesce("found", F.lit(0)).alias("n"))


def reconcile(local: DataFrame, hosted: DataFrame, scanner_version: str, ruleset_version: str) -> DataFrame:
    """local (bundle_id, bundle_hash, verdict) with verdict, hosted_verdict and stale after hosted records (bundle_hash,
    scanner_version, ruleset_version, verdict, position): the first record of a hash; another version changes nothing."""
    first = hosted.groupBy("bundle_hash").agg(F.min_by(F.struct("scanner_version", "ruleset_version", "verdict"), "position").alias("record"))
    joined = local.join(first, "bundle_hash", "left")
    current = (F.col("record.scanner_version") == scanner_version) & (F.col("record.ruleset_version") == ruleset_version)
    return joined.select(
        "bundle_id", "bundle_hash",
        F.when(current, worse(F.col("verdict"), F.col("record.verdict"))).otherwise(F.col("verdict")).alias("verdict"),
        F.when(current, F.col("record.verdict")).alias("hosted_verdict"),
        (F.col("record").isNotNull() & ~current).alias("stale"),
    )


def hosted_findings(records: DataFrame) -> DataFrame:
    """Findings of hosted records under ids that say where they come from."""
    return records.select("bundle_hash", F.explode("findings").alias("f")).select("bundle_hash", F.when(F.col("f.rule_id").startswith("hosted:"), F.col("f.rule_id")).otherwise(F.concat(F.lit("hosted:"), "f.rule_id")).alias("rule_id"), "f.category", "f.severity", "f.locus", "f.message")


def bundle_hashes(files: DataFrame) -> DataFrame:
    """bundle_id and bundle_hash of files (bundle_id, path, sha256): sha256 over path NUL sha256 lines, sorted by path."""
    listed = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    joined = F.array_join(F.transform(listed, lambda x: F.concat(x.path, F.lit("\0"), x.sha256)), "\n")
    return files.groupBy("bundle_id").agg(F.sha2(joined, 256).alias("bundle_hash"))


def parse_reports(reports: DataFrame, tool: str) -> DataFrame:
    """Findings of an external scanner's JSON (bundle_id, json); what can't be parsed becomes a notice."""
    if tool == "bandit":
        schema = "results array<struct<test_id: string, issue_severity: string, issue_text: string, filename: string, line_number: int>>"
        item, results = "f.test_id", "parsed.results"
        severity = F.coalesce(F.element_at(F.create_map(*map(F.lit, ["HIGH", "high", "MEDIUM", "medium", "LOW", "low"])), F.upper("f.issue_severity")), F.lit("low"))
        locus, message = F.concat_ws(":", "f.filename", "f.line_number"), F.col("f.issue_text")
    elif tool == "semgrep":
        schema = "results array<struct<check_id: string, path: string, start: struct<line: int>, extra: struct<severity: string, message: string>>>"
        item, results = "f.check_id", "parsed.results"
        severity = F.coalesce(F.element_at(F.create_map(*map(F.lit, ["ERROR", "high", "WARNING", "medium", "INFO", "low"])), F.upper("f.extra.severity")), F.lit("low"))
        locus, message = F.concat_ws(":", "f.path", "f.start.line"), F.col("f.extra.message")
    else:  # gitleaks: the secret itself is never shown
        schema = "array<struct<RuleID: string, Description: string, File: string, StartLine: int>>"
        item, results = "f.RuleID", "parsed"
        severity, locus, message = F.lit("high"), F.concat_ws(":", "f.File", "f.StartLine"), F.col("f.Description")
    parsed = reports.withColumn("parsed", F.from_json("json", schema))
    category = "secret-exposure" if tool == "gitleaks" else "malicious-code"
    found = parsed.select("bundle_id", F.explode(results).alias("f")).select("bundle_id", F.concat(F.lit(f"{tool}:"), item).alias("rule_id"), F.lit(category).alias("category"), severity.alias("severity"), locus.alias("locus"), message.alias("message"))
    broken = parsed.filter(F.col("parsed").isNull() | F.col(results).isNull()).select("bundle_id", F.lit("core:scanner-notice").alias("rule_id"), F.lit("meta").alias("category"), F.lit("info").alias("severity"), F.lit("-").alias("locus"), F.lit(f"{tool}: output can't be read").alias("message"))
    return found.unionByName(broken)
