"""Catalog documents, verdict indexes, verified artifacts and bundles."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = """schema_version int, generated_at string, entries array<struct<id: string, source: struct<name: string, repo: string, url: string, stars: int,
    license: struct<spdx_id: string, copyleft: boolean, source: string>>, description: string, tags: array<string>, languages: array<string>,
    files: array<struct<path: string, sha256: string>>, fetch_base: string, bundle_hash: string>>"""
INDEX_SCHEMA = """schema_version int, generated_at string, records array<struct<bundle_hash: string, hash_algo: string, scanner_version: string,
    ruleset_versions: map<string, string>, verdict: string, findings: array<struct<rule_id: string, category: string, severity: string, locus: string, message: string>>,
    scanned_at: string, advisory: boolean>>"""
CASE = "struct<id: int, prompt: string, query: string, expected_output: string, files: array<string>, expectations: array<string>, expected_behavior: array<string>>"


class CatalogError(ValueError):
    """A catalog, manifest or artifact that can't be trusted or read."""


class InterchangeError(ValueError):
    """A file of cases or of versions that can't be read, or that belongs to another skill."""


class FetchError(ValueError):
    """A bundle that can't be fetched whole."""


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a catalog document, flat: id, name, repo, url, stars, spdx_id, copyleft, description, tags, languages, files,
    fetch_base, bundle_hash, position. Missing lists are empty, as are missing hashes."""
    document = spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    e = document.select(F.posexplode("entries").alias("position", "e"))
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    return e.select(
        "position", "e.id", "e.source.name", "e.source.repo", "e.source.url", "e.source.stars", "e.source.license.spdx_id", F.coalesce("e.source.license.copyleft", F.lit(False)).alias("copyleft"),
        F.coalesce("e.description", F.lit("")).alias("description"), empty("e.tags", "array<string>").alias("tags"), empty("e.languages", "array<string>").alias("languages"),
        empty("e.files", "array<struct<path: string, sha256: string>>").alias("files"), "e.fetch_base", F.coalesce("e.bundle_hash", F.lit("")).alias("bundle_hash"),
    )


def load_verdicts(spark: SparkSession, path: str) -> DataFrame:
    index = spark.read.schema(INDEX_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return index.select(F.posexplode("records").alias("position", "r")).select("position", "r.*")


def load_evals(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON list, or of the list under "evals", or of one object; older names are taken over."""
    rows = spark.read.option("wholetext", True).text(path)
    if not rows.filter(F.try_parse_json("value").isNull() | ~F.trim("value").rlike(r"^[\[{]")).isEmpty():
        raise InterchangeError(f"{path} isn't a list or an object of cases")
    one = F.trim("value").startswith("{")
    wrapped = F.from_json("value", f"struct<evals: array<{CASE}>>").evals
    listed = F.when(one, F.coalesce(wrapped, F.array(F.from_json("value", CASE)))).otherwise(F.from_json("value", f"array<{CASE}>"))
    cases = rows.select(F.posexplode(listed).alias("position", "c")).select((F.col("position") + 1).alias("position"), "c.*")
    return cases.withColumn("prompt", F.coalesce("prompt", "query")).withColumn("expectations", F.coalesce("expectations", "expected_behavior")).drop("query", "expected_behavior")


def safe_path(path: str | Column) -> Column:
    """A relative path without empty, dot or dot-dot parts, and without NUL, backslash and colon."""
    path = F.col(path) if isinstance(path, str) else path
    odd = F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    return (path != "") & ~path.rlike(r"[\x00\\:]") & ~odd


def directory_matches(listed: DataFrame, found: DataFrame) -> bool:
    """Whether found (path, sha256) has exactly the listed files."""
    both = listed.select("path", F.col("sha256").alias("a")).join(found.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()


def check_bundles(entries: DataFrame) -> DataFrame:
    """id and problem of entries that can't be fetched: no files, no base, a hash that isn't theirs, an unsafe path."""
    listed = F.array_sort(F.transform("files", lambda f: F.struct(f.path.alias("path"), f.sha256.alias("sha256"))))
    own = F.sha2(F.array_join(F.transform(listed, lambda f: F.concat(f.path, F.lit("\0"), f.sha256)), "\n"), 256)
    unsafe = F.exists("files", lambda f: ~safe_path(f.path))
    problem = (
        F.when(F.size("files") == 0, "no files")
        .when(F.coalesce("fetch_base", F.lit("")) == "", "no place to fetch from")
        .when((F.col("bundle_hash") != "") & (F.col("bundle_hash") != own), "bundle hash isn't that of the files")
        .when(unsafe, "unsafe path")
    )
    return entries.select("id", problem.alias("problem")).filter("problem is not null")


def verify_fetched(entries: DataFrame, fetched: DataFrame) -> DataFrame:
    """id and path of listed files that are missing among fetched (id, path, content) or whose bytes have another hash."""
    listed = entries.select("id", F.explode("files").alias("f")).select("id", "f.path", "f.sha256")
    got = fetched.select("id", "path", F.sha2("content", 256).alias("got"))
    return listed.join(got, ["id", "path"], "left").filter(~F.col("got").eqNullSafe(F.col("sha256"))).select("id", "path")


def fetch_bundle(entry: dict, fetch, cache: str) -> str:
    """The folder that holds exactly the files of an entry (id, files of path and sha256, fetch_base, bundle_hash).

    A folder at hand that still has all bytes is taken as it is. Otherwise every file is got by fetch(address) and compared with
    its hash in a folder beside it, which takes the place at once when it is whole; a failure leaves nothing behind.
    """
    wanted = {f["path"]: f["sha256"] for f in entry["files"]}
    lines = "\n".join(f"{path}\0{digest}" for path, digest in sorted(wanted.items()))
    bad = [p for p in wanted if p == "" or re.search(r"[\x00\\:]", p) or {"", ".", ".."} & set(p.split("/"))]
    problem = "no files" if not wanted else "no place to fetch from" if not entry.get("fetch_base") else "a bundle hash that isn't that of its files" if hashlib.sha256(lines.encode()).hexdigest() != entry["bundle_hash"] else f"an unsafe path {bad[0]!r}" if bad else None
    if problem:
        raise FetchError(f"{entry['id']} has {problem}")
    place = Path(cache) / "bundles" / entry["bundle_hash"]
    held = {str(f.relative_to(place)): hashlib.sha256(f.read_bytes()).hexdigest() for f in place.rglob("*") if f.is_file()} if place.is_dir() else None
    if held == wanted:
        return str(place)
    place.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=place.parent) as beside:
        for path, digest in wanted.items():
            try:
                data = fetch(f"{entry['fetch_base'].rstrip('/')}/{path}")
            except OSError as error:
                raise FetchError(f"{entry['id']}: {path} can't be fetched") from error
            if hashlib.sha256(data).hexdigest() != digest:
                raise FetchError(f"{entry['id']}: {path} has another hash")
            (target := Path(beside) / "whole" / path).parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(data)
        old = Path(beside) / "old"
        if place.exists():  # it goes aside first, and comes back if the new one can't take its place
            place.rename(old)
        try:
            (Path(beside) / "whole").rename(place)
        except OSError:
            if old.exists():
                old.rename(place)
            raise
    return str(place)


def carry_identity(bundles: DataFrame, entries: DataFrame) -> DataFrame:
    """bundles (bundle_hash, name, repo, url, spdx_id) with what the catalog's entries say of the bundle with their hash; entries
    without a hash say nothing, and of several with one hash the last does."""
    known = entries.filter("bundle_hash != ''").groupBy("bundle_hash").agg(F.max_by(F.struct("name", "repo", "url", "spdx_id"), "position").alias("known"))
    joined = bundles.join(known, "bundle_hash", "left")
    told = F.col("known").isNotNull()
    return joined.withColumns({c: F.when(told, F.col(f"known.{c}")).otherwise(F.col(c)) for c in ("name", "repo", "url", "spdx_id")}).drop("known")


def owners(tree: DataFrame) -> DataFrame:
    """repo, path and owner of each file below a folder that has a SKILL.md: the deepest such folder.

    Each path's ancestors are listed and looked up, an equi-join, instead of comparing paths with all folders.
    """
    folders = tree.filter(F.col("path").rlike("(^|/)SKILL\\.md$")).select("repo", F.regexp_replace("path", "/?SKILL\\.md$", "").alias("owner")).distinct()
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    listed = tree.select("repo", "path", F.explode(ancestors).alias("owner"))
    return listed.join(folders, ["repo", "owner"]).groupBy("repo", "path").agg(F.max_by("owner", F.length("owner")).alias("owner"))


def entry_id(repo: str | Column, folder: str | Column) -> Column:
    folder = F.col(folder) if isinstance(folder, str) else folder
    return F.when(folder == "", F.col(repo) if isinstance(repo, str) else repo).otherwise(F.concat_ws(":", repo, folder))


def as_list(value: str | Column) -> Column:
    """A bracketed or bare comma list as an array of what isn't blank."""
    bare = F.regexp_replace(F.col(value) if isinstance(value, str) else value, r"^\s*\[|\]\s*$", "")
    return F.filter(F.transform(F.split(bare, ","), lambda x: F.regexp_replace(x, "^[\\s'\"]+|[\\s'\"]+$", "")), lambda x: x != "")


# --- signed manifests: one small document, on the driver


def canonical(manifest: dict) -> bytes:
    return json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()


def generate_keypair(spark: SparkSession) -> tuple[str, str]:
    """Private and public Ed25519 keys, as base64 of their standard encodings."""
    java = spark._jvm.java
    pair = java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
    factory = java.security.KeyFactory.getInstance("Ed25519")
    kinds = (("PKCS8EncodedKeySpec", pair.getPrivate()), ("X509EncodedKeySpec", pair.getPublic()))
    return tuple(base64.b64encode(bytes(factory.getKeySpec(key, java.lang.Class.forName(f"java.security.spec.{kind}")).getEncoded())).decode() for kind, key in kinds)


def sign(spark: SparkSession, private_key: str, raw: bytes) -> bytes:
    security = spark._jvm.java.security
    key = security.KeyFactory.getInstance("Ed25519").generatePrivate(security.spec.PKCS8EncodedKeySpec(base64.b64decode(private_key)))
    signature = security.Signature.getInstance("Ed25519")
    signature.initSign(key)
    signature.update(raw)
    return bytes(signature.sign())


def verify_manifest(spark: SparkSession, raw: bytes, signature: bytes, trusted_keys: dict[str, str]) -> dict:
    """The manifest, if its key is trusted and the signature is over its very bytes."""
    try:
        manifest = json.loads(raw)
    except ValueError as error:
        raise CatalogError("the manifest isn't JSON") from error
    key = trusted_keys.get(manifest.get("key_id")) if isinstance(manifest, dict) else None
    if key is None:
        raise CatalogError("the manifest's key isn't trusted")
    security = spark._jvm.java.security
    check = security.Signature.getInstance("Ed25519")
    check.initVerify(security.KeyFactory.getInstance("Ed25519").generatePublic(security.spec.X509EncodedKeySpec(base64.b64decode(key))))
    check.update(raw)
    if len(signature) != 64 or not check.verify(signature):
        raise CatalogError("the manifest's signature doesn't fit")
    if not isinstance(manifest.get("artifacts"), list) or not isinstance(manifest.get("generated_at"), str):
        raise CatalogError("the manifest has no artifacts or time")
    return manifest


def ensure_fresh(incoming: dict, cached: dict | None) -> None:
    """Times are compared as text; an equal time passes."""
    if cached is not None and incoming["generated_at"] < cached["generated_at"]:
        raise CatalogError("the manifest is older than the one at hand")


def cached_manifest(cache: str) -> dict | None:
    """The manifest at hand, or None where there is none that can be read."""
    try:
        found = json.loads((Path(cache) / "manifest.json").read_bytes())
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) and isinstance(found.get("artifacts"), list) and isinstance(found.get("generated_at"), str) else None


def build_catalog(spark: SparkSession, artifacts: dict[str, bytes], out: str, private_key: str, key_id: str, generated_at: str, base_url: str = "") -> dict:
    """Write artifacts under their hashes, then the manifest and its signature last."""
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    listed = []
    for name, data in sorted(artifacts.items()):
        digest = hashlib.sha256(data).hexdigest()
        (folder / digest).write_bytes(data)
        listed.append({"name": name, "version": generated_at, "url": f"{base_url}{digest}", "sha256": digest, "size": len(data)})
    manifest = {"schema_version": 1, "generated_at": generated_at, "key_id": key_id, "artifacts": listed}
    raw = canonical(manifest)
    (folder / "manifest.sig").write_bytes(sign(spark, private_key, raw))
    (folder / "manifest.json").write_bytes(raw)
    return manifest


def load_snapshot(spark: SparkSession, folder: str, trusted_keys: dict[str, str]) -> dict:
    """A local catalog folder, verified: manifest and every artifact. No network."""
    place = Path(folder)
    manifest = verify_manifest(spark, (place / "manifest.json").read_bytes(), (place / "manifest.sig").read_bytes(), trusted_keys)
    for artifact in manifest["artifacts"]:
        read_artifact(folder, manifest, artifact["name"])
    return manifest


def read_artifact(folder: str, manifest: dict, name: str) -> bytes | None:
    """Bytes of the artifact of a name, checked against its hash; None if the manifest has none."""
    for artifact in manifest["artifacts"]:
        if artifact["name"] == name:
            path = Path(folder) / artifact["sha256"]
            data = path.read_bytes() if path.exists() else b""
            if hashlib.sha256(data).hexdigest() != artifact["sha256"]:
                raise CatalogError(f"artifact {name} is missing or damaged")
            return data
    return None


def sync(spark: SparkSession, fetch, cache: str, trusted_keys: dict[str, str]) -> dict:
    """Take over a catalog by fetch(name) -> bytes: verify, refuse older ones, fetch what isn't at hand, write the manifest last."""
    place = Path(cache)
    place.mkdir(parents=True, exist_ok=True)
    raw, signature = fetch("manifest.json"), fetch("manifest.sig")
    manifest = verify_manifest(spark, raw, signature, trusted_keys)
    ensure_fresh(manifest, cached_manifest(cache))
    for artifact in manifest["artifacts"]:
        path = place / artifact["sha256"]
        if path.exists() and hashlib.sha256(path.read_bytes()).hexdigest() == artifact["sha256"]:
            continue
        data = fetch(artifact["sha256"])
        if hashlib.sha256(data).hexdigest() != artifact["sha256"]:
            raise CatalogError(f"artifact {artifact['name']} has another hash")
        path.write_bytes(data)
    (place / "manifest.sig").write_bytes(signature)
    (place / "manifest.json").write_bytes(raw)
    return manifest
