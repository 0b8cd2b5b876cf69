"""Catalog entries from trees of repositories: a source that lists and reads them, and the building of entries from files."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusforge.operators.license_ids import detect_text
from corpusforge.operators.scan import bundle_hashes
from corpusforge.sources.catalog import as_list, entry_id, owners
from corpusforge.sources.frontmatter import split_frontmatter

#: License files in the order in which they count (fixed values).
LICENSE_NAMES = ["LICENSE", "LICENSE.md", "LICENSE.txt", "COPYING"]


class _Repo(InputPartition):
    def __init__(self, repo: str):
        self.repo = repo


def _get(address: str, token: str | None) -> bytes | None:
    """Bytes at an address; None where nothing is."""
    request = urllib.request.Request(address, headers={"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(request, timeout=30) as answer:
            return answer.read()
    except urllib.error.HTTPError as error:
        if error.code == 404:
            return None
        raise


class RepositoryTrees(DataSource):
    """Rows repo, ref, path and content of the files of repositories, one partition for each repository.

    Options: repos (comma list of owner/name), api and raw (addresses), ref (else each repository's default branch, else main),
    token. Of a tree only what lies in a folder with a SKILL.md, or is a license at the top, is read. A file that isn't there
    has null content; a repository without a tree has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "repository_trees"

    def schema(self) -> str:
        return "repo string, ref string, path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(dict(self.options))


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Repo(r.strip()) for r in self.options.get("repos", "").split(",") if r.strip()]

    def read(self, partition: _Repo):
        repo, token = partition.repo, self.options.get("token")
        api, raw = self.options["api"].rstrip("/"), self.options["raw"].rstrip("/")
        told = lambda path: json.loads(_get(f"{api}/repos/{repo}{path}", token) or b"{}")
        branch = self.options.get("ref") or told("").get("default_branch") or "main"
        ref = told(f"/commits/{branch}").get("sha") or branch
        paths = sorted(x["path"] for x in told(f"/git/trees/{ref}?recursive=1").get("tree", []) if x.get("type") == "blob")
        folders = {p.rpartition("/")[0] for p in paths if p.rpartition("/")[2] == "SKILL.md"}
        for path in paths:
            parents = path.split("/")[:-1]
            if path in LICENSE_NAMES or any("/".join(parents[:n]) in folders for n in range(len(parents) + 1)):
                yield repo, ref, path, _get(f"{raw}/{repo}/{ref}/{path}", token)


def read_trees(spark, repos: list[str], api: str, raw: str, ref: str | None = None) -> DataFrame:
    spark.dataSource.register(RepositoryTrees)
    source = spark.read.format("repository_trees").options(repos=",".join(repos), api=api, raw=raw)
    return (source.option("ref", ref) if ref else source).load()


def build_entries(files: DataFrame, raw: str = "") -> DataFrame:
    """Catalog entries of files (repo, ref, path, content): one for each folder with a SKILL.md, of the files it owns.

    id, name, repo, spdx_id, license_source, description, tags, languages, files (path, sha256; by path), fetch_base, bundle_hash.
    A folder goes if a file of it has null content or its SKILL.md is empty. The repository's license counts, by the first
    license file at its top; where that names none, that of the first in the entry's own folder. An entry's files are one row.
    """
    text = F.make_valid_utf8(F.col("content").cast("string"))
    owned = files.join(owners(files.select("repo", "path")), ["repo", "path"])
    relative = F.when(F.col("owner") == "", F.col("path")).otherwise(F.substring("path", F.length("owner") + 2, F.length("path")))
    own = owned.select("repo", "ref", "owner", relative.alias("path"), "content", F.sha2("content", 256).alias("sha256"))
    order = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(LICENSE_NAMES) for x in (n, i)]), F.col("path"))
    top = files.filter(order.isNotNull() & F.col("content").isNotNull()).groupBy("repo").agg(F.min_by(text, order).alias("text")).select("repo", detect_text("text").alias("repo_spdx"), F.lit("license-file").alias("repo_source"))
    licensed = own.withColumn("order", order).filter("order is not null").groupBy("repo", "owner").agg(F.min_by(text, "path").alias("text")).select("repo", "owner", detect_text("text").alias("own_spdx"))
    whole = own.groupBy("repo", "owner").agg(F.first("ref").alias("ref"), F.count_if(F.col("content").isNull()).alias("missing"), F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("files"), F.max(F.when(F.col("path") == "SKILL.md", text)).alias("text"))
    whole = split_frontmatter(whole.filter("missing = 0 and text != ''"))
    key = F.concat_ws(":", "repo", "owner")
    hashes = bundle_hashes(own.withColumn("bundle_id", key)).withColumnRenamed("bundle_id", "key")
    field = lambda name: F.coalesce(F.try_variant_get(F.try_parse_json("frontmatter"), f"$['{name}']", "string"), F.lit(""))
    listed = lambda name: F.coalesce(F.from_json(field(name), "array<string>"), as_list(field(name)))
    last = lambda path: F.element_at(F.split(path, "/"), -1)
    out = whole.withColumn("key", key).join(hashes, "key").join(top, "repo", "left").join(licensed, ["repo", "owner"], "left")
    folder = F.nullif(last(F.col("owner")), F.lit(""))
    return out.select(
        entry_id("repo", "owner").alias("id"), F.coalesce(F.nullif(field("name"), F.lit("")), folder, last(F.col("repo"))).alias("name"), "repo", F.coalesce("repo_spdx", "own_spdx").alias("spdx_id"),
        F.when(F.col("repo_source").isNotNull() | F.col("own_spdx").isNotNull(), "license-file").alias("license_source"), field("description").alias("description"), listed("tags").alias("tags"), listed("languages").alias("languages"),
        "files", F.rtrim(F.concat_ws("/", F.lit(raw.rstrip("/")), "repo", "ref", "owner"), F.lit("/")).alias("fetch_base"), "bundle_hash",
    )
