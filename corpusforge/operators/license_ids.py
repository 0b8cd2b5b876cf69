"""License ids of texts and bundles, and their combination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ids in order with the phrases that a text must all hold; the first that fits counts.
FINGERPRINTS = [
    ("AGPL-3.0-only", ["gnu affero general public license"]),
    ("LGPL-3.0-only", ["gnu lesser general public license", "version 3"]),
    ("LGPL-2.1-only", ["lesser general public license", "version 2.1"]),
    ("GPL-3.0-only", ["gnu general public license", "version 3"]),
    ("GPL-2.0-only", ["gnu general public license", "version 2"]),
    ("MPL-2.0", ["mozilla public license version 2.0"]),
    ("Apache-2.0", ["apache license", "version 2.0"]),
    ("MIT", ["permission is hereby granted free of charge"]),
    ("BSD-3-Clause", ["redistribution and use in source and binary forms", "neither the name"]),
    ("BSD-2-Clause", ["redistribution and use in source and binary forms"]),
    ("ISC", ["permission to use copy modify and/or distribute this software"]),
    ("Unlicense", ["free and unencumbered software"]),
    ("CC-BY-4.0", ["creative commons attribution 4.0"]),
    ("CC-BY-SA-4.0", ["creative commons attribution-sharealike 4.0"]),
]
# How much an id restricts; an id not listed ranks 9.
RESTRICTIVENESS = {
    "Unlicense": 0, "MIT": 1, "ISC": 1, "BSD-2-Clause": 1, "BSD-3-Clause": 2, "CC-BY-4.0": 2, "Apache-2.0": 3, "MPL-2.0": 4,
    "LGPL-2.1-only": 5, "LGPL-3.0-only": 5, "GPL-2.0-only": 6, "GPL-3.0-only": 7, "AGPL-3.0-only": 8,
}
COPYLEFT = ["GPL-2.0-only", "GPL-3.0-only", "AGPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC-BY-SA-4.0"]
INCOMPATIBLE = [("GPL-2.0-only", "Apache-2.0")]
#: Ids that count as known, besides those above; others can be given to `spdx.evaluate`.
OTHER_KNOWN = [
    "0BSD", "AFL-3.0", "AGPL-3.0-or-later", "Apache-1.1", "APSL-2.0", "Artistic-1.0", "Artistic-2.0", "BlueOak-1.0.0", "BSD-1-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "BUSL-1.1", "CAL-1.0",
    "CC-BY-3.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "CPL-1.0", "ECL-2.0", "EFL-2.0", "Elastic-2.0", "EPL-1.0", "EPL-2.0",
    "EUPL-1.1", "EUPL-1.2", "FTL", "GFDL-1.3-only", "GFDL-1.3-or-later", "GPL-1.0-only", "GPL-2.0", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-or-later", "HPND", "ICU", "IJG", "ImageMagick", "IPL-1.0", "JSON",
    "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-or-later", "libpng-2.0", "LPPL-1.3c", "MIT-0", "MPL-1.1", "MPL-2.0-no-copyleft-exception", "MS-PL", "MS-RL", "MulanPSL-2.0",
    "NCSA", "NPL-1.1", "ODbL-1.0", "ODC-By-1.0", "OFL-1.1", "OpenSSL", "OSL-3.0", "PDDL-1.0", "PHP-3.01", "PostgreSQL", "PSF-2.0", "Python-2.0", "QPL-1.0", "Ruby", "SISSL", "SSPL-1.0", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
]
KNOWN_IDS = sorted({*RESTRICTIVENESS, *COPYLEFT, *OTHER_KNOWN})
KNOWN_EXCEPTIONS = ["Autoconf-exception-3.0", "Bison-exception-2.2", "Bootloader-exception", "Classpath-exception-2.0", "CLISP-exception-2.0", "eCos-exception-2.0", "Font-exception-2.0", "GCC-exception-2.0", "GCC-exception-3.1", "GPL-CC-1.0", "Libtool-exception", "Linux-syscall-note", "LLVM-exception", "OpenJDK-assembly-exception-1.0", "openvpn-openssl-exception", "Qt-LGPL-exception-1.1", "u-boot-exception-2.0", "WxWindows-exception-3.1"]


def detect_text(text: str | Column) -> Column:
    """The first fingerprint whose phrases all stand in the lower-cased, squeezed text; null if none."""
    text = F.col(text) if isinstance(text, str) else text
    # single spaces stay without being replaced, other characters go by runs
    squeezed = F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\s{2,}|[^\S ]", " "), r"[^a-z0-9./\s-]+", "")

    def first(t: Column) -> Column:
        out = None
        for spdx, phrases in FINGERPRINTS:
            out = (F if out is None else out).when(reduce(lambda a, b: a & b, [t.contains(p) for p in phrases]), F.lit(spdx))
        return out

    # a variable of a function: the text is squeezed once, not again for each phrase
    return F.get(F.transform(F.array(squeezed), first), F.lit(0))


def detected(docs: DataFrame, *columns: str) -> DataFrame:
    """columns and spdx_id of docs (text) in which an id is found; each text is read once, as a filter on an id would read it again."""
    return docs.select(*columns, F.explode(F.array_compact(F.array(detect_text("text")))).alias("spdx_id"))


def restrictiveness(spdx: str | Column) -> Column:
    spdx = F.col(spdx) if isinstance(spdx, str) else spdx
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RESTRICTIVENESS.items() for x in kv]), spdx), F.lit(9))


def detect_bundles(files: DataFrame) -> DataFrame:
    """bundle_id, spdx_id and source of files (bundle_id, path, text): license file, else the one SPDX tag, else the
    frontmatter's, else the first of several tags; with the number of distinct signals."""
    # fixed values: the patterns of license files, tags and fields
    root = files.filter(~F.col("path").contains("/") & F.lower("path").rlike(r"^(license|licence|copying)([._-].*)?$"))
    by_file = detected(root, "bundle_id", "path").groupBy("bundle_id").agg(F.min_by("spdx_id", "path").alias("file_id"))
    scanned = files.filter(F.lower("path").rlike(r"\.(py|sh|js|ts|md)$"))
    # the first 200 by path; what lies beyond is left out before rows are shuffled, so no task has all of a bundle's files
    in_first = scanned.withColumn("n", F.row_number().over(Window.partitionBy("bundle_id").orderBy("path"))).filter("n <= 200")
    tags = in_first.select("bundle_id", F.explode(F.regexp_extract_all("text", F.lit(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)"), 1)).alias("tag")).groupBy("bundle_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    front = files.filter(F.col("path").endswith("SKILL.md")).withColumn("id", F.regexp_extract(F.substring("text", 1, 4096), r"(?m)^license:\s*[\"']?([A-Za-z0-9.+-]+)", 1)).filter("id != ''").groupBy("bundle_id").agg(F.min_by("id", "path").alias("front_id"))
    out = files.select("bundle_id").distinct().join(by_file, "bundle_id", "left").join(tags, "bundle_id", "left").join(front, "bundle_id", "left").withColumn("tags", F.coalesce("tags", F.array()))
    source = F.when(F.col("file_id").isNotNull(), "license-file").when(F.size("tags") == 1, "spdx-tag").when(F.col("front_id").isNotNull(), "frontmatter").when(F.size("tags") > 1, "spdx-tag")
    spdx = F.coalesce("file_id", F.when(F.size("tags") == 1, F.get("tags", F.lit(0))), "front_id", F.get("tags", F.lit(0)))
    signals = F.size(F.array_distinct(F.array_compact(F.concat(F.array("file_id", "front_id"), F.col("tags")))))
    return out.select("bundle_id", spdx.alias("spdx_id"), source.alias("source"), signals.alias("signals"))


def license_findings(detected: DataFrame) -> DataFrame:
    """bundle_id, rule_id and severity: signals that differ; no id, and then nothing else; an id that isn't known; copyleft."""
    from corpusforge.operators.spdx import evaluate

    known = evaluate("spdx_id").valid
    rule = lambda when, slug, severity: F.when(when, F.struct(F.lit(f"core:license-{slug}").alias("rule_id"), F.lit(severity).alias("severity")))
    some = F.col("spdx_id").isNotNull()
    found = F.array_compact(F.array(rule(F.col("signals") > 1, "conflict", "medium"), rule(~some, "unknown", "medium"), rule(some & ~known, "unrecognized", "medium"), rule(some & F.col("spdx_id").isin(COPYLEFT), "copyleft", "low")))
    return detected.select("bundle_id", F.explode(found).alias("f")).select("bundle_id", "f.*")


def combine(licenses: DataFrame, by: str) -> DataFrame:
    """by, spdx_id, copyleft and findings of the licenses (by, spdx_id) of each set: the most restrictive; none where one is unknown.

    Ties go to the first id by name. Findings, comma-joined: license-unknown, license-incompatible, license-copyleft-mix.
    """
    grouped = licenses.groupBy(by).agg(
        F.bool_or(F.col("spdx_id").isNull()).alias("unknown"),
        F.max(F.when(F.col("spdx_id").isNotNull(), restrictiveness("spdx_id"))).alias("most"),
        F.min(F.when(F.col("spdx_id").isNotNull(), restrictiveness("spdx_id"))).alias("least"),
        F.sort_array(F.collect_set("spdx_id")).alias("ids"),
    )
    first = F.get(F.filter("ids", lambda x: restrictiveness(x) == F.col("most")), F.lit(0))
    spdx = F.when(~F.col("unknown"), first)
    clash = reduce(lambda a, b: a | b, [F.array_contains("ids", a) & F.array_contains("ids", b) for a, b in INCOMPATIBLE])
    mix = spdx.isin(COPYLEFT) & (F.col("least") < F.col("most"))
    notes = F.array_compact(F.array(F.when(F.col("unknown"), "license-unknown"), F.when(clash, "license-incompatible"), F.when(F.coalesce(mix, F.lit(False)), "license-copyleft-mix")))
    return grouped.select(by, spdx.alias("spdx_id"), F.coalesce(spdx.isin(COPYLEFT), F.lit(False)).alias("copyleft"), F.array_join(notes, ",").alias("findings"))


def override_unknown(detected: DataFrame, catalog: DataFrame) -> DataFrame:
    """Detected (bundle_hash, spdx_id) with the catalog's id (bundle_hash, catalog_spdx) where none was detected."""
    return detected.join(catalog.select("bundle_hash", "catalog_spdx"), "bundle_hash", "left").withColumn("spdx_id", F.coalesce("spdx_id", "catalog_spdx")).drop("catalog_spdx")
