"""Texts and lines are read once by patterns, however many checks use the result."""

from corpusforge.operators import license_ids, scan
from corpusforge.plans.queries import QUERIES, _scan_files
from tests.conftest import SMALL


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_squeezed_once(spark):
    assert _optimized(QUERIES["license_combine_by_source"](spark, SMALL)).count("regexp_replace") <= 4
    texts = ["The  MIT,\nPermission is hereby granted, free of\t\tcharge", "nothing", None, "Mozilla Public License,  version 2.0"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert sorted(license_ids.detected(docs, "doc_id").collect()) == [(0, "MIT"), (3, "MPL-2.0")]

def test_names_of_dependencies_are_found_once(spark):
    plan = _optimized(QUERIES["dependency_findings"](spark, SMALL))
    assert plan.count("levenshtein") <= 2  # one for each use of the names in the union's first branch, none in a pushed filter
    assert not any("levenshtein" in x for x in plan.splitlines() if x.strip(" :+-").startswith("Filter"))


def test_checks_find_the_same_on_lines_of_interest(spark):
    lines = scan.lines_of(scan.readable(_scan_files(spark, SMALL))[0])
    odd = [("nc x ~/.ssh/id", 1), ("ence a.env b", 2), ("﻿x​", 3), ("pаypal", 4), ("a" * 39, 5), ("QUJD" * 12, 6), ("see HTTP://10.1.2.3/", 7), ("ſcp .netrc", 8), ("groß", 9)]
    lines = lines.unionByName(spark.createDataFrame([("odd", "a.sh", "script", n, t) for t, n in odd], "bundle_id string, path string, kind string, line_no int, line string"))
    kept = scan.of_interest(lines)
    assert kept.columns == lines.columns and kept.count() < lines.count()
    for check in (scan.line_findings, scan.credential_findings, scan.unicode_findings, scan.domain_findings, scan.encoded_payloads, scan.dependency_findings):
        whole = sorted(map(tuple, check(lines).collect()))
        assert whole == sorted(map(tuple, check(kept).collect()))
        assert whole or check is scan.encoded_payloads
