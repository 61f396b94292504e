"""Operators above their former limits, and values that once slipped through."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from attestlake.functions.hashing import canonical_json
from attestlake.operators import claims, detectors, filters


def test_hash_lists_of_any_length_take_one_path(spark):
    sha = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    df = spark.createDataFrame([("h", sha(i), f"n{i}") for i in range(5)] + [("h", None, "none")], "host string, sha1 string, name string")
    for n in (2, 1001, 3000):
        wanted = [sha(i).upper() + " " for i in range(3, 3 + n)]
        found = filters.program_filter(df, wanted)
        assert found.columns == df.columns and sorted(r.name for r in found.collect()) == ["n3", "n4"]
    assert filters.program_filter(df, []).count() == 6
    assert filters.program_filter(df, df.limit(0)).count() == 0


def test_empty_lists_do_not_filter(spark):
    df = spark.createDataFrame([("p", "s", "x", None)], "plugin string, source_short string, parser_name string, ts timestamp")
    assert filters.plugin_filter(df, []).count() == 1 and filters.plugin_filter(df, ["q"]).count() == 0
    assert filters.timeline_filter(df, sources=[], parsers=[]).count() == 1


def test_large_files_are_searched_or_reported(spark):
    df = spark.createDataFrame([("a", False, 10**12), ("b", False, 5), ("c", True, 0)], "filename string, deleted boolean, file_size_bytes bigint")
    assert {r.filename for r in filters.search_prefilter(df).collect()} == {"a", "b"}
    assert {r.filename for r in filters.search_prefilter(df, max_bytes=100).collect()} == {"b"}
    (left,) = filters.search_skipped(df, 100).collect()
    assert left.filename == "a" and "100" in left.skipped


def test_handle_without_process_name_is_kept(spark):
    schema = "host string, plugin string, data string"
    row = {"Name": "lsass.exe", "GrantedAccess": "VM_READ|QUERY", "PID": 4}
    rows = [("h", detectors.HANDLE_PLUGINS[0], json.dumps(r)) for r in (row, row | {"Process": "WerFault.exe"}, row | {"Process": "x"})]
    df = spark.createDataFrame(rows, schema).withColumn("data", F.parse_json("data"))
    assert sorted(r.process or "" for r in detectors.lsass_handles(df).collect()) == ["", "x"]


def test_hypothesis_with_late_attempts_only_is_given_up(spark):
    rows = [("r", "h", 7, "c", "verified")]
    attempts = spark.createDataFrame(rows, "run_id string, hypothesis string, attempt int, claim_id string, verdict string")
    (found,) = claims.revision_outcome(attempts).collect()
    assert found.gave_up and found.n_events == 0 and found.final_verdict is None


@pytest.mark.parametrize(
    "kind, value",
    [
        ("struct<x:double>", "struct({})"),
        ("array<struct<y:double>>", "array(struct({}))"),
        ("map<string,double>", "map('k', {})"),
        ("array<array<double>>", "array(array({}))"),
        ("struct<a:struct<b:array<double>>>", "struct(struct(array({})))"),
    ],
)
def test_numbers_at_any_depth(spark, kind, value):
    cell = lambda number: spark.sql(f"SELECT CAST({value.format(f'double({number!r})')} AS {kind}) AS s")
    text = lambda df: df.select(canonical_json(df, ["s"]).alias("j")).first().j
    assert text(cell("NaN")) is None and text(cell("Infinity")) is None
    found = text(cell("1e20"))
    assert "1.0e20" in found and json.loads(found)
    assert text(cell("2.0")).count("2") == 1 and "2.0" not in text(cell("2.0"))
    nothing = spark.sql(f"SELECT CAST(NULL AS {kind}) AS s")
    assert text(nothing) == '{"s":null}'


def test_long_value_lists_are_not_multiplied(spark):
    values = [json.dumps(i) for i in range(3000)]
    predicate = {"a": values, "b": values, "c": values}
    evidence = spark.createDataFrame(
        [("c", 0, "r", predicate), ("d", 0, "r", {"a": ["7"], "b": ["8"]}), ("e", 0, "r", {})],
        "claim_id string, evidence_idx int, receipt_id string, predicate map<string,array<string>>",
    )
    records = spark.createDataFrame(
        [("r", 0, {"a": "7", "b": "8", "c": "2999"}), ("r", 1, {"a": "7", "b": "9", "c": "3000"}), ("r", 2, {"a": "7"})],
        "receipt_id string, ordinal bigint, record map<string,string>",
    )
    found = {r.claim_id: (r.n_matches, r.first_match) for r in claims.match_predicate(evidence, records).collect()}
    assert found == {"c": (1, 0), "d": (1, 0), "e": (3, 0)}
    hits = claims.predicate_hits(evidence, records).collect()
    assert sorted((r.claim_id, r.ordinal) for r in hits) == [("c", 0), ("d", 0), ("e", 0), ("e", 1), ("e", 2)]
