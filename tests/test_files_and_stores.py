import glob
import os

import pytest
from pyspark.sql import functions as F

from attestry.operators import publishing
from attestry.operators.cascade import Key, deleted, in_order
from attestry.operators.publishing import FactStore
from attestry.sources import files


def test_payloads_are_admitted_or_named_with_a_reason(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in {"good.pdf": b"%PDF-1.7 x", "sub/UPPER.PDF": b"%PDF-", "note.txt": b"%PDF-1.7", "fake.pdf": b"PDF-1.7", "empty.pdf": b"", "large.pdf": b"%PDF-" + b"x" * 2000, "large.txt": b"x" * 3000, "edge.pdf": b"%PDF-".ljust(1024, b"y")}.items():
        (tmp_path / name).write_bytes(content)
    accepted, rejected = files.payloads(spark, str(tmp_path), 1 / 1024)
    assert sorted(os.path.basename(r.path) for r in accepted.collect()) == ["UPPER.PDF", "edge.pdf", "good.pdf"]
    assert all(r.document_id == "doc-" + r.sha256[:20] for r in accepted.collect())
    assert {os.path.basename(r.path): (r.code, r.reason) for r in rejected.collect()} == {"note.txt": (400, "suffix"), "fake.pdf": (400, "magic"), "empty.pdf": (400, "magic"), "large.pdf": (413, "size"), "large.txt": (400, "suffix")}


def test_json_rows_and_rejects(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id":"1","group":"g","text":"t","n":2}\n\n{"id":"2","group":"","text":"t"}\n{"id":"3","group":"g"}\n{"id":"4"\n[1]\n"text"\n{"id":5,"group":"g","text":"t","n":"x"}\n   \n')
    rows, rejects = files.json_rows(spark, str(tmp_path / "in.jsonl"), "id string, `group` string, text string, n int", ("id", "group", "text"))
    assert [tuple(r) for r in rows.collect()] == [("1", "g", "t", 2)]
    assert sorted(r.reason for r in rejects.collect()) == ["malformed"] * 4 + ["missing group", "missing text"]
    assert '{"id":"4"' in [r.line for r in rejects.collect()]
    (tmp_path / "empty.jsonl").write_text("\n \n")
    with pytest.raises(ValueError, match="no rows"):
        files.json_rows(spark, str(tmp_path / "empty.jsonl"), "id string", ("id",))


def test_gold_records(spark, tmp_path):
    path = tmp_path / "gold.jsonl"
    path.write_text('{"item_id":"1","kind":"claim","annotation":{"synthetic":true},"text":"a"}\n{"item_id":"2","kind":"note","annotation":{"synthetic":true}}\n{"item_id":"3","kind":"claim"}\n')
    rows, rejects = files.gold_records(spark, str(path), strict=False)
    assert [r.item_id for r in rows.collect()] == ["1"] and [r.reason for r in rejects.collect()] == ["not a synthetic claim"] * 2
    with pytest.raises(ValueError, match="not a synthetic claim"):
        files.gold_records(spark, str(path))


@pytest.fixture
def facts(spark):
    rows = [(f"f{i:03}", i % 9 != 0, ["=sum", "+x", "@y", "plain", None, 'say "so"', "a,b", "-1", "two\nlines"][i % 9], "p", i / 8, f"={i}%", "percentage", "%", f"FY{i % 5}", "reported", None, "SUPPORTED", "", i) for i in range(200)]
    shape = "fact_id string, active boolean, subject string, predicate string, value_num double, raw_value string, value_type string, unit string, period string, modality string, scope string, status string, reason string, revision int"
    return spark.createDataFrame(rows, shape).withColumn("value_num", F.col("value_num").cast("decimal(24,8)"))


def test_csv_is_ordered_and_neutralized(spark, tmp_path, facts):
    rows = files.export_rows(facts)
    files.export_csv(rows, str(tmp_path / "csv"))
    written = sorted(glob.glob(str(tmp_path / "csv" / "part-*")))
    assert all(open(f).readline().strip() == ",".join(files.EXPORTED) for f in written)
    back = [r for f in written for r in files.read_csv(spark, f, rows.schema).collect()]
    assert [tuple(r) for r in back] == [tuple(None if v == "" else v for v in r) for r in files.neutralized(rows).orderBy(*(F.asc_nulls_first(c) for c in files.ORDER)).collect()]
    assert {r.subject for r in back} == {"'+x", "'@y", "plain", None, 'say "so"', "a,b", "-1", "two\nlines"} and all(r.display_value.startswith("'=") for r in back)
    assert {r.normalized_value for r in back} >= {"0.125", "1.25", "3"} and len(back) == 177


def test_json_is_ordered(spark, tmp_path, facts):
    rows = files.export_rows(facts)
    files.export_json(rows, str(tmp_path / "json"))
    back = [tuple(r) for f in sorted(glob.glob(str(tmp_path / "json" / "part-*"))) for r in spark.read.schema(rows.schema).json(f).collect()]
    assert back == [tuple(r) for r in rows.orderBy(*(F.asc_nulls_first(c) for c in files.ORDER)).collect()]


def test_deletion_follows_keys(spark):
    frame = lambda rows, shape: spark.createDataFrame(rows, shape)
    tables = {
        "space": frame([("a",), ("b",), (None,)], "id string"),
        "doc": frame([(1, "a"), (2, "b"), (3, None), (4, "a")], "doc int, space string"),
        "claim": frame([(10, 1), (11, 2), (12, 4), (13, None)], "claim int, doc int"),
        "vector": frame([(1, 10, "s1"), (2, 11, "s2"), (3, 11, "s1"), (4, None, None), (5, 11, None), (6, 10, "s1")], "v int, claim int, kind string"),
        "kind": frame([("s1", "a"), ("s2", "b")], "kind string, space string"),
        "other": frame([(1,)], "x int"),
    }
    keys = [Key("vector", "claim", "claim", "claim"), Key("vector", "kind", "kind", "kind"), Key("claim", "doc", "doc", "doc"), Key("doc", "space", "space", "id"), Key("kind", "space", "space", "id"), Key("space", "id", "world", "id")]
    assert in_order("space", keys) == ["space", "doc", "kind", "claim", "vector"]
    kept, counts = deleted(tables, keys, "space", frame([("a",), (None,)], "id string"))
    assert {r.name: (r.deleted, r.kept) for r in counts.collect()} == {"space": (1, 2), "doc": (2, 2), "kind": (1, 1), "claim": (2, 2), "vector": (3, 3)}
    assert sorted(r.v for r in kept["vector"].collect()) == [2, 4, 5] and kept["other"] is tables["other"]
    assert all(kept[t].columns == tables[t].columns for t in tables)
    with pytest.raises(ValueError, match="in use"):
        deleted(tables, keys, "space", frame([("a",)], "id string"), frame([("a",)], "run_space string"))
    deleted(tables, keys, "space", frame([("a",)], "id string"), frame([("b",)], "run_space string"))
    with pytest.raises(ValueError, match="go round"):
        in_order("a", [Key("b", "x", "a", "x"), Key("c", "x", "b", "x"), Key("b", "y", "c", "y")])


def states(spark, rows):
    return spark.createDataFrame(rows, "fact_id string, status string, value_num double, raw_value string, representative string, n_evidence long, members string")


def test_publishing_that_breaks_off_and_is_repeated(spark, tmp_path, monkeypatch):
    one = states(spark, [("a", "SUPPORTED", 1.0, "1", "x", 1, "m"), ("b", "SUPPORTED", 2.0, "2", "y", 1, "m")])
    two = states(spark, [("a", "CONTESTED", 1.0, "1", "x", 2, "n"), ("c", "SUPPORTED", 3.0, "3", "z", 1, "m")])
    store = FactStore(spark, str(tmp_path / "facts"))
    assert store.revision() == 0 and store.versions().count() == 0
    assert store.publish(one) == 1 and store.publish(one) == 1  # nothing changed
    before = sorted(store.versions().collect()), sorted(store.snapshot().collect())
    write = FactStore._write

    def broken(self, df, kind, revision):
        if kind == "published":
            raise RuntimeError("broken off")
        return write(self, df, kind, revision)

    monkeypatch.setattr(publishing.FactStore, "_write", broken)
    with pytest.raises(RuntimeError):
        store.publish(two)
    monkeypatch.undo()
    assert (sorted(store.versions().collect()), sorted(store.snapshot().collect())) == before and store.revision() == 1
    store = FactStore(spark, str(tmp_path / "facts"))  # opened anew
    assert store.publish(two) == 2
    assert sorted(r.version_id for r in store.versions().collect()) == ["a-v1", "a-v2", "b-v1", "c-v1"]
    assert {r.fact_id: (r.revision, r.active) for r in store.snapshot().collect()} == {"a": (2, True), "b": (1, False), "c": (1, True)}
    assert store.publish(one) == 3  # b comes back, c goes, a is as it was at first
    assert {r.fact_id: (r.revision, r.active) for r in store.snapshot().collect()} == {"a": (3, True), "b": (2, True), "c": (1, False)}
