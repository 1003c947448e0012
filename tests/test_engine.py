import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from mergeloom.cli import main
from mergeloom.operators import dedup, entity, validate
from mergeloom.operators.components import components
from mergeloom.operators.profile import profile_table
from mergeloom.operators.union import SourceTable, UnionError, unify
from mergeloom.plans import contracts as c
from mergeloom.plans.guards import apply_guards
from mergeloom.plans.propose import FakeProvider, FileProfile, propose
from mergeloom.sources.sinks import write_merged
from mergeloom.sources.tables import read_tables, sniff
from mergeloom.sources.xlsx import Workbook, write_workbook
from mergeloom.streaming.coerce import project_stream

SCHEMA = c.TargetSchema([c.TargetColumn("name", "string", True), c.TargetColumn("price", "decimal"), c.TargetColumn("day", "date")])


def plan(**targets):
    return c.Mapping([c.MappingEntry(t, [c.SourceMatch(f, col, 1.0, "auto" if col else "unmatched") for f, col in by.items()]) for t, by in targets.items()])


def files(tmp_path):
    (tmp_path / "tr.csv").write_bytes("urun;fiyat;tarih\nKola 33cl;12,50;05.01.2024\nÇay;1.234,56;yok\nKola 33cl;12,50;05.01.2024\n".encode("cp1254"))
    (tmp_path / "en.csv").write_text('product,price,date\n"Kola, 330 ml",12.5,2024-01-05\n"KOLA 330ML",12.50,2024-01-05\n', encoding="utf-8-sig")
    return plan(name={"tr.csv": "urun", "en.csv": "product"}, price={"tr.csv": "fiyat", "en.csv": "price"}, day={"tr.csv": "tarih", "en.csv": "date"})


def merged_files(spark, tmp_path):
    mapping = files(tmp_path)
    tables = [t for f in ("tr.csv", "en.csv") for t in read_tables(spark, tmp_path / f)]
    return unify(tables, mapping, SCHEMA), mapping


def test_union_over_encodings(spark, tmp_path):
    merged, _ = merged_files(spark, tmp_path)
    assert sniff(tmp_path / "tr.csv") == ("cp1254", ";")
    rows = merged.df.orderBy("_file_idx", "_row_idx").collect()
    assert [(r.name, r.price, str(r.day), r._source_file, r._p_price) for r in rows] == [
        ("Kola 33cl", 12.5, "2024-01-05", "tr.csv", "fiyat"), ("Çay", 1234.56, "None", "tr.csv", "fiyat"), ("Kola 33cl", 12.5, "2024-01-05", "tr.csv", "fiyat"),
        ("Kola, 330 ml", 12.5, "2024-01-05", "en.csv", "price"), ("KOLA 330ML", 12.5, "2024-01-05", "en.csv", "price")]
    assert merged.failures().first().asDict() == {"name": 0, "price": 0, "day": 1}


def test_union_refuses(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "x string")
    schema = c.TargetSchema([c.TargetColumn("name", "string")])
    with pytest.raises(UnionError, match="no column"):
        unify([SourceTable("f", "f", df)], plan(name={"f": "y"}), schema)
    with pytest.raises(UnionError, match="differ"):
        unify([SourceTable("f", "f", df)], plan(other={"f": "x"}), schema)
    with pytest.raises(UnionError, match="unique"):
        unify([SourceTable("a/f", "f", df), SourceTable("b/f", "f", df)], plan(name={"f": "x"}), schema)


def test_sheets(spark, tmp_path):
    path = tmp_path / "book.xlsx"
    write_workbook(str(path), {"Jan": (["name", "price"], [("a", 1.5), ("b", None)]), "Feb": (["name"], [("c",)]), "Towns": (["town"], [("x",)])})
    assert list(Workbook(path.read_bytes()).sheets) == ["Jan", "Feb", "Towns"]
    tables = read_tables(spark, path)
    merged = unify(tables, plan(name={"book.xlsx": "name"}, price={"book.xlsx": "price"}, day={"book.xlsx": None}), SCHEMA)
    assert merged.skipped == ["book.xlsx#Towns"]
    rows = merged.df.orderBy("_sheet_idx", "_row_idx").collect()
    assert [(r.name, r.price, r._source_file, r._p_price) for r in rows] == [("a", 1.5, "book.xlsx#Jan", "price"), ("b", None, "book.xlsx#Jan", "price"), ("c", None, "book.xlsx#Feb", "price")]
    assert [t.label for t in read_tables(spark, path, "Feb")] == ["book.xlsx"]
    with pytest.raises(ValueError, match="no sheet"):
        read_tables(spark, path, "Mar")


def test_profile(spark):
    df = spark.createDataFrame([("1", "12,5", "05.01.2024", "evet", None), ("2", "1.234,5", "2024-01-06", "no", "x"), ("3", "NA", "", "yes", "y")], "a string, b string, d string, e string, f string")
    got = {r.name: r for r in profile_table(df, "t").collect()}
    assert [got[k].inferred_type for k in "abdef"] == ["integer", "decimal", "date", "boolean", "string"]
    assert [got[k].format_pattern for k in "abdef"] == ["integer", "mixed_numeric", "mixed_date", "boolean_text", None]
    assert got["b"].null_ratio == pytest.approx(1 / 3) and got["a"].samples == ["1", "2", "3"] and got["d"].min == "2024-01-05T00:00:00"
    assert [r.null_ratio for r in profile_table(df.limit(0), "t").collect()] == [0.0] * 5


def test_profile_samples_cover_the_whole_column(spark):
    """A column whose first values come late in a sparse table has samples, in the order of rows, and few rows are dealt out."""
    late = F.when(F.col("id") >= 15_000, F.concat(F.col("id").cast("string"), F.lit(" EUR")))
    df = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("_row_idx"), late.alias("price"), F.lit(None).cast("string").alias("none"))
    profile = profile_table(df, "t", sample_size=3)
    got = {r.name: r.samples for r in profile.collect()}
    assert got == {"price": ["15000 EUR", "15001 EUR", "15002 EUR"], "none": []}
    assert "WindowGroupLimit" in profile._jdf.queryExecution().toString()


def greedy(rows, members):
    """The row-by-row rule: fold into the first survivor of the key that lacks the spelling."""
    out = []
    for spelling, rest in rows:
        hit = members.get(spelling)
        if hit is None:
            out.append([None, spelling, rest, [spelling]])
            continue
        canonical, cluster = hit
        for s in out:
            if s[:3] == [cluster, canonical, rest] and spelling not in s[3]:
                s[3].append(spelling)
                break
        else:
            out.append([cluster, canonical, rest, [spelling]])
    return [(s[1], s[2], len(s[3]) if s[0] else 1, "; ".join(s[3]) if s[0] else None) for s in out]


def test_dedup_against_the_greedy_rule(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "A", "á", "b", "B", "z"]), rng.choice([1.0, 2.0, None])) for _ in range(150)]
    df = spark.createDataFrame([(n, p, None, i) for i, (n, p) in enumerate(rows)], "name string, price double, day string, _row_idx long")
    merged = unify([SourceTable("f", "f", df)], plan(name={"f": "name"}, price={"f": "price"}, day={"f": None}), SCHEMA)
    member = c.ClusterMember
    clusters = c.Clusters([c.Cluster("c1", "name", "a", "auto", [member("a"), member("A"), member("á")]), c.Cluster("c2", "name", "b", "review", [member("b"), member("B")])])
    got = dedup.deduplicate(merged, clusters).df.orderBy("_row_idx").collect()
    expected = greedy(rows, {m: ("a", "c1") for m in ("a", "A", "á")})
    assert [(r.name, r.price, r._merged_row_count, r.name_original_value) for r in got] == expected


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200, i) for i in range(201, 240)] + [(7, 7)]
    label = {}
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters(spark):
    rows = [(0, "Kola 33cl", 3), (1, "KOLA 330 ml", 1), (2, "Kola 330ML light", 1), (3, "Su 1 lt", 2), (4, None, 1)]
    records = spark.createDataFrame(rows, "idx long, value string, row_count long")
    blocked = entity.with_blocks(records)
    assert blocked.where("block = '<unblocked>'").count() == 1 and entity.pair_count(blocked).first().pair_count == 3
    decisions = entity.score_pairs(entity.candidate_pairs(blocked), blocked, thresholds=entity.Thresholds(0.9, 0.5))
    answer = FakeProvider('```json\n{"same": false, "confidence": 0.9, "reason": "light"}\n```')
    decisions = entity.advise(decisions, answer.complete)
    found = entity.cluster_plan(decisions, records, "name").clusters
    assert [(x.cluster_id, x.canonical, x.status, [m.value for m in x.members]) for x in found] == [("c001", "Kola 33cl", "review", ["Kola 33cl", "KOLA 330 ml"])]
    assert [(k.value, k.suggestion) for k in found[0].candidates] == [("Kola 330ML light", "different")]


def test_pairs_of_one_large_block(spark):
    rows = [(i, f"Kola {i}") for i in range(100)] + [(7, "Kola 7"), (None, "Kola x"), (200, "Su"), (201, "")]
    blocked = entity.with_blocks(spark.createDataFrame(rows, "idx long, value string"))
    assert blocked.rdd.getNumPartitions() >= 4
    for rows_a_tile in (1, 16, 2048):
        pairs = entity.candidate_pairs(blocked, tile_rows=rows_a_tile).withColumn("task", F.spark_partition_id()).collect()
        want = [(i, j) for i in range(100) for j in range(i + 1, 100) for _ in range(1 + (7 in (i, j)))]
        assert sorted((r.left_idx, r.right_idx) for r in pairs) == want
        assert all((r.left_value, r.right_key) == (f"Kola {r.left_idx}", f"kola {r.right_idx}") for r in pairs)
        tasks = [r.task for r in pairs]
        assert rows_a_tile > 100 or max(map(tasks.count, set(tasks))) < 0.6 * len(tasks)


def test_contracts_round_trip(tmp_path):
    c.dump_schema(SCHEMA, tmp_path / "s.yaml")
    assert c.load_schema(tmp_path / "s.yaml") == SCHEMA
    mapping = plan(name={"f": "x"})
    c.dump_mapping(mapping, tmp_path / "m.yaml")
    assert c.load_mapping(tmp_path / "m.yaml") == mapping
    (tmp_path / "e.yaml").write_text("")
    assert c.load_clusters(tmp_path / "e.yaml").clusters == []
    for bad in ("- {target_column: a, sources: [{file: f, column: x, confidence: 2, status: auto}]}", "- {target_column: a, sources: [{file: f, column: x, confidence: 1, status: maybe}]}", "{}"):
        (tmp_path / "b.yaml").write_text(bad)
        with pytest.raises(c.ContractError):
            c.load_mapping(tmp_path / "b.yaml")
    with pytest.raises(c.ContractError, match="canonical"):
        c.Clusters([c.Cluster("c1", "name", "x", "auto", [c.ClusterMember("y")])])


def test_guards():
    schema = plan(unit_price={"a.csv": "Toplam Tutar", "b.csv": "Birim Fiyat (TL)", "c.csv": "price_usd"})
    out = apply_guards(schema, {}).entries[0].sources
    assert [s.status for s in out] == ["review"] * 3 and "total" in out[0].reason and "currencies" in out[1].reason
    assert [s.status for s in apply_guards(plan(city={"a.csv": "sehir"}), {}).entries[0].sources] == ["auto"]


def test_propose():
    columns = [{"name": n, "samples": ["1"], "inferred_type": "string", "unique_count": 1, "null_ratio": 0.0, "min": None, "max": None, "format_pattern": None} for n in ("x", "y")]
    answer = '{"matches": [{"target_column": "name", "source_column": "x", "confidence": 0.95, "reason": "r"}, {"target_column": "price", "source_column": "y", "confidence": 0.4, "reason": "r"}, {"target_column": "day", "source_column": null, "confidence": 0.9, "reason": "r"}, {"target_column": "nope", "source_column": "x", "confidence": 1, "reason": "r"}]}'
    provider = FakeProvider(answer)
    got = propose([FileProfile("f.csv", columns)], SCHEMA, provider)
    assert [e.sources[0].status for e in got.entries] == ["auto", "review", "unmatched"] and len(provider.calls) == 1
    assert [e.sources[0].status for e in propose([FileProfile("f.csv", columns)], SCHEMA, FakeProvider("no")).entries] == ["review"] * 3


def test_validation(spark):
    schema = c.TargetSchema([c.TargetColumn("v", "decimal", True), c.TargetColumn("s", "string"), c.TargetColumn("d", "date")])
    rows = [(str(i), "1,5" if i % 2 else "1.5", "2024-01-01", i) for i in range(20)] + [("1000", "x", "1700-01-01", 20), ("bad", None, None, 21)]
    merged = unify([SourceTable("f", "f", spark.createDataFrame(rows, "v string, s string, d string, _row_idx long"))], plan(v={"f": "v"}, s={"f": "s"}, d={"f": "d"}), schema)
    mapping = plan(v={"f": "v"}, s={"f": "s"}, d={"f": "d"})
    report = validate.validate(merged, mapping, validate.Settings(max_year=2030))
    assert [(f.check, f.severity, f.target) for f in report.findings] == [("type", "warning", "v"), ("outlier", "warning", "v"), ("required", "error", "v"), ("type", "warning", "s"), ("outlier", "warning", "d")]
    assert report.blocking and validate.downgrade(mapping, report).pending()[0][0] == "v" and report.verdict("v") == "1 error, 2 warnings"


def test_sql_script_runs(spark, tmp_path):
    merged, mapping = merged_files(spark, tmp_path)
    done = write_merged(merged, mapping, tmp_path / "out", "sql")
    with sqlite3.connect(":memory:") as db:
        db.executescript(done.path.read_text(encoding="utf-8"))
        assert db.execute("SELECT name, price, day FROM merged WHERE _source_file = 'en.csv'").fetchall() == [("Kola, 330 ml", 12.5, "2024-01-05"), ("KOLA 330ML", 12.5, "2024-01-05")]
    assert list(Workbook(done.report.read_bytes()).sheets) == ["Summary", "Columns", "Entity", "Validation"]


def test_cli(spark, tmp_path, capsys):
    mapping = files(tmp_path)
    c.dump_schema(SCHEMA, tmp_path / "schema.yaml")
    mapping.entries[0].sources[0].status = "review"
    c.dump_mapping(mapping, tmp_path / "mapping.yaml")
    args = ["apply", "--mapping", str(tmp_path / "mapping.yaml"), "--out", str(tmp_path / "merged.csv"), "--target-schema", str(tmp_path / "schema.yaml")]
    assert main(args, spark) == 3 and not (tmp_path / "merged.csv").exists()
    mapping.entries[0].sources[0].status = "auto"
    c.dump_mapping(mapping, tmp_path / "mapping.yaml")
    cluster = ["cluster", "--mapping", str(tmp_path / "mapping.yaml"), "--column", "name", "--out", str(tmp_path / "clusters.yaml"), "--high", "0.95"]
    assert main(cluster, spark) == 0
    assert main([*cluster[:4], "price", *cluster[5:]], spark) == 2
    assert [[m.value for m in x.members] for x in c.load_clusters(tmp_path / "clusters.yaml").approved()] == [["Kola 33cl", "Kola, 330 ml", "KOLA 330ML"]]
    # A third of the dates of one file does not fit: that stops the merge.
    assert main(args, spark) == 3
    (tmp_path / "tr.csv").write_bytes("urun;fiyat;tarih\nKola 33cl;12,50;05.01.2024\nÇay;1.234,56;\nKola 33cl;12,50;05.01.2024\n".encode("cp1254"))
    assert main([*args, "--clusters", str(tmp_path / "clusters.yaml")], spark) == 0
    lines = (tmp_path / "merged.csv").read_text(encoding="utf-8").splitlines()
    assert [x.split(",")[0] for x in lines[1:]] == ["Kola 33cl", "Çay", "Kola 33cl"] and lines[1].endswith(",3") and lines[3].endswith(",1")
    assert main(["profile", "--input", str(tmp_path / "tr.csv")], spark) == 0 and "pattern=mixed_numeric" in capsys.readouterr().out
    assert main(["analyze", "--inputs", str(tmp_path / "en.csv"), "--target-schema", str(tmp_path / "schema.yaml"), "--out", str(tmp_path / "m2.yaml")], spark) == 0
    assert main(["profile", "--input", str(tmp_path / "nothing.csv")], spark) == 2


def test_stream_is_the_batch_projection(spark, tmp_path):
    spark.createDataFrame([("a", "1,5"), ("b", "x")], "n string, p string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n string, p string").parquet(str(tmp_path / "in"))
    out = project_stream(stream, "f", plan(name={"f": "n"}, price={"f": "p"}, day={"f": None}), SCHEMA)
    query = out.writeStream.format("memory").queryName("projected").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r.name, r.price, r._bad_price) for r in spark.table("projected").orderBy("name").collect()] == [("a", 1.5, False), ("b", None, True)]
