import json
import os
import zipfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from panelrisk.operators.checks import announced_counts
from panelrisk.operators.eda import mark_duplicates
from panelrisk.plans.roles import Roles
from panelrisk.sources import archives, documents, readers, tables
from panelrisk.streaming import incremental

FOLDER = "/root/testdata/sf0.001"
HEADER = "Année;Numéro;Département;Code INSEE;Nom de la commune;Date de première alerte;Surface parcourue (m2);Surface forêt (m2);Surface maquis garrigues (m2);Type de peuplement;Nature"


def event(i, ts="2010-07-01 12:30:00", size="100"):
    return f'2010;{i};2A;2A004;"Aja;ccio";{ts};{size};50;;3;'


@pytest.fixture(scope="module")
def exports(tmp_path_factory):
    folder = tmp_path_factory.mktemp("archives")
    for name, above, n, announced in (("a.zip", 2, 3, 3), ("b.zip", 3, 2, 2), ("c.zip", 6, 4, 5)):
        pre = ["Export", f"Nombre de la sélection : {announced}", "de : 2010-01-01 jusqu'à : 2011-01-01", '"2010 - 12 :";"lost records"', "", ""][:above]
        lines = pre + [HEADER] + [event(i) for i in range(n - 1)] + [event(99, "not a date", "x")]
        with zipfile.ZipFile(folder / name, "w") as z:
            z.writestr("readme.txt", "ignore")
            z.writestr("data/Incendies.csv", "\r\n".join(lines))
    return str(folder / "*.zip")


def test_floating_headers(spark, exports):
    events, meta = readers.read_event_exports(spark, exports)
    per = {r.source: (r.header_line, r.announced, r.rows, r.start) for r in meta.collect()}
    assert per == {"a.zip": (2, 3, 3, None), "b.zip": (3, 2, 2, "2010-01-01"), "c.zip": (6, 5, 4, "2010-01-01")}
    assert meta.filter("source = 'c.zip'").first().notes == ["2010 - 12 : lost records"]
    assert announced_counts(meta).first().status == "FAIL"
    assert events.count() == 9 and events.filter("ts IS NULL").count() == 3 and events.filter("size IS NULL").count() == 3
    r = events.filter("ts IS NOT NULL").first()
    assert (r.dep, r.source_code, r.name, r.hour, str(r.day), r.forest_size, r.scrub_size) == ("2A", "2A004", "Aja;ccio", 12, "2010-07-01", 50.0, None)
    marked = mark_duplicates(events, ("source_code", "ts", "size"))
    assert marked.count() == 9 and marked.filter("suspect").count() == 9


def test_wide_and_blank_headers(spark, tmp_path):
    """More than 64 columns, and a blank header field, neither cut nor shift a record."""
    extra = [f"X{i}" for i in range(70)]
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        names = HEADER.split(";")
        head = [*names[:2], "", *extra, *names[2:]]
        values = ["2010", "7", "blank", *("x" for _ in extra), "2A", "2A004", "Ajaccio", "2010-07-01 12:30:00", "100", "50", "", "3", "lightning"]
        z.writestr("a/INCENDIES.CSV", "\n".join([";".join(head), ";".join(values), ""]))
    events, meta = readers.read_event_exports(spark, str(tmp_path / "w.zip"))
    r = events.first()
    assert (r.number, r.dep, r.source_code, r.size, r.forest_size, r.scrub_size, r.stand_type, r.cause) == ("7", "2A", "2A004", 100.0, 50.0, None, "3", "lightning")
    assert meta.first().rows == 1


def test_an_archive_without_an_export_is_named(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("other.csv", "x")
    with pytest.raises(Exception, match="holds no incendies.csv"):
        readers.archive_lines(spark, str(tmp_path / "none.zip")).count()


def test_entities(spark, tmp_path):
    head = ",".join(readers.ENTITY_COLUMNS)
    lines = [head, "01001,Un,01,84,46.1,4.9,15.2,800.0,52.6,242.0,180.0,300.0,6.0", "2A001,Deux,2A,94,41.9,8.7,10,5,0.5,500,9589,400,7", "97101,Loin,971,01,16,-61,1,1,1,1,1,2,1", "02001,Sans,02,32,,,1,1,1,1,1,2,1"]
    path = tmp_path / "entities.csv"
    path.write_text("\n".join(lines), encoding="utf-8")
    out = {r.code: r for r in readers.read_entities(spark, str(path)).collect()}
    assert set(out) == {"01001", "2A001"}
    assert out["01001"].population == 800 and out["01001"].dep == "01" and out["01001"].alt_min == 180
    assert (out["2A001"].alt_min, out["2A001"].alt_mean, out["2A001"].alt_max) == (None, None, None)


def test_moves_keep_text(spark, tmp_path):
    path = tmp_path / "moves.csv"
    path.write_text("MOD,DATE_EFF,TYPECOM_AV,COM_AV,TYPECOM_AP,COM_AP\n32,2016-01-01,COM,01001,COM,01002\n10,,COM,2A001,COM,\n", encoding="utf-8")
    got = {tuple(r) for r in readers.read_moves(spark, str(path)).collect()}
    assert got == {("32", "2016-01-01", "COM", "01001", "01002"), ("10", "", "COM", "2A001", "")}


def test_four_row_header(spark, tmp_path):
    path = tmp_path / "areas.csv"
    path.write_text(
        "Commune;Année;Base;Forêts - 311 - feuillus (en ha);Eau\ntexte;int;texte;num;num\n;;;ha;ha\nNUM_COM;ANNEE;base;CLC_311;CLC_512\n"
        "01001;2006;CLC 2006;10.5;0\n01001;2006;CLC 2006 révisée;12.5;x\n01001;2012;CLC 2012;3;1.5\n", encoding="utf-8")
    long, labels = readers.read_category_areas(spark, str(path))
    assert {(r.entity, r.vintage, r.category, r.area) for r in long.collect()} == {("01001", 2006, "CLC_311", 12.5), ("01001", 2012, "CLC_311", 3.0), ("01001", 2012, "CLC_512", 1.5)}
    assert labels["CLC_311"] == "311 - feuillus" and labels["CLC_512"] == "Eau"


def test_rings(spark, tmp_path):
    ring = [[2.00004, 45.0], [2.1, 45.0], [2.1, 45.1], [2.00004, 45.0]]
    features = [
        {"type": "Feature", "properties": {"code": "A", "nom": "x"}, "geometry": {"type": "Polygon", "coordinates": [ring, ring]}},
        {"type": "Feature", "properties": {"code": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring[:3]], [ring]]}},
        {"type": "Feature", "properties": {"code": "C"}, "geometry": None},
    ]
    whole, lines = tmp_path / "whole.json", tmp_path / "lines.json"
    whole.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    lines.write_text("\n".join(json.dumps(f) for f in features))
    for path, multi in ((whole, True), (lines, False)):
        rings = readers.read_rings(spark, str(path), multiline=multi)
        assert sorted(r.entity for r in rings.collect()) == ["A", "B", "B"]
        assert rings.first().lon[0] == pytest.approx(2.0) and len(rings.first().lat) == 4
        names = spark.createDataFrame([("A",), ("B",), ("C",)], "entity string")
        assert [r.entity for r in readers.without_ring(names, rings).collect()] == ["C"]


@pytest.mark.parametrize("indent", [None, 1])
def test_a_document_is_cut_into_ranges(spark, tmp_path, indent):
    """Ranges of 64 bytes begin inside strings, escapes and coordinates; every feature is read once, as json reads it."""
    names = ["plain", 'quo"te', "back\\slash", "{[", "}]", '\\"}', "end\\", "é ] , {", '"features": [', ""]
    features = [
        {"type": "Feature", "properties": {"code": f"{i}", "name": name, "more": {"deep": [{"a": name}, [name]]}},
         "geometry": None if i % 5 == 0 else {"type": "Polygon", "coordinates": [[[i, 1.5], [2, 3], [4, 5], [i, 1.5]]]}}
        for i, name in enumerate(names * 4)
    ]
    for n, doc in enumerate((
        {"type": "FeatureCollection", "features": features},
        {"crs": {"type": "name", "properties": {"name": "x"}}, "features": features[::-1], "bbox": [1, 2], "other": {"a": {"b": {}}}},
        {"features": []},
    )):
        (tmp_path / f"d{n}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=n == 0), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = documents.array_elements(spark, str(tmp_path)).collect()
        rings = readers.read_rings(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in sorted(found, key=lambda r: (r.path, r.number)):
        got.setdefault(r.path[-7:], []).append(json.loads(r.text))
    assert got == {"d0.json": features, "d1.json": features[::-1]}
    assert sorted(r.entity for r in rings) == sorted(2 * [f["properties"]["code"] for f in features if f["geometry"]])


def test_archives_written_and_read(spark, tmp_path):
    """Archives that Spark writes are read back whole; rows of an archive in two tasks or out of order stop the job."""
    rows = [(f"x_{a}.zip", i, line) for a in range(5) for i, line in enumerate(["Export", f"de la sélection : {a}", HEADER, *(event(j) for j in range(a))])]
    lines = spark.createDataFrame(rows, "archive string, line_no long, line string").repartition(7)
    target = str(tmp_path / "out")
    archives.write_archives(lines, target)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"x_{a}.zip" for a in range(5)]
    back = archives.archive_lines(spark, target)
    assert back.rdd.getNumPartitions() == 5
    meta = {r.source: (r.announced, r.header_line, r.rows) for r in readers.event_file_meta(back).collect()}
    assert meta == {f"x_{a}.zip": (a, 2, a) for a in range(5)}
    some = archives.archive_lines(spark, [target + "/x_1.zip", target + "/x_[34].zip"])
    assert {r.source for r in some.select("source").distinct().collect()} == {"x_1.zip", "x_3.zip", "x_4.zip"}
    assert readers.parse_event_lines(back).filter("name = 'Aja;ccio'").count() == 10
    scattered = lines.sortWithinPartitions("line_no").write.format("event_archives").mode("append")
    with pytest.raises(Exception, match="rows of an archive"):
        scattered.save(str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("*.zip"))
    with pytest.raises(Exception, match="no archives"):
        archives.archive_lines(spark, str(tmp_path / "bad" / "*.zip")).count()


def test_grids(spark):
    nan = float("nan")
    arrays = spark.createDataFrame([("2020-01-01", [1.0, nan, 3.0, nan], [5.0, nan, 6.0, nan]), ("2020-01-02", [2.0, nan, nan, nan], [7.0, nan, nan, nan])], "day string, fwi array<double>, ffmc array<double>")
    long = {(r.cell, r.day, r.fwi, r.ffmc) for r in readers.grid_to_long(arrays, ("fwi", "ffmc")).collect()}
    assert long == {(0, "2020-01-01", 1.0, 5.0), (2, "2020-01-01", 3.0, 6.0), (0, "2020-01-02", 2.0, 7.0)}
    cells = {(r.cell, r.lat, r.lon, r.is_sea) for r in readers.cell_table(arrays, "fwi", [46.0, 45.0], [1.0, 2.0]).collect()}
    assert cells == {(0, 46.0, 1.0, False), (1, 46.0, 2.0, True), (2, 45.0, 1.0, False), (3, 45.0, 2.0, True)}


def test_sinks_and_incremental_loads(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("entity"), (F.lit(2006) + F.col("id") % 4).cast("int").alias("year"), F.lit(1).alias("v"))
    path = str(tmp_path / "panel")
    incremental.rebuild_years(df, path)
    incremental.rebuild_years(df.filter("year = 2007").withColumn("v", F.lit(2)), path)
    back = spark.read.parquet(path)
    assert back.count() == 40 and back.filter("v = 2").count() == 10 == back.filter("year = 2007 AND v = 2").count()

    fill = str(tmp_path / "fill")
    incremental.backfill(spark, df.filter("year < 2008"), fill)
    incremental.backfill(spark, df, fill)
    incremental.backfill(spark, df, fill)
    assert spark.read.parquet(fill).count() == 40

    assert incremental.years_present(spark, fill) == [2006, 2007, 2008, 2009] and incremental.years_present(spark, fill + "-absent") == []

    table = str(tmp_path / "table")
    tables.append_by_name(df, table, ["entity", "v"])
    tables.append_by_name(df, table, ["entity", "v"])
    assert spark.read.parquet(table).count() == 80
    tables.replace_table(df, table)
    assert tables.read_contract(spark, table, ["entity"], ["year"]).columns == ["entity", "year"]
    with pytest.raises(ValueError, match="lacks"):
        tables.read_contract(spark, table, ["day"], ["v"])
    tables.write_report(df.groupBy("year").count(), str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).count() == 4


def test_years_from_file_names(spark, tmp_path):
    for name in ("measures_2006.nc", "measures_2019.nc", "notes.txt"):
        (tmp_path / name).write_text("x")
    assert {r.year for r in readers.years_available(spark, str(tmp_path)).collect()} == {2006, 2019}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables are absent")
def test_buckets_are_joined_without_a_shuffle(spark):
    from panelrisk.plans.source_queries import bucketed_join

    joined, names = bucketed_join(Roles(spark, FOLDER))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    # One file a bucket, so its rows need no sort either.
    assert joined.count() == spark.table(names[1]).count()
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def test_tables_are_written_with_zstd(spark, tmp_path):
    df = spark.range(10).selectExpr("id AS entity", "CAST(2006 AS INT) AS year")
    tables.append_by_name(df, str(tmp_path / "a"), ["entity", "year"])
    tables.replace_table(df, str(tmp_path / "r"), ["year"])
    incremental.rebuild_years(df, str(tmp_path / "y"))
    files = list(tmp_path.glob("**/*.parquet"))
    assert len({f.relative_to(tmp_path).parts[0] for f in files}) == 3
    for file in files:
        meta = pq.ParquetFile(file).metadata
        assert {meta.row_group(g).column(c).compression for g in range(meta.num_row_groups) for c in range(meta.num_columns)} <= {"ZSTD"}
