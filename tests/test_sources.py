"""Readers and writers on hand-written files, the delivery table, reports, the stream."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tallymap.functions import text
from tallymap.operators import generalise as gen
from tallymap.operators import stats
from tallymap.plans import export, extract, load, queries
from tallymap.plans.queries import QUERIES, deliveries
from tallymap.schema import MEASURE_TABLE, TEXT_ATTRIBUTES
from tallymap.session import new_path, shared_folder
from tallymap.sources import deliveries as dl
from tallymap.sources import dumps, exports, feed
from tallymap.streaming import pages as stream
from tallymap.streaming.pages import stream_feature_pages

DUMP = """SET default_with_oids = false;

COPY public.t (projet, categorie, mo, communes, procedure, date_decision, classe, type, cat, sscat, duree, si_metier, numero_dossier, st_centroid) FROM stdin;
{row1}
{row2}
\\.

GRANT SELECT ON TABLE t TO someone;
"""


def hex_point(x, y, srid=None):
    head = struct.pack("<BI", 1, 1) if srid is None else struct.pack("<BII", 1, 0x20000001, srid)
    return (head + struct.pack("<dd", x, y)).hex().upper()


def test_copy_dump(spark, tmp_path):
    first = ["tab\\there", "a\\\\nb", "\\N", '{"A B",NULL}', "", "2012-03-02", *["\\N"] * 7, "01010000005DDC4AAD7BAE22415380ECDA8E475A41"]
    second = ["x", *["\\N"] * 13]
    path = tmp_path / "dump.sql"
    path.write_text(DUMP.format(row1="\t".join(first), row2="\t".join(second)))
    rows = dumps.dated(dumps.read_copy_dump(spark, str(path))).orderBy("projet").collect()
    assert [r["projet"] for r in rows] == ["tab\there", "x"]
    r = rows[0]
    assert (r["categorie"], r["mo"], r["communes"], r["procedure"]) == ("a\\nb", None, '{"A B",NULL}', "")
    assert str(r["date_decision"]) == "2012-03-02"
    p = dumps.dated(dumps.read_copy_dump(spark, str(path))).select(dumps.decode_point(F.col("st_centroid")).alias("p"))
    got = {tuple(x["p"]) if x["p"] else None for x in p.collect()}
    assert got == {(612157.8384617675, struct.unpack("<d", bytes.fromhex("5380ECDA8E475A41"))[0], None), None}


def test_dump_there_and_back(spark, tmp_path):
    row = {c: None for c in dumps.DUMP_COLUMNS} | {"projet": "a\tb\\c\nd\\n", "mo": "\\N?", "communes": ""}
    schema = ", ".join(f"{c} string" for c in dumps.DUMP_COLUMNS)
    dumps.write_copy_dump(spark.createDataFrame([row], schema), str(tmp_path / "d"))
    assert dumps.read_copy_dump(spark, str(tmp_path / "d")).first().asDict() == row


VALUES = [0.0, 1.0, -1.0, 0.1, -123.456, 6889019.42, 1e-300, 1.7e308, 2.0**52 + 1, 3.0 - 2**-51, 5e-324]


@pytest.mark.parametrize("srid", [None, 2154])
def test_points_of_all_sizes(spark, srid):
    rows = [(x, hex_point(x, -x, srid)) for x in VALUES]
    df = spark.createDataFrame(rows, "x double, wkb string").select("x", dumps.decode_point(F.col("wkb")).alias("p"))
    for r in df.collect():
        assert (r["p"]["x"], r["p"]["y"], r["p"]["srid"]) == (r["x"], -r["x"], srid)


def test_encode_point(spark):
    rows = [(x, y) for x in VALUES[:-1] for y in VALUES[:-1]]
    df = spark.createDataFrame(rows, "x double, y double").select("x", "y", dumps.encode_point(F.col("x"), F.col("y")).alias("w"))
    assert all(r["w"] == hex_point(r["x"], r["y"]) for r in df.collect())


def test_other_wkb_is_null(spark):
    df = spark.createDataFrame([("0102000000",), (None,), ("",)], "w string")
    assert [r[0] for r in df.select(dumps.decode_point(F.col("w"))).collect()] == [None] * 3


# ---- feed -------------------------------------------------------------------------------


def page(total, start, projects):
    features = [
        {"type": "Feature", "properties": {"projet": p, "communes": "A+B", "type_mesure": "t"}, "geometry": {"type": "Point", "coordinates": [0, 0]}}
        for p in projects
    ]
    return json.dumps({"totalFeatures": total, "startIndex": start, "features": features})


def test_pages_one_document_per_file(spark, tmp_path):
    lines, points = tmp_path / "layer=emprises_lineaires", tmp_path / "layer=emprises_ponctuelles"
    for d in (lines, points):
        d.mkdir()
    (points / "a.json").write_text(page(1, 0, ["p5"]))
    (lines / "b.json").write_text(page(4, 0, ["p1", "p2"]).replace("{", "{\n", 1))
    (lines / "a.json").write_text(page(4, 2, ["p3", "p4"]))
    pages = feed.read_pages(spark, str(tmp_path), one_document_per_file=True)
    got = {r["num"]: r["projet"] for r in feed.page_features(pages).collect()}
    assert got == {i: f"p{i}" for i in range(1, 6)}
    audit = {r["layer"]: r for r in feed.audit_pages(pages, page_size=2).collect()}
    assert audit["emprises_lineaires"]["complete"] and audit["emprises_lineaires"]["pages"] == 2


def test_missing_page_is_found(spark, tmp_path):
    d = tmp_path / "layer=emprises_commune"
    d.mkdir()
    (d / "a.json").write_text(page(3, 0, ["p1", "p2"]))
    r = feed.audit_pages(feed.read_pages(spark, str(tmp_path)), page_size=2).first()
    assert (r["announced"], r["features"], r["pages_needed"], r["pages"], r["complete"]) == (3, 2, 2, 1, False)


def test_layer_of_exactly_two_pages_ends_with_an_empty_one(spark):
    path = new_path(spark, "two-pages")
    columns = [F.lit(None).cast("string").alias(c) for c in feed.PROPERTIES]
    rows = spark.range(2000).select(F.lit("emprises_commune").alias("layer"), F.col("id").alias("mesure_id"), *columns, F.lit(None).cast("string").alias("geometry"))
    feed.write_pages(rows, path, ["mesure_id"])
    pages = feed.read_pages(spark, path)
    r = feed.audit_pages(pages).first()
    assert (r["pages"], r["empty_pages"], r["pages_needed"], r["complete"]) == (2, 1, 2, True)
    numbers = feed.page_features(pages).agg(F.min(F.col("num") - F.col("mesure_id")), F.max(F.col("num") - F.col("mesure_id"))).first()
    assert tuple(numbers) == (1, 1)


def test_web_mercator_feed(spark):
    columns = [F.lit(None).cast("string").alias(c) for c in feed.PROPERTIES]
    rows = spark.range(1).select(
        F.lit(1).cast("long").alias("num"), F.lit(None).cast("long").alias("mesure_id"), *columns,
        F.lit('{"type":"Point","coordinates":[111319.49079327358,6446275.841017159]}').alias("geometry"),
    )
    r = load.load_feed(rows, "igngp", "20190227", "direct").first()
    assert (r["bbox"]["xmin"], r["bbox"]["ymin"]) == pytest.approx((1.0, 50.0), abs=1e-6)
    assert (r["communes"], r["si_metier"], r["repair_case"]) == ([None], "{NULL}", "webmercator")


def test_stream_takes_a_repeated_page_once_and_goes_on(spark, tmp_path):
    path, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    layer = tmp_path / "in" / "layer=emprises_commune"
    layer.mkdir(parents=True)
    (layer / "1.json").write_text(page(4, 0, ["p1", "p2"]))
    (layer / "2.json").write_text(page(4, 0, ["p1", "p2"]))
    stream_feature_pages(spark, path, target, progress, files_per_trigger=1).awaitTermination()
    assert spark.read.parquet(target).count() == 2
    (layer / "3.json").write_text(page(4, 2, ["p3", "p4"]))
    (layer / "4.json").write_text(page(4, 0, ["p1", "p2"]))
    stream_feature_pages(spark, path, target, progress, files_per_trigger=1).awaitTermination()
    assert sorted(r["projet"] for r in spark.read.parquet(target).collect()) == ["p1", "p2", "p3", "p4"]
    # begun anew onto the same target: nothing is added, nothing replaced
    stream_feature_pages(spark, path, target, str(tmp_path / "anew"), files_per_trigger=2).awaitTermination()
    assert sorted(r["projet"] for r in spark.read.parquet(target).collect()) == ["p1", "p2", "p3", "p4"]


def test_streamed_features_are_written_packed(spark, tmp_path):
    layer = tmp_path / "in" / "layer=emprises_commune"
    layer.mkdir(parents=True)
    (layer / "1.json").write_text(page(2, 0, ["p1", "p2"]))
    target = str(tmp_path / "out")
    stream_feature_pages(spark, str(tmp_path / "in"), target, str(tmp_path / "progress")).awaitTermination()
    names = [r[0] for r in spark.read.parquet(target).select(F.input_file_name()).distinct().collect()]
    assert names and all(n.endswith(".zstd.parquet") for n in names)


def test_a_batch_reads_its_own_parts_of_the_ledger(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    for k in range(8):
        rows = [(f"{i:02x}{k}", f"q-{k}", f"{i:02x}") for i in range(0, 256, 16)]
        spark.createDataFrame(rows, "page_md5 string, batch string, prefix string").coalesce(1).write.mode("append").partitionBy("prefix").parquet(ledger)
    batch = spark.createDataFrame([("103",), ("zz",)], "page_md5 string")
    seen = stream.seen_pages(batch, ledger, "q-5")
    assert sorted(r["page_md5"] for r in seen.collect()) == [f"10{k}" for k in range(8) if k != 5]
    assert len(seen.select(F.input_file_name()).distinct().collect()) == 7
    assert "PartitionFilters: [prefix" in seen._jdf.queryExecution().toString()


# ---- delivery table ---------------------------------------------------------------------


def test_table_names(spark):
    names = spark.createDataFrame([("mcecpii20190227direct",), ("mceigngp20190226commune",), ("other",)], "n string")
    got = [tuple(r) for r in names.select(*dl.read_table_name(F.col("n"))).collect()]
    assert got == [("cpii", "20190227", "direct"), ("igngp", "20190226", "commune"), (None, None, "commune")]


def test_clustered_table_holds_the_same_rows(spark, sf_dir):
    table, root = deliveries(spark, sf_dir), new_path(spark, "clustered")
    dl.cluster_deliveries(table, root)
    assert dl.read_deliveries(spark, root).exceptAll(table).count() == 0
    assert dl.read_deliveries(spark, root).count() == table.count()


def test_load_numbers_rows_without_id(spark):
    columns = [F.lit("0").alias(c) if c == "cat" else F.lit(None).cast("string").alias(c) for c in load.TEXT_ATTRIBUTES]
    rows = spark.range(5).select(F.when(F.col("id") == 3, 77).cast("long").alias("mesure_id"), "id", *columns, F.lit(None).cast("string").alias("geometry"))
    got = load.load_table(rows, "cpii", "20190227", "direct", order_by=["id"]).orderBy("num").collect()
    assert [r["num"] for r in got] == [1, 2, 3, 5, 77]
    # Blank text is stored as null, but counts in the digest.
    assert {r["cat"] for r in got} == {None}
    import hashlib

    assert got[0]["md5"] == hashlib.md5("////////0///{}/{}/".encode()).hexdigest()


def test_shared_folder_is_the_one_of_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_path(spark, "x") != new_path(spark, "x")


def test_geojson_document(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"properties": {"mesure_id": 4, "projet": "p"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc, indent=1))
    r = load.with_geometry(exports.read_geojson(spark, str(tmp_path), whole_document=True)).first()
    assert (r["mesure_id"], r["projet"], r["geom"]["type"]) == (4, "p", "Point")


def test_exported_features_are_geojson(spark, sf_dir):
    table = deliveries(spark, sf_dir)
    rows = export.export_map_features(dl.one_delivery(table, "cpii", "20190227", "direct"), zoom=9, dissolve=True)
    for r in rows.select("feature").limit(300).collect():
        feature = json.loads(r["feature"])
        assert feature["geometry"]["type"] in ("Point", "Polygon", "LineString", "MultiPoint", "MultiLineString", "MultiPolygon")
        assert feature["properties"]["agg"].startswith("agg_")


def test_export_limit_keeps_measures_whole(spark, sf_dir):
    rows = dl.one_delivery(deliveries(spark, sf_dir), "cpii", "20190227", "direct")
    limited = export.export_map_features(rows, zoom=8, limit=50)
    measures = limited.select("num", "md5", "geom_md5").distinct().count()
    assert 50 <= limited.count() and measures <= 50


def test_single_measure(spark, sf_dir):
    rows = dl.one_delivery(deliveries(spark, sf_dir), "cpii", "20190227", "direct").where("geom is not null")
    num = rows.agg(F.max("num")).first()[0]
    feature = json.loads(export.export_measure(rows, num).first()["feature"])
    assert feature["properties"]["num"] == num and "style" not in feature


def test_order_puts_unknown_first(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "area_ha double")
    assert [r[0] for r in stats.rank_by_area(df).collect()] == [None, 3.0, 1.0]


def test_limit_keeps_the_measure_that_reaches_it(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([3, 4, 5, 6])], "num int, n int")
    got = [r["num"] for r in gen.limit_features(df, "n", ["num"], 7).collect()]
    assert got == [0, 1]
    assert [r["num"] for r in gen.limit_features(df, "n", ["num"], 8).collect()] == [0, 1, 2]


# ---- collected names --------------------------------------------------------------------


def test_names_keep_nulls_and_repeats(spark):
    rows = [("k", "B"), ("k", None), ("k", "A"), ("k", None), ("k", "A"), ("n", None)]
    names = extract.names_with_counts(spark.createDataFrame(rows, "k string, c string"), ["k"], "c")
    got = {
        r["k"]: (r["d"], r["t"], r["n"])
        for r in names.select(
            "k", extract.distinct_literal(F.col("names")).alias("d"),
            extract.counted_text(F.col("names")).alias("t"), extract.name_total(F.col("names")).alias("n"),
        ).collect()
    }
    assert got == {"k": ("{A,B,NULL}", "A*2,B*1,NULL*2", 5), "n": ("{NULL}", "NULL*1", 1)}
    items = sorted((r["k"], r["item"] or "") for r in extract.repeated_items(names).collect())
    assert items == [("k", ""), ("k", ""), ("k", "A"), ("k", "A"), ("k", "B"), ("n", "")]


def test_crowded_group_is_whole(spark):
    rows = spark.range(30_000).select(F.lit("k").alias("k"), F.lit("A").alias("c"))
    names = extract.names_with_counts(rows, ["k"], "c")
    r = names.select(extract.counted_text(F.col("names")), extract.name_total(F.col("names"))).first()
    assert tuple(r) == ("A*30000", 30_000)
    assert extract.repeated_items(names).where("item = 'A'").count() == 30_000


def test_levels_may_share_a_label(spark, sf_dir):
    labels = [r["code"] for r in QUERIES["level_histogram"](spark, sf_dir).collect()]
    assert sorted(labels) == ["Classe", "Type", "sous-categorie", "sous-categorie"]
    assert text.UNKNOWN_DURATION.startswith("Dur")


def test_repeated_links_and_dossiers_count_as_often_as_they_stand(spark, sf_dir):
    """Every link and dossier doubled: four times the names, the same groups."""
    from tallymap.plans import sample_tables as st

    plain = st.business(spark, sf_dir)
    doubled = st.business(spark, sf_dir)
    for name in ("d_communes_mesures", "d_procedure_references"):
        doubled[name] = plain[name].unionByName(plain[name])

    def by_group(t):
        rows = extract.extract_by_commune(t).withColumn("has", F.col("numero_dossier").isNotNull())
        return rows.groupBy("has").agg(F.count(F.lit(1)).alias("g"), F.sum("n_communes").alias("n")).collect()

    one = {r["has"]: (r["g"], r["n"]) for r in by_group(plain)}
    two = {r["has"]: (r["g"], r["n"]) for r in by_group(doubled)}
    assert two[True] == (one[True][0], 4 * one[True][1])
    assert two[False] == (one[False][0], 2 * one[False][1])
    a, b = (extract.extract_with_footprint(t) for t in (plain, doubled))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


# ---- points of the last review ----------------------------------------------------------


def test_dump_with_other_columns_and_a_short_line(spark, tmp_path):
    path = tmp_path / "dump.sql"
    path.write_text("SET x = 1;\n\nCOPY public.t (a, \"b\", c) FROM stdin;\n1\t2\t3\n4\t5\n6\t\\N\tx\\ty\n\\.\n\nGRANT ALL ON t TO u;\n")
    assert list(dumps.dump_tables(spark, str(path)).values()) == [("a", "b", "c")]
    assert sorted(map(tuple, dumps.read_copy_dump(spark, str(path)).collect())) == [("1", "2", "3"), ("6", None, "x\ty")]
    assert [(r["value"], r["fields"]) for r in dumps.rejected_lines(spark, str(path)).collect()] == [("4\t5", 2)]


def test_pages_that_tell_nothing_about_themselves(spark, tmp_path):
    d = tmp_path / "layer=emprises_commune"
    d.mkdir()
    lines = [json.dumps({"features": json.loads(page(3, 0, [p]))["features"]}) for p in ("p1", "p2", "p3")]
    (d / "a.json").write_text("\n".join(lines))
    got = {r["num"]: r["projet"] for r in feed.page_features(feed.read_pages(spark, str(tmp_path))).collect()}
    assert got == {1: "p1", 2: "p2", 3: "p3"}


def _collections(spark, n):
    text_columns = {c: F.lit(None).cast("string") for c in feed.PROPERTIES if c != "type_mesure"}
    geometry = (
        '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[400000,6500000]},'
        '{"type":"Point","coordinates":[400010,6500000]},{"type":"LineString","coordinates":[[400000,6500000],[400100,6500100]]}]}'
    )
    rows = spark.range(1, n + 1).select(F.col("id").alias("mesure_id"), F.lit(geometry).alias("geometry"))
    return load.load_table(rows.withColumns(text_columns).withColumn("type", F.lit("t")), "cpii", "20190227", "direct")


def test_limited_export_has_all_members_of_a_measure(spark):
    shown = export.export_map_features(_collections(spark, 3), zoom=-1, dissolve=True, limit=4).collect()
    assert sorted(r["num"] for r in shown) == [1, 1, 1, 2, 2, 2]
    assert {json.loads(r["feature"])["properties"]["nbreOfPos"] for r in shown} == {4}


def test_large_limits_come_before_numbering(spark):
    rows = _collections(spark, 30)
    plan = export.styled_fragments(rows, -1, limit=5000)._jdf.queryExecution().analyzed().toString().splitlines()
    numbered = max(i for i, line in enumerate(plan) if "row_number" in line and "Window [" in line)
    assert any("GlobalLimit 5000" in line for line in plan[numbered:])
    few = export.export_map_features(rows, zoom=-1, limit=4).select("num").distinct().collect()
    assert sorted(r["num"] for r in few) == sorted(r["num"] for r in rows.select("num").distinct().orderBy("num").limit(len(few)).collect())


def test_footprints_are_repaired_and_in_lonlat(spark, sf_dir):
    from tallymap.plans import sample_tables as st

    tables = st.business(spark, sf_dir)
    shapes = [json.loads(r["footprint"]) for r in extract.extract_with_footprint(tables).select("footprint").distinct().collect()]
    assert {s["type"] for s in shapes} == {"Point", "Polygon"}
    for s in shapes:
        ring = s["coordinates"][0] if s["type"] == "Polygon" else [s["coordinates"]]
        assert all(-6 < x < 10 and 41 < y < 52 for x, y in ring)
        assert s["type"] == "Point" or (len(ring) == 5 and ring[0] == ring[-1])


def test_equal_areas_spread_over_ranges(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 5 < 3, 0.0).otherwise(F.rand(3) * 100).alias("area_ha"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = stats.rank_by_area(rows.repartition(16))
        counts = ranked.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) > 2 and max(counts) <= 3 * sum(counts) / len(counts)


def test_box_without_coordinates_is_null(spark):
    from tallymap.functions import geometry as g

    texts = ['{"type":"Point","coordinates":[]}', '{"type":"Point","coordinates":[1,2]}', '{"type":"MultiPoint","coordinates":[]}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(g.geometry_box(g.parse_geojson(F.col("t"))).alias("b")).collect()
    assert [r["b"] and tuple(r["b"]) for r in rows] == [None, (1.0, 2.0, 1.0, 2.0), None]


def test_blocks_of_a_dump(spark, tmp_path):
    """Two tables over several files and splits; what stands outside the blocks is left out, also if it looks like a row."""
    lines, expected = ["SET x = 1;", "no\ttable\tyet"], {"t": [], "u": []}
    for part in range(6):
        table = "tu"[part % 2]
        lines += ["", f"COPY {table} (a, b, \"c\") FROM stdin;"]
        for i in range(300):
            row = (f"{table}{part}", str(i), "COPY u (a, b, c) FROM stdin;" if i % 50 == 0 else "x" * 30)
            lines.append("\t".join(row if i % 50 else (row[2], row[1], row[0])))
            expected[table].append(row if i % 50 else (row[2], row[1], row[0]))
        lines += ["COPY u (a, b, c) FROM stdin;", "only\ttwo", "none"]
        lines += ["\\.", "outside\t1\t2", "COPYRIGHT\t1\t2"]
    whole = tmp_path / "whole"
    whole.mkdir()
    for k in range(5):  # a block goes on in the next file
        cut = slice(k * len(lines) // 5, (k + 1) * len(lines) // 5)
        (whole / f"part{k}.sql").write_text("\n".join(lines[cut]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for table in "tu":
            got = sorted(map(tuple, dumps.read_copy_dump(spark, str(whole), table=table).collect()))
            assert got == sorted(expected[table])
            rejected = dumps.rejected_lines(spark, str(whole), table=table).collect()
            assert sorted(r["value"] for r in rejected) == sorted(["COPY u (a, b, c) FROM stdin;", "only\ttwo", "none"] * 3)
        assert dumps.dump_tables(spark, str(whole)) == {"t": ("a", "b", "c"), "u": ("a", "b", "c")}
        with pytest.raises(ValueError, match="several tables"):
            dumps.read_copy_dump(spark, str(whole))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_look_up_skips_row_groups(spark, tmp_path):
    """Rows lie by place, so a number may be anywhere; the filters tell where it isn't."""
    rows = spark.range(0, 200_000, 1, 4).select((F.col("id") * 7919 % 200_003).alias("num"), F.lit("x").alias("projet"))
    shape = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in MEASURE_TABLE.fields}
    shape |= {"num": F.col("num"), "projet": F.col("projet"), **{c: F.lit(v).alias(c) for c, v in (("source", "s"), ("delivery_date", "d"), ("georef", "direct"))}}
    dl.write_deliveries(rows.select(*shape.values()), str(tmp_path / "table"))
    table = dl.read_deliveries(spark, str(tmp_path / "table"))

    def read(num):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            found = dl.lookup_measure(table, num).select("num", "projet")
            n = len(found.collect())
            leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
            return n, leaf.metrics().apply("numOutputRows").value()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")

    hit, looked_at = read(7919 * 5 % 200_003)
    assert hit == 1 and 0 < looked_at <= 60_000  # one of the four files
    assert read(200_002 + 5)[0] == 0
    missing = set(range(200_003)) - {i * 7919 % 200_003 for i in range(200_000)}
    looks = [read(m) for m in missing]
    assert all(n == 0 for n, _ in looks) and sum(rows for _, rows in looks) <= 200_000 / 2  # of 600,000; filters may err


def test_a_query_loads_only_the_deliveries_it_reads(spark, sf_dir):
    own = f"{sf_dir}/."  # a folder that no other test has loaded from
    one = queries.direct_a(spark, own)
    root = queries._written[(spark.sparkContext.applicationId, own, "deliveries")]
    assert [r["table_name"] for r in dl.list_deliveries(dl.read_deliveries(spark, root)).collect()] == ["mcecpii20190227direct"]
    rows = one.count()
    assert dl.list_deliveries(deliveries(spark, own)).count() == 4
    assert rows > 0 and queries.direct_a(spark, own).count() == rows


def test_pages_may_be_compressed(spark):
    rows = [(f"emprises_{k}", i, *[f"t{i}"] * len(feed.PROPERTIES), None) for k in ("polygones", "lineaires") for i in range(25)]
    features = spark.createDataFrame(rows, f"layer string, mesure_id long, {', '.join(f'{n} string' for n in feed.PROPERTIES)}, geometry string")
    read = []
    for compression in ("none", "gzip"):
        path = new_path(spark, "compressed-pages")
        feed.write_pages(features, path, ["mesure_id"], page_size=10, compression=compression)
        names = {r[0].endswith(".gz") for r in spark.read.text(path).select(F.input_file_name()).distinct().collect()}
        assert names == {compression == "gzip"}
        read.append(sorted(map(tuple, feed.page_features(feed.read_pages(spark, path)).select("num", "layer", "mesure_id").collect())))
    assert read[0] == read[1] and len(read[0]) == 50


def test_a_load_makes_only_the_columns_that_are_read(spark, tmp_path, monkeypatch):
    own = [(1, "P1", None, 2.0), (2, None, "x", None)]
    rows = spark.createDataFrame(own, "num long, projet string, md5 string, area_m2 double")
    placed = rows.withColumns({"source": F.lit(queries.FIRST), "delivery_date": F.lit(queries.DATE), "georef": F.lit("direct")})
    whole = placed.withColumn("mesure_id", F.lit(None).cast("long"))
    monkeypatch.setitem(queries.LOADED, (queries.FIRST, "direct"), lambda spark, sf_dir: whole)
    some = ("num", "projet", "area_m2")
    got = queries.direct_a(spark, str(tmp_path), some)
    assert got.columns == [*some, *dl.PARTITION_COLUMNS]
    assert sorted(tuple(r)[:3] for r in got.collect()) == [(1, "P1", 2.0), (2, None, None)]
    files = spark.read.parquet(queries._once(spark, str(tmp_path), "deliveries-of-num-projet-area_m2", lambda path: None))
    assert set(files.columns) == set(got.columns)  # md5 isn't written


def test_geojson_is_written_packed_when_asked(spark, tmp_path):
    rows = spark.createDataFrame([('{"properties":{"mesure_id":1},"geometry":null}',)], "feature string")
    exports.write_geojson(rows, str(tmp_path / "packed"), compression="gzip")
    exports.write_geojson(rows, str(tmp_path / "plain"))
    assert list((tmp_path / "packed/features").glob("*.gz")) and not list((tmp_path / "plain/features").glob("*.gz"))
    assert [r["mesure_id"] for r in exports.read_geojson(spark, str(tmp_path / "packed/features")).collect()] == [1]


def test_large_dumps_have_more_files(spark, tmp_path, monkeypatch):
    """A file is sorted by one task, so files grow in number and not in size."""
    monkeypatch.setattr(dumps, "FILE_LINES", 100)
    rows = spark.range(600).select(F.col("id").cast("string").alias("k"), F.lit("x\ty").alias("v"))
    path = str(tmp_path / "dump")
    dumps.write_dump({"a": rows, "b": rows.where("id < 50").select("k", F.lit(None).cast("string").alias("w"))}, path, files=2)
    lines = spark.read.text(path).groupBy(F.col("_metadata.file_name")).count()
    assert lines.count() >= 6 and lines.agg(F.max("count")).first()[0] < 250
    assert sorted(map(tuple, dumps.read_copy_dump(spark, path, table="a").collect())) == sorted((str(i), "x\ty") for i in range(600))
    assert dumps.read_copy_dump(spark, path, table="b").count() == 50


def test_hex_of_points_is_read_once(spark, capsys):
    """The hex text of a coordinate goes into many pieces; it is made once for all of them."""
    df = spark.createDataFrame([(hex_point(-1.5, 2.0**-1040, 4326),), (hex_point(0.0, -1e300),), (None,)], "w string")
    decoded = df.select(dumps.decode_point(F.col("w")).alias("p"))
    decoded.explain(True)
    assert capsys.readouterr().out.split("== Analyzed")[1].split("== Optimized")[0].count("upper(") == 1
    assert [tuple(r[0]) if r[0] else None for r in decoded.collect()] == [(-1.5, 2.0**-1040, 4326), (0.0, -1e300, None), None]
    numbers = spark.createDataFrame([(1.0, -0.75), (0.0, 123456.5), (2.0**40, -3.0)], "x double, y double")
    encoded = numbers.select("x", "y", dumps.encode_point(F.col("x"), F.col("y")).alias("w"))
    assert [r["w"] for r in encoded.collect()] == [hex_point(x, y) for x, y in ((1.0, -0.75), (0.0, 123456.5), (2.0**40, -3.0))]


def test_replaced_delivery_is_loaded_once(spark, monkeypatch):
    """Both contents of the first write come from one load, and only audited columns are written of broken and repeated shapes."""
    written = []
    real = dl.write_deliveries
    monkeypatch.setattr(dl, "write_deliveries", lambda df, root: (written.append(df), real(df, root)))
    rows = QUERIES["load_overwrite"](spark, "/root/testdata/sf0.001")
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0 and plan.count("Generate") == 1
    own = dict(rows.groupBy("source").count().collect())
    loaded = dict(deliveries(spark, "/root/testdata/sf0.001").where("georef = 'direct'").groupBy("source").count().collect())
    assert own == loaded
    assert set(queries.broken_shapes(spark, "/root/testdata/sf0.001").columns) == set(queries.BROKEN)
    assert not {"signature", "n_points", "geom_type"} & set(queries.audited(spark, "/root/testdata/sf0.001").columns)


def test_what_is_shown_without_elements_needs_no_written_parts(spark, monkeypatch):
    shapes = [
        None, "no shape", '{"type":"Polygon","coordinates":[]}', '{"type":"GeometryCollection","geometries":[]}',
        '{"type":"Point","coordinates":[400000,6500000]}', '{"type":"LineString","coordinates":[[400000,6500000],[430000,6520000]]}',
        '{"type":"Polygon","coordinates":[[[400000,6500000],[402000,6500000],[402000,6501000],[400000,6500000]]]}',
        '{"type":"MultiPoint","coordinates":[[400000,6500000],[430000,6520000]]}',
    ]
    rows = spark.createDataFrame(
        [(i if i else None, *["2019-02-27" if c == "date_decision" else "{a}" for c in TEXT_ATTRIBUTES], t) for i, t in enumerate(shapes * 2)],
        f"mesure_id long, {', '.join(f'{c} string' for c in TEXT_ATTRIBUTES)}, geometry string",
    )
    monkeypatch.setattr(queries.st, "sample", lambda *_: rows)
    found = []
    for folder, whole in (("narrow rows", False), ("whole rows", True)):
        if whole:
            queries.wide(spark, folder)
        found.append([sorted(map(str, q(spark, folder).collect())) for q in (queries.generalise_gate, queries.generalise_single)])
        names = {n: path for (app, of, n), path in queries._written.items() if of == folder and app == spark.sparkContext.applicationId}
        assert list(names) == ["wide"] if whole else "wide" not in names
        assert ("geom" in spark.read.parquet(*names.values()).columns) == whole
    assert found[0] == found[1] and len(found[0][0]) == 7 * len(shapes) * 2 and found[0][1]
