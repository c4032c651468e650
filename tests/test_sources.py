"""Files, embedded data, JSON helpers and streams."""

import json

from pyspark.sql import functions as F

from parcelflow.functions import documents
from parcelflow.operators import changes as CH
from parcelflow.operators import joins, outbox, upsert
from parcelflow.sources import domain, files, packages
from parcelflow.streaming import changes as S


def test_positional_and_fixed_width(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1|x||\n2|y|z|\n\n3\n")
    got = files.read_positional(spark, f"{tmp_path}/a.txt", ["k", "a", "b"]).collect()
    assert sorted(map(tuple, got)) == [("1", "x", None), ("2", "y", "z"), ("3", None, None)]
    (tmp_path / "b.txt").write_text("00012abc  \nshort\n00x12 de  \n")
    got = files.read_fixed_width(spark, f"{tmp_path}/b.txt", [files.Field("n", 0, 5, "int"), files.Field("s", 5, 10)], 10).collect()
    assert sorted(map(tuple, got), key=str) == [(12, "abc"), (None, "de")]


def test_upload(spark, tmp_path):
    (tmp_path / "u.csv").write_text('ROL;Monto;other\n"1-2";"1,5;""x""";z\n;3;\n')
    rows, skipped = files.read_upload(spark, f"{tmp_path}/u.csv", {"rol": "roll", "monto": "amount"}, "roll")
    assert [tuple(r) for r in rows.collect()] == [("1-2", '1,5;"x"')] and skipped.count() == 1
    assert files.delimiter_of("a,b;c") == ";" and files.delimiter_of("a,b,c") == ","


def test_features(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 1], [0, 0]]
    poly = {"properties": {"rol": "1"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    many = {"properties": {"rol": "2"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": [poly, many]}))
    got = files.read_features(spark, f"{tmp_path}/f.json", "rol:string").collect()
    assert sorted(r["rol"] for r in got) == ["1", "2", "2"] and got[0]["ring"][1].asDict() == {"lat": 0.0, "lon": 2.0}
    p = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], "k int, lat double, lon double")
    r = files.as_features(p, "lat", "lon", 1).first()
    assert r["truncated"] and json.loads(r["collection"])["features"][0]["geometry"]["coordinates"] == [3.0, 2.0]


def test_every_collection_of_a_file_is_read(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 1], [0, 0]]
    page = lambda i: {"type": "FeatureCollection", "features": [{"properties": {"rol": f"{k} }}\n{{"}, "geometry": {"type": "Polygon", "coordinates": [ring]}} for k in (i, i + 1)]}
    (tmp_path / "lines").write_text("".join(json.dumps(page(i)) + "\n" for i in (0, 2, 4)))
    (tmp_path / "pretty").write_text("\n".join(json.dumps(page(i), indent=1) for i in (6, 8)))
    rols = lambda df: sorted(int(r["rol"].split()[0]) for r in df.collect())
    for read in (files.read_features, files.read_shapes):
        assert rols(read(spark, str(tmp_path), "rol:string")) == list(range(10))
        assert rols(read(spark, f"{tmp_path}/lines", "rol:string", lines=True)) == list(range(6))


def test_embedded_json(spark):
    page = 'x <script>state = {"a": {"b": "}\\"{"}, "c": [1]}; other = {}</script>'
    df = spark.createDataFrame([(page,), ("none",), ("state = {",), (None,)], "h string")
    got = [r["x"] for r in df.select(files.embedded_json(F.col("h"), "state = ").alias("x")).collect()]
    assert got == ['{"a": {"b": "}\\"{"}, "c": [1]}', None, None, None]


def test_json_helpers(spark):
    df = spark.sql("""select map('a', '1', 'b', '2', 'id', '9') o, map('a', '1', 'b', '3', 'id', '9', 'c', '4') n, '{"a":null,"b":[],"c":"x"}' j, '[{"k":1},{"k":5}]' l""")
    r = df.select(documents.changed_fields(F.col("o"), F.col("n"), ["id"], ["c"]).alias("d"), documents.without_empty(F.col("j")).alias("p"), documents.kept_elements(F.col("l"), "struct<k:int>", lambda x: x["k"] > 2).alias("k")).first()
    assert r["d"] == {"b": "3", "id": "9"} and r["p"] == '{"c":"x"}' and r["k"] == '[{"k":5}]'
    a, b = (spark.range(1).select(F.lit(1).alias("y"), F.lit(None).alias("x")), spark.range(1).select(F.lit(None).alias("x"), F.lit(1).alias("y")))
    assert a.select(documents.content_hash(a.columns)).first() == b.select(documents.content_hash(b.columns)).first()


def test_replace_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    upsert.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, ["p"])
    upsert.replace_partitions(spark.createDataFrame([(3, "a")], "v int, p string"), path, ["p"])
    assert sorted((r["v"], r["p"]) for r in spark.read.parquet(path).collect()) == [(2, "b"), (3, "a")]


def test_streams_agree_with_batches(spark, sf_dir, tmp_path):
    rows = domain.changes(spark, sf_dir).select("listing_id", "event_id", "ts", "price", "agency").where("listing_id < 15")
    day = F.dayofmonth("ts")
    for i, (low, high) in enumerate(((0, 10), (10, 20), (20, 32))):
        rows.where((day >= low) & (day < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = S.version_stream(spark, f"{tmp_path}/in", 100)
    q = S.change_stream(stream).writeStream.format("memory").queryName("kinds").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = CH.with_change_kind(rows, "listing_id", ["ts", "event_id"]).select("listing_id", "event_id", "kind")
    assert sorted(map(str, spark.table("kinds").collect())) == sorted(map(str, want.collect()))
    got = []
    S.outbox(S.version_stream(spark, f"{tmp_path}/in", 100), lambda df, n: got.extend(df.collect()), f"{tmp_path}/c2").awaitTermination(120)
    assert {r["listing_id"]: r["event_id"] for r in got} == dict(rows.groupBy("listing_id").agg(F.max_by("event_id", F.struct("ts", "event_id"))).collect())


def test_shapes_in_binary(spark, tmp_path):
    import numpy as np

    corners = lambda order, *c: np.array(c, f"{order}f8").tobytes()
    count = lambda order, *n: np.array(n, f"{order}u4").tobytes()
    # A square with a hole, the same square twice with heights and high bytes first, and a point.
    ring = (0.0, 1.0, 2.0, 1.0, 2.0, 3.0, 0.0, 1.0)
    holed = b"\1" + count("<", 3, 2, 4) + corners("<", *ring) + count("<", 4) + corners("<", *ring)
    high = b"\0" + count(">", 1003, 1, 4) + corners(">", *(x for i in range(4) for x in (*ring[2 * i : 2 * i + 2], 9.0)))
    many = b"\0" + count(">", 1006, 2) + high + high
    marked = b"\1" + count("<", 0x20000003, 4326, 1, 4) + corners("<", *ring)
    point = b"\1" + count("<", 1) + corners("<", 1.0, 2.0)
    rows = [(1, holed, 1.5), (2, many, float("nan")), (3, marked, None), (4, point, 1.0), (5, holed[:40], 1.0), (6, None, 1.0), (7, b"", 1.0)]
    spark.createDataFrame(rows, "k int, geometry binary, area double").write.parquet(f"{tmp_path}/g")
    back = packages.read_geo_parquet(spark, f"{tmp_path}/g", ["k", "area", "absent"])
    got = {r["k"]: r for r in back.withColumn("rings", packages.wkb_rings(F.col("geometry"))).collect()}
    assert got[1]["geometry_hex"] == holed.hex() and got[2]["area"] is None and got[1]["area"] == 1.5 and got[1]["absent"] is None
    want = [(1.0, 0.0), (1.0, 2.0), (3.0, 2.0), (1.0, 0.0)]
    assert [[tuple(c) for c in r] for r in got[1]["rings"]] == [want] and [[tuple(c) for c in r] for r in got[2]["rings"]] == [want, want]
    assert [[tuple(c) for c in r] for r in got[3]["rings"]] == [want] and got[4]["rings"] == []
    assert got[5]["rings"] is None and got[6]["rings"] is None and got[6]["geometry_hex"] is None and got[7]["rings"] is None
    rings = spark.createDataFrame([(1, [{"lat": y, "lon": x} for y, x in want]), (2, None)], "k int, ring array<struct<lat:double,lon:double>>")
    again = rings.select("k", packages.wkb_polygon(F.col("ring")).alias("b")).collect()
    assert {r["k"]: r["b"] and bytes(r["b"]) for r in again} == {1: b"\1" + count("<", 3, 1, 4) + corners("<", *ring), 2: None}


def test_zipped(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.txt", "1")
        z.writestr("y/", "")
        z.writestr("y/one.txt", "2")
        z.writestr("two.txt", "")
    (tmp_path / "b.zip").write_bytes(b"none")
    got = packages.read_zipped(spark, f"{tmp_path}/*.zip").collect()
    assert sorted((r["name"], bytes(r["content"])) for r in got if not r["error"]) == [("one.txt", b"2"), ("two.txt", b"")]
    assert [(r["path"].rsplit("/", 1)[-1], r["name"], r["content"]) for r in got if r["error"]] == [("b.zip", None, None)]
    assert packages.unzipped(spark.createDataFrame([("p", None)], "path string, content binary")).count() == 0


def test_first_match(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "z", "x"), (3, None, "y"), (4, "b", None)], "k int, p string, q string")
    right = spark.createDataFrame([(7, "a", "x"), (5, "a", None), (6, None, "x")], "id int, p string, q string")
    got = joins.first_match(left, right, "id", [(F.col("p"), F.col("p")), (F.col("q"), F.col("q"))], "found", "by")
    assert sorted(map(tuple, got.select("k", "found", "by").collect())) == [(1, 5, 1), (2, 6, 2), (3, None, None), (4, None, None)]


def test_bursts(spark):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, 0, at(10)), (1, 1, at(11)), (1, 2, at(12.5)), (1, 3, at(20)), (1, 4, at(59)), (1, 5, at(60.5)), (2, 6, at(59.5)), (2, 7, at(59.5)), (3, 8, None)]
    got = outbox.bursts(spark.createDataFrame(rows, "k int, e int, at timestamp"), "k", "at", F.col("e"))
    want = [(1, at(14.5), 3, 2), (1, at(22), 1, 3), (1, at(60), 1, 4), (1, at(62.5), 1, 5), (2, at(60), 2, 7)]
    assert sorted(map(tuple, got.collect())) == want


def test_a_page_is_made_once_for_its_data(spark):
    page = F.concat(F.lit("<p>state = {71625"), F.col("id").cast("string"), F.lit("}"))
    plan = spark.range(1).select(files.embedded_json(page, "state").alias("j"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("71625") == 1


def test_archives_of_a_small_table_are_packed_by_all_tasks(spark, sf_dir):
    from parcelflow import plans

    plan = plans.queries()["SRC-08_zipped_parcels"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(s_suppkey#" in plan[plan.index("EvalPython") :]


def test_small_files_leave_an_archive_together(spark):
    """Many files of one archive come out whole, with those that cannot be read, and not as a batch each."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for i in range(2500):
            archive.writestr(f"d/{i}.txt", str(i))
    rows = packages.unzipped(spark.createDataFrame([("a", bytearray(out.getvalue())), ("b", bytearray(b"no")), ("c", None)], "path string, content binary"))
    got = {(r["path"], r["name"]): (r["content"] and bytes(r["content"]), r["error"] is None) for r in rows.collect()}
    assert got.pop(("b", None)) == (None, False)
    assert got == {("a", f"{i}.txt"): (str(i).encode(), True) for i in range(2500)}
    assert packages.MOST_HELD < 2500
