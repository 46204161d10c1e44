import json

import pytest
from pyspark.sql import functions as F

from labelmatch.operators import catalog, ingest
from labelmatch.sources import files
from labelmatch.operators.features import split_sections
from labelmatch.operators.lexicon import SECTION_HEADINGS, SECTION_LABEL, SECTIONS
from labelmatch.operators.requests import merge_contexts, parse_context, with_grapes
from labelmatch.streaming import sessions

BOX = "image_id long, box_id long, width int, height int, x1 double, y1 double, x2 double, y2 double, conf double"


def test_best_box(spark):
    rows = [
        (1, 1, 800, 600, 350, 200, 450, 400, 0.5), (1, 2, 800, 600, 10, 200, 90, 400, 0.99),  # over the centre line beats a surer one
        (2, 1, 800, 600, 300, 10, 500, 100, 0.9), (2, 2, 800, 600, 300, 250, 500, 350, 0.4),  # nearest in height
        (3, 1, 800, 600, 300, 250, 500, 350, 0.4), (3, 2, 800, 600, 310, 260, 500, 350, 0.8),  # then the surest
        (4, 1, 800, 600, 300, 100, 350, 200, 0.9), (4, 2, 800, 600, 410, 100, 500, 200, 0.1),  # nearest edge
        (5, 1, 800, 600, 10, 100, 90, 200, 0.9),  # too far
    ]
    got = {r.image_id: r.box_id for r in ingest.best_box(spark.createDataFrame([(*r[:4], *map(float, r[4:])) for r in rows], BOX)).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2}
    flat = spark.createDataFrame([(1, 1, 800, 600, -5.0, 10.0, 900.0, 20.0, 1.0), (2, 1, 800, 600, 50.0, 50.0, 40.0, 60.0, 1.0)], BOX)
    assert [(r.cx1, r.cy1, r.cx2, r.cy2) for r in ingest.clamp_crop(flat).orderBy("image_id").collect()] == [(0, 10, 800, 20), (0, 0, 800, 600)]


def test_manifest_checks(spark):
    raw = spark.createDataFrame([(1, " A ", "m", "d", "a.jpg", "s"), (2, "B", "", "d", "../x.jpg", "s"), (3, "C", "m", "d", "/abs.jpg", None), (4, "D" * 301, "m", "d", "ok.jpg", "t")], "row_number int, name string, producer string, description string, image string, slug string")
    got = {r.row_number: r.errors for r in ingest.manifest_errors(ingest.coalesce_aliases(raw)).collect()}
    assert got == {1: ["slug is repeated"], 2: ["manufacturer is missing", "image is outside the batch", "slug is repeated"], 3: ["image is outside the batch"], 4: ["title is too long"]}
    assert ingest.first_error(ingest.manifest_errors(ingest.coalesce_aliases(raw))).first()[:] == (1, "slug is repeated")


def test_augmentation_rows(spark):
    rows = ingest.augmentation_plan(spark.createDataFrame([(1,), (2,)], "product_id long"))
    assert rows.count() == 232 and rows.dropDuplicates().count() == 232
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, rows.collect()))


def test_polygon_and_page(spark):
    p = lambda *xy: [{"x": float(a), "y": float(b)} for a, b in xy]
    rows = spark.createDataFrame([(1, 1, p((0, 0), (9, 0), (0, 9))), (1, 2, p((0, 0), (2, 0), (2, 2), (0, 2))), (1, 3, p((0, 0), (3, 0), (3, 3), (0, 3)))], "image_id long, polygon_id long, points array<struct<x:double,y:double>>")
    assert ingest.best_polygon(rows).first()[:] == (1, 3, 9.0)
    products = spark.createDataFrame([(i, i % 3, f"t{i}") for i in range(10)], "product_id long, created_at int, title string")
    page = catalog.list_page(products, 2, 1).collect()
    assert [(r.product_id, r.total) for r in page] == [(5, 10), (8, 10)]


def test_files(spark, tmp_path):
    (tmp_path / "feed.csv").write_text('﻿Название вина,Slug\n"Вино ""А"",\nдва",a\nБ,\n', encoding="utf-8")
    rows = files.read_catalog_csv(spark, str(tmp_path / "feed.csv")).collect()
    assert [(r[0], r[1]) for r in rows] == [('Вино "А",\nдва', "a"), ("Б", "")]
    (tmp_path / "m.json").write_text(json.dumps({"products": [{"title": "a"}, {"title": "b"}]}))
    assert files.read_manifest(spark, str(tmp_path / "m.json")).count() == 2
    (tmp_path / "empty.json").write_text(json.dumps([]))
    with pytest.raises(Exception):
        files.read_manifest(spark, str(tmp_path / "empty.json"))
    (tmp_path / "p.jsonl").write_text('{"query_id": "q1", "predicted_slug": "a", "latency_ms": 5}\n\nbroken\n{"query_id": "q2"}\n')
    assert sorted(r.query_id for r in files.read_predictions(spark, str(tmp_path / "p.jsonl")).collect()) == ["q1", "q2"]
    (tmp_path / "map.json").write_text(json.dumps({"cases": [{"query_id": "1", "image_path": "a.jpg", "expected_slug": "x"}, {"query_id": "2", "image_path": "b.jpg", "expected_slug": None}]}))
    (tmp_path / "l.tsv").write_text("image_path\texpected_slug\tstatus\talt_slugs\na.jpg\ty\tin_catalog\tz, w\nc.jpg\t\tunsure\t\n")
    got = {r.image_path: (r.kind, sorted(r.accepted)) for r in files.read_labels(spark, str(tmp_path / "map.json"), str(tmp_path / "l.tsv")).collect()}
    assert got == {"a.jpg": ("in", ["w", "y", "z"]), "b.jpg": ("out", []), "c.jpg": ("skip", [])}
    (tmp_path / "q.tsv").write_text("query_id\timage_path\nq1\ta.jpg\nq1\tb.jpg\n")
    with pytest.raises(ValueError):
        files.read_query_manifest(spark, str(tmp_path / "q.tsv"))
    out = spark.createDataFrame([("q1", "a\tb\nc", "")], "query_id string, image_path string, predicted_slug string")
    files.write_predictions(out, str(tmp_path / "pred"))
    assert spark.read.json(str(tmp_path / "pred")).where("predicted_slug is null").count() == 1
    files.write_report(out, str(tmp_path / "rep"))
    assert spark.read.csv(str(tmp_path / "rep"), sep="\t", header=True).first().image_path == "a b c"


def test_snapshot_vectors_and_images(spark, tmp_path):
    vectors = spark.createDataFrame([(1, "A", [1.0]), (2, "B", [2.0])], "product_id long, model string, embedding array<double>")
    files.write_vectors(vectors, str(tmp_path / "v"))
    assert files.read_vectors(spark, str(tmp_path / "v"), "A").count() == 1
    files.export_snapshot({"v": vectors}, str(tmp_path / "snap"))
    assert files.restore_snapshot(spark, str(tmp_path / "snap"))["v"].count() == 2
    vectors.limit(1).write.mode("overwrite").parquet(str(tmp_path / "snap/v"))
    with pytest.raises(ValueError):
        files.restore_snapshot(spark, str(tmp_path / "snap"))
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.jpg").write_bytes(b"abc")
    (tmp_path / "img/b.jpg").write_bytes(b"")
    (tmp_path / "img/c.txt").write_bytes(b"x")
    got = files.image_inventory(spark, str(tmp_path / "img")).collect()
    assert [r.sha256 for r in got] == ["ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]


def test_streamed_feedback_equals_the_batch(spark, tmp_path):
    lines = [{"ts": 1, "wine": "a", "liked": False}, {"ts": 2, "wine": "b", "liked": True}, {"ts": 3, "wine": "c", "liked": False}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, lines[:2])))
    (tmp_path / "in/2.json").write_text("\n".join(map(json.dumps, lines[2:])))
    stream = sessions.feedback_exclusions(files.stream_feedback(spark, str(tmp_path / "in")).withColumn("session", F.lit("s")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("excluded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = sessions.feedback_exclusions(files.read_feedback(spark, str(tmp_path / "in")).withColumn("session", F.lit("s")))
    assert [tuple(r) for r in spark.table("excluded").collect()] == [tuple(r) for r in batch.collect()] == [("s", ["a", "c"])]


def test_session_state_and_incremental_import(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"session_id": "s", "ts": 1, "wish": "color", "value": "red"}\n{"session_id": "s", "ts": 2, "wish": "body", "value": "light"}\n{"session_id": "t", "ts": 1, "wish": "reset", "value": null}')
    source = spark.readStream.schema("session_id string, ts bigint, wish string, value string").json(str(tmp_path / "in"))
    run = sessions.session_wishes(source).writeStream.outputMode("update").format("memory").queryName("wishes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.session_id: json.loads(r.wishes) for r in spark.table("wishes").collect()} == {"s": {"body": "light", "color": "red"}, "t": {}}
    seen = []
    done = sessions.incremental_import(source, lambda df, n: seen.append(df.count()), str(tmp_path / "cp2"))
    done.awaitTermination(120)
    assert sum(seen) == 3


def test_contexts_merged_turn_by_turn_equal_the_batch_merge(spark):
    turns = [("s", 1, "хочу красное сухое до 1500 руб"), ("s", 2, "и белое, без дуба, я новичок"), ("s", 3, "на свидание, с танинами: терпкое"), ("t", 1, "стейк и послевкусие"), ("t", 2, "донское игристое, бюджетное")]
    rows = spark.createDataFrame(turns, "session_id string, ts long, text string").withColumn("context", parse_context(F.col("text"), ["Россия"]))
    last = {"s": {}, "t": {}}  # what session_contexts keeps for a session
    for r in rows.select("session_id", "ts", F.to_json("context", {"ignoreNullFields": "false"}).alias("context")).orderBy("ts").collect():
        last[r.session_id] = sessions.merged_context(last[r.session_id], json.loads(r.context))
    batch = {r.session_id: json.loads(r.c) for r in merge_contexts(rows, "session_id", "ts").select("session_id", F.to_json("context", {"ignoreNullFields": "false"}).alias("c")).collect()}
    stated = lambda c: {k: v for k, v in c.items() if v not in (None, [], False) and (k, v) != ("experience", "novice")}
    for s in ("s", "t"):
        assert stated({k: v for k, v in last[s].items() if k != "avoided_text"}) == stated(batch[s])
    assert sorted(last["s"]["colors"]) == ["Белое", "Красное"] and last["s"]["notes"] == ["budget_unsupported"] and last["t"]["sparkling"] is True


def test_contexts_name_grapes_liked_and_refused(spark):
    rows = spark.createDataFrame([(1, "люблю мерло и каберне совиньон, но не люблю рислинг"), (2, "что-нибудь без муската"), (3, None)], "k long, text string")
    vocabulary = spark.createDataFrame([(g,) for g in ("Мерло", "Каберне Совиньон", "Каберне Фран", "Рислинг", "Мускат Белый", "Мускат")], "grape string")
    out = with_grapes(rows.withColumn("context", parse_context(F.col("text"))), vocabulary, "k", "text")
    got = {r.k: (r.context.grapes_like, r.context.grapes_avoid) for r in out.collect()}
    assert got == {1: (["Каберне Совиньон", "Мерло"], ["Рислинг"]), 2: ([], ["Мускат", "Мускат Белый"]), 3: ([], [])}


def test_descriptions_are_split_by_headings_words_and_labels(spark):
    text = "Цвет: рубиновый; аромат ягод и ваниль, хороший. Вкус: плотный\nТехнология производства: выдержка в дубе; Награды: золото. И ещё медаль"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "Просто вино"), (4, "технология: сталь")], "k long, t string")
    out = split_sections(rows, "k", "t", SECTIONS, "other", SECTION_HEADINGS, SECTION_LABEL).orderBy("k", "place").collect()
    assert [(r.k, r.section, r.text) for r in out] == [
        (1, "color", "Рубиновый."),
        (1, "aroma", "Аромат ягод и ваниль, хороший."),
        (1, "taste", "Плотный."),
        (1, "tech", "Технология производства: выдержка в дубе."),  # a heading goes as it is written in the pattern only
        (1, "other", "Награды: золото. И ещё медаль."),
        (3, "other", "Просто вино."),
        (4, "tech", "Сталь."),
    ]
