from __future__ import annotations

import io
import json
import zipfile

import pytest
from conftest import values
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.sources import models, readers, sinks


def test_pages_and_messages(spark, tmp_path):
    (tmp_path / "dm" / "x").mkdir(parents=True)
    good = [
        {"id": "1", "timestamp": "2024-01-01T00:00:00Z", "content": " hi\n there ", "author": {"id": "a", "username": "ann", "global_name": ""}, "application_id": "7"},
        {"id": "2", "timestamp": "", "content": "no time", "author": {"id": "a", "username": "ann"}},
        {"id": "", "timestamp": "2024-01-01T02:00:00+02:00", "content": "", "author": {"id": "b", "username": "bob", "bot": True}, "embeds": [{"title": "T", "provider": {"name": "P"}}], "attachments": [{"a": "b"}]},
        {"id": "3", "timestamp": "2020-01-01T00:00:00Z", "content": "old", "author": {"id": "a", "username": "ann"}},
    ]
    (tmp_path / "dm" / "x" / "page1.json").write_text(json.dumps(good))
    (tmp_path / "dm" / "bad.json").write_text("[{ broken")
    raw = readers.pages(spark, str(tmp_path))
    assert [r.damaged for r in raw.collect() if r.damaged] == ["[{ broken"]
    got = readers.normalised(raw, str(tmp_path), "2023-01-01").orderBy("author_id").collect()
    assert [(r.content_normalized, r.author_name, r.is_bot_or_application, r.embeds_count, r.attachments_count) for r in got] == [("hi there", "ann", True, 0, 0), ("T — P", "bob", True, 1, 1)]
    assert got[1].message_id.startswith("message_") and got[0].thread_id == got[1].thread_id


def test_json_lines(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert readers.json_lines(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert values(readers.json_lines(spark, str(tmp_path / "x.jsonl"), schema)) == [(1,), (2,)]
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n{"a"\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.json_lines(spark, str(tmp_path / "y.jsonl"), schema).collect()


def test_documents_in_three_layouts(spark, tmp_path):
    for i, doc in enumerate([{"entities": [{"entity_id": "e", "canonical_name": "N", "entity_type": "character"}]}, {"cards": [{"title": "Old One", "entity_type": "location"}, {"title": "x", "entity_type": "theme"}]}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc))
    got = values(readers.entities(spark, str(tmp_path), ["character", "location"]).select("canonical_name", "aliases"))
    assert got == [("N", []), ("Old One", [])]
    assert readers.json_array(spark, str(tmp_path), "cards", T.StructType([T.StructField("title", T.StringType())])).count() == 2


def _zip(path, files):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    path.write_bytes(buffer.getvalue())


def test_word_and_sheets(spark, tmp_path):
    ns = 'xmlns:w="w"'
    _zip(tmp_path / "a.docx", {"word/document.xml": f"<w:d {ns}><w:p><w:r><w:t>Hello </w:t><w:t>you</w:t></w:r></w:p><w:p><w:t>Two</w:t></w:p></w:d>"})
    (tmp_path / "b.docx").write_bytes(b"no zip")
    assert [r[0] for r in readers.word_documents(spark, str(tmp_path)).orderBy("path").select("text").collect()] == ["Hello you\nTwo", None]
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>No. of</t></is></c></row><row r="2"/><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>5</v></c></row>'
    _zip(tmp_path / "c.xlsx", {"xl/workbook.xml": '<x:w xmlns:x="x"><x:sheet name="S1"/></x:w>', "xl/sharedStrings.xml": '<x:s xmlns:x="x"><x:si><x:t>Title</x:t></x:si><x:si><x:t>Song</x:t></x:si></x:s>', "xl/worksheets/sheet1.xml": f'<x:w xmlns:x="x">{rows.replace("<", "<x:").replace("<x:/", "</x:")}</x:w>'})
    assert [(r.sheet, r.row, r.cells) for r in readers.sheets(spark, str(tmp_path)).collect()] == [("S1", 3, {"title": "Song", "no_of": "5"})]


def test_cached_lookups(spark):
    keys = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "k string")
    cache = spark.createDataFrame([("a", "cached")], "k string, v string")

    def fetch(k):
        if k == "c":
            raise OSError
        return {"v": f"fresh {k}"}

    assert values(readers.looked_up(keys, "k", cache, fetch, ["v"])) == [("a", "cached"), ("b", "fresh b"), ("c", None)]


def test_versions_views_and_lines(spark, tmp_path):
    t = sinks.VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        t.read()
    t.write(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"))
    assert t.upsert(spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), "k", ["v"]) == {"updated": 1, "added": 1}
    assert values(t.read()) == [("a", 1), ("b", 3), ("c", 4)]
    t.undo()
    assert values(t.read()) == [("a", 1), ("b", 2)]
    t.append(spark.createDataFrame([("z", 9)], "k string, v int"))
    assert values(t.read()) == [("a", 1), ("b", 2), ("z", 9)]
    t.undo()
    with pytest.raises(ValueError):
        t.undo()
    built = []

    def build():
        built.append(1)
        return spark.range(3).toDF("i")

    for stamp in ("1", "1", "2"):
        assert sinks.view(spark, f"file://{tmp_path}/v", {"src": stamp}, build).count() == 3
    assert len(built) == 2
    df = spark.range(3).withColumn("s", F.lit("x"))
    assert sinks.fingerprint(df) == sinks.fingerprint(df.orderBy(F.desc("id"))) != sinks.fingerprint(df.where("id > 0"))
    sinks.write_lines(df, f"{tmp_path}/l")
    sinks.write_lines(df, f"{tmp_path}/l", append=True)
    assert spark.read.json(f"{tmp_path}/l").count() == 6
    index = sinks.pages(spark.createDataFrame([("s", "T<", "a\n\nb&")], "slug string, title string, text string"), f"{tmp_path}/p", "slug", "title", "text")
    assert index.count() == 1 and spark.read.parquet(f"{tmp_path}/p").collect()[0]["html"].endswith("<h1>T&lt;</h1><p>a</p><p>b&amp;</p>")
    seen_df, seen = sinks.with_counters(df, "n", rows=F.count(F.lit(1)))
    seen_df.collect()
    assert seen.get == {"rows": 3}


def test_model_boundary(spark):
    client = models.StubClient([("good", 'Sure:\n```json\n{"items": [{"label": "x"}, 5, {"label": 2}]}\n```')], "no json")
    rows = spark.createDataFrame([("1", "a good one"), ("2", "bad"), ("3", None)], "k string, p string")
    got = models.answers(rows, "k", "p", client, "items", ["label"])
    assert values(got) == [("1", 1, True, "x"), ("1", 2, True, "2"), ("2", 0, False, None), ("3", 0, False, None)]
    filled = models.with_fallback(rows, "k", got, "label", F.lit("guess"))
    assert values(filled.select("k", "label", "by")) == [("1", "x", "model"), ("2", "guess", "heuristic"), ("3", "guess", "heuristic")]
    refs = spark.createDataFrame([("m2", ["m1", "m2"]), ("1", ["m1", "m2"]), ("9", ["m1"]), ("x", ["m1"])], "r string, ids array<string>")
    assert [r[0] for r in refs.select(models.resolved_reference(F.col("r"), F.col("ids"))).collect()] == ["m2", "m1", None, None]
