import json

import pytest

from quirelake.functions import content, security
from quirelake.sources import syntax, writer
from quirelake.sources.pdf import read_pdf
from quirelake.streaming.watch import watch_pdf

from .test_pdf import SAMPLE


def test_operations():
    data = b"q /F1 12 Tf (a) Tj [1 (b)] TJ BI /W 1 ID \x00\x01 EI /X Do ) Q"
    got = list(content.operations(data))
    assert [o for o, _, _ in got] == ["q", "Tf", "Tj", "TJ", "BI", "Do", "?", "Q"]
    assert json.loads(got[1][1]) == ["/F1", 12] and json.loads(got[4][1]) == [2]


def test_names_in_use(spark):
    rows = spark.createDataFrame([(1, bytearray(b"/F1 9 Tf /Im0 Do /Im0 Do")), (2, None)], "page long, data binary")
    ops = content.content_operations(rows, "data", "page")
    used = content.used_names(ops, "page")
    assert {tuple(r) for r in used.collect()} == {(1, "Font", "F1"), (1, "XObject", "Im0")}
    have = spark.createDataFrame([(1, "Font", "F1"), (1, "Font", "F2"), (1, "ColorSpace", "C")], "page long, category string, name string")
    assert [r["name"] for r in content.unused_resources(have, used, "page").collect()] == ["F2"]
    assert {(r["operator"], r["n"]) for r in content.operator_counts(ops, "page").collect()} == {("Tf", 1), ("Do", 2)}


@pytest.mark.parametrize(("revision", "length"), [(2, 5), (3, 16), (4, 16)])
def test_passwords(revision, length):
    owner = security.owner_entry(b"owner", b"user", revision, length)
    key = security.file_key(b"user", owner, -44, b"id", revision, length)
    entries = {"O": owner, "U": security.user_entry(key, b"id", revision), "P": -44, "R": revision, "Length": length * 8}
    assert security.authenticate(b"user", entries, b"id") == ("user", key)
    assert security.authenticate(b"owner", entries, b"id") == ("owner", key)
    assert security.authenticate(b"other", entries, b"id") is None


def test_rewrite_restores_all_objects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(SAMPLE)
    pdf = read_pdf(spark, str(tmp_path / "in"))
    out = bytes(writer.write_plain(pdf.objects, pdf.documents).first()["content"])
    old, new = syntax.load(SAMPLE, repair=False), syntax.load(out, repair=False)
    assert new.trailer["Root"] == old.trailer["Root"]
    assert {k: syntax.as_json(s.value) for k, s in new.objects.items()} == {k: syntax.as_json(s.value) for k, s in old.objects.items()}
    assert {k: s.stream for k, s in new.objects.items()} == {k: s.stream for k, s in old.objects.items()}
    keys = {r["key"]: json.loads(r["json"]) for r in writer.json_objects(pdf.objects).collect()}
    assert "stream" in keys["obj:7 0 R"] and keys["obj:8 0 R"]["value"] == "u:nobody refers to me"


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(SAMPLE)
    query = watch_pdf(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("kind = 'object'").count() == 8
