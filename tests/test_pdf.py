import json
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quirelake.functions import codecs
from quirelake.sources import syntax
from quirelake.sources.pdf import read_pdf


def build(objects: dict[int, bytes], trailer: bytes) -> bytes:
    """A file of numbered object bodies with a classic cross-reference table."""
    out, at = bytearray(b"%PDF-1.7\n"), {}
    for num, body in objects.items():
        at[num] = len(out)
        out += b"%d 0 obj\n" % num + body + b"\nendobj\n"
    start, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for num in range(1, size):
        out += b"%010d 00000 n \n" % at[num] if num in at else b"0000000000 00000 f \n"
    return bytes(out + b"trailer\n<< /Size %d " % size + trailer + b" >>\nstartxref\n%d\n%%%%EOF\n" % start)


def stream(body: bytes, extra: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n" % (len(body), extra) + body + b"\nendstream"


SAMPLE = build(
    {
        1: b"<< /Type /Catalog /Pages 2 0 R /PageLabels << /Nums [0 << /S /r >> 2 << /S /D /P (A-) /St 5 >>] >> >>",
        2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 3 /MediaBox [0 0 100 200.5] /Rotate 90 >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R /CropBox [1 1 9 9] >>",
        4: b"<< /Type /Pages /Kids [5 0 R 6 0 R 2 0 R] /MediaBox [0 0 5 5] >>",
        5: b"<< /Type /Page /Contents 7 0 R /Rotate 0 >>",
        6: b"<< /Type /Page /Title (a\\(b\\)\\101\\\n!) /Name /A#20B /N null /H <48 6> >>",
        7: stream(zlib.compress(b"BT (hello) Tj ET"), b"/Filter /FlateDecode"),
        8: b"(nobody refers to me)",
    },
    b"/Root 1 0 R",
)


@pytest.fixture(scope="module")
def pdf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pdf")
    (folder / "good.pdf").write_bytes(SAMPLE)
    (folder / "moved.pdf").write_bytes(SAMPLE.replace(b"startxref\n", b"startxref\n9"))
    (folder / "bad.pdf").write_bytes(b"no document at all")
    return read_pdf(spark, str(folder))


def named(rows, name):
    return [r for r in rows if r["doc"].endswith(name)]


def test_pages_inherit(pdf):
    rows = pdf.pages().orderBy("doc", "page_idx").collect()
    for name in ("good.pdf", "moved.pdf"):
        got = [(r["page_idx"], r["num"], r["media_box"], r["crop_box"], r["rotate"]) for r in named(rows, name)]
        whole = [0.0, 0.0, 100.0, 200.5]
        assert got == [(0, 3, whole, [1.0, 1.0, 9.0, 9.0], 90), (1, 5, [0.0, 0.0, 5.0, 5.0], [0.0, 0.0, 5.0, 5.0], 0), (2, 6, [0.0, 0.0, 5.0, 5.0], [0.0, 0.0, 5.0, 5.0], 90)]


def test_labels_streams_reach_and_diagnostics(pdf):
    labels = named(pdf.page_labels().orderBy("start_idx").collect(), "good.pdf")
    assert [(r["start_idx"], r["style"], r["prefix"], r["start"]) for r in labels] == [(0, "r", None, 1), (2, "D", "A-", 5)]
    assert {bytes(r["bytes"]) for r in pdf.streams().collect()} == {b"BT (hello) Tj ET"}
    assert {r["num"] for r in named(pdf.reachable().collect(), "good.pdf")} == set(range(1, 8))
    found = pdf.diagnostics.collect()
    assert not named(found, "good.pdf") and named(found, "moved.pdf") and named(found, "bad.pdf")


def test_labels_of_deep_number_trees(spark, tmp_path):
    nodes = {
        2: b"<< /Type /Pages /Kids [] /Count 0 >>",
        3: b"<< /Kids [4 0 R 5 0 R] >>",
        4: b"<< /Limits [0 2] /Kids [6 0 R] >>",
        5: b"<< /Limits [7 7] /Nums [7 << /S /D /P (" + b"p" * 1500 + b") >>] /Kids [3 0 R] >>",
        6: b"<< /Limits [0 2] /Nums [0 << /S /r >> 2 << /S /A /St 4 >>] >>",
        9: b"<< /Kids [6 0 R] /Nums [40 << /S /D >>] >>",
    }
    (tmp_path / "away.pdf").write_bytes(build({1: b"<< /Type /Catalog /Pages 2 0 R /PageLabels 3 0 R >>"} | nodes, b"/Root 1 0 R"))
    (tmp_path / "here.pdf").write_bytes(build({1: b"<< /Type /Catalog /Pages 2 0 R /PageLabels << /Kids [4 0 R 5 0 R] >> >>"} | nodes, b"/Root 1 0 R"))
    rows = read_pdf(spark, str(tmp_path)).page_labels().orderBy("start_idx").collect()
    for name in ("away.pdf", "here.pdf"):
        assert [tuple(r)[1:] for r in named(rows, name)] == [(0, "r", None, 1), (2, "A", None, 4), (7, "D", "p" * 1500, 1)]


def test_values(pdf):
    rows = {r["num"]: json.loads(r["value"]) for r in named(pdf.objects.collect(), "good.pdf")}
    assert rows[6] == {"/Type": "/Page", "/Title": "u:a(b)A!", "/Name": "/A B", "/H": "u:H`"} and rows[3]["/Parent"] == "2 0 R"


def test_object_and_xref_streams():
    members = b"<< /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [] >>"
    head = b"1 0 2 34 "
    out = bytearray(b"%PDF-1.5\n")
    first = len(out)
    out += b"3 0 obj\n" + stream(zlib.compress(head + members), b"/Type /ObjStm /N 2 /First %d /Filter /FlateDecode" % len(head)) + b"\nendobj\n"
    at = len(out)
    body = b"".join(k.to_bytes(1, "big") + a.to_bytes(2, "big") + b.to_bytes(1, "big") for k, a, b in [(0, 0, 0), (2, 3, 0), (2, 3, 1), (1, first, 0), (1, at, 0)])
    out += b"4 0 obj\n" + stream(body, b"/Type /XRef /W [1 2 1] /Size 5 /Root 1 0 R") + b"\nendobj\nstartxref\n%d\n%%%%EOF" % at
    doc = syntax.load(bytes(out), repair=False)
    assert doc.objects[(1, 0)].value["Pages"] == syntax.Ref(2, 0) and doc.objects[(2, 0)].value["Type"] == "Pages"


def test_updates_first_wins_and_freed_numbers_stay_gone():
    rows = [syntax.Entry(1, 0, "offset", 50), syntax.Entry(2, 0, "free"), syntax.Entry(1, 0, "offset", 9), syntax.Entry(2, 0, "offset", 20)]
    assert {k: e.offset for k, e in syntax.register(rows).items()} == {(1, 0): 50}
    got, _ = syntax.recover(b"1 0 obj\n1\nendobj\n1 0 obj\n2\nendobj\n")
    assert got[(1, 0)].offset == 17


@given(st.binary(max_size=300))
def test_codec_round_trips(data):
    import base64

    assert codecs.run_length(codecs.encode_run_length(data)) == data
    assert codecs.ascii_hex(data.hex().encode() + b">") == data
    assert codecs.ascii85(base64.a85encode(data) + b"~>") == data
    assert codecs.decode(zlib.compress(data), ["Fl"]) == (data, [])
    assert codecs.rc4(b"key", codecs.rc4(b"key", data)) == data


def test_codec_contracts():
    whole = zlib.compress(b"some text that is long enough to be cut" * 9)
    out, warnings = codecs.decode(whole[:-9], ["FlateDecode"])
    assert warnings and out
    assert codecs.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert codecs.lzw(bytes.fromhex("800b6050220c0c8501")) == b"-----A---B"
    up = bytes([2, 1, 2, 3, 2, 1, 1, 1])
    assert codecs.predicted(up, {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4])
    assert codecs.predicted(bytes([4, 5, 1, 4, 1, 1]), {"Predictor": 15, "Columns": 2}) == bytes([5, 6, 6, 7])
    assert codecs.predicted(bytes([1, 1, 1]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3])
    with pytest.raises(codecs.CodecError):
        codecs.decode(b"", ["Odd"])
    with pytest.raises(codecs.CodecError):
        codecs.decode(b"", ["Fl"] * 17)
