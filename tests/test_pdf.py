import io
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, pdf, pdf_format, pdf_text, pdf_write, sample


def written(texts, **named):
    out = io.BytesIO()
    writer = pdf_write.PdfWriter(out)
    for k, text in enumerate(texts):
        writer.page(text, f"p{k}", **named)
    writer.close()
    return out.getvalue()


def opened(data):
    return pdf_format.PdfFile(io.BytesIO(data), len(data))


def read(data, begin=0, end=1 << 40):
    return list(pdf_text.pages(opened(data), begin, end))


def plain(text):
    """What a page says: hyphens at line ends and white space as the block cleaner treats them."""
    return [x for x in (" ".join(re.sub(r"-\n(?=[a-z])", "", p).split()) for p in re.split(r"\n\s*\n", text)) if x]


def test_texts_come_back():
    rng = random.Random(1)
    texts = ["", "a", "(paren) \\ back) (", "é ñ ß € “quoted” ‘s’", "日本語 text \U0001F600 😀 mixed", "a\tb  c\x00d", "one- two " * 40, "x" * 300, "foo-\nbar\nBaz", "a\n\nb\n \nc", "﻿bom ﬁ"]
    signs = ["word", "a", "-", "Trail-", "é", "日", " ", "  ", "\n", "\n\n", "\t", ".", "(", ")", "\\", "\xa0", "\x85", "\r", "😀"]
    texts += [" ".join(rng.choice(signs) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    got = read(written(texts))
    assert [(n, label) for n, label, _ in got] == [(k + 1, f"p{k}") for k in range(len(texts))]
    for text, (_, _, blocks) in zip(texts, got, strict=True):
        assert [x for x in (" ".join(re.sub(r"-\n(?=[a-z])", "", b).split()) for b in blocks) if x] == plain(text), repr(text)


def test_a_tree_of_many_pages_is_read_in_ranges():
    n = 64 * 64 + 70
    data = written([f"page {k}" for k in range(n)])
    file = opened(data)
    assert file.count() == n
    for begin, end in ((0, 3), (63, 66), (4095, 4100), (n - 2, n + 5), (n, n + 1)):
        file = opened(data)
        got = [(num, blocks) for num, _, blocks in pdf_text.pages(file, begin, end)]
        assert got == [(k + 1, [f"page {k}"]) for k in range(begin, min(end, n))]
        assert len(file.known) < 400  # not all of the objects
    for count in (0, 1, 63, 64, 65, 128, 4096):
        assert [b for _, _, b in read(written(["x"] * count))] == [["x"]] * count


def document(objects, trailer="<< /Root 1 0 R /Size 99 >>", broken=False):
    """A file of hand-written objects with a table of cross references."""
    out, places = bytearray(b"%PDF-1.4\n"), {}
    for number, body in objects.items():
        places[number] = len(out)
        out += b"%d 0 obj\n%b\nendobj\n" % (number, body)
    at = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n"
    for number, place in places.items():
        out += b"%d 1\n%010d 00000 n \n" % (number, place + (7 if broken else 0))
    return bytes(out + b"trailer %b\nstartxref\n%d\n%%%%EOF" % (trailer.encode(), at))


def stream(data, head=b""):
    return b"<< %b /Length %d >>\nstream\n%b\nendstream" % (head, len(data), data)


def page_of(content, resources=b"<< /Font << /F1 5 0 R >> >>", more=None, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", **kwargs):
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 /Kids [3 0 R] /Resources %b >>" % resources,
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 4: content if content.startswith(b"<<") else stream(content), 5: font, **(more or {}),
    }
    return document(objects, **kwargs)


def blocks_of(*args, **kwargs):
    ((_, _, blocks),) = read(page_of(*args, **kwargs))
    return blocks


def test_operators_place_text():
    content = rb"""BT /F1 10 Tf 14 TL 1 0 0 1 50 700 Tm [(Wo) 20 (rds) -300 (apart)] TJ T* (next \(line\) \101\
!) Tj (third) ' ET
    q 1 0 0 1 0 -300 cm BT /F1 10 Tf 50 600 Td (moved) Tj 0 -12 TD (down) Tj T* <6D6F7265> Tj ET Q BT /F1 20 Tf 50 750 Td (Title) Tj ET % comment"""
    assert blocks_of(content) == ["Title", "Words apart\nnext (line) A!\nthird", "moved\ndown\nmore"]


def test_reading_order_and_columns():
    content = b"BT /F1 10 Tf 1 0 0 1 300 700 Tm (right one) Tj 1 0 0 1 50 700 Tm (left one) Tj 1 0 0 1 50 688 Tm (left two) Tj 1 0 0 1 300 688 Tm (right two) Tj 1 0 0 1 50 800 Tm (head) Tj ET"
    assert blocks_of(content) == ["head", "left one\nleft two", "right one\nright two"]


def test_encodings_widths_and_maps():
    font = b"<< /Type /Font /Subtype /Type1 /FirstChar 65 /Widths [100 200] /Encoding << /Differences [65 /eacute /uni20AC 1 /fi] >> >>"
    assert blocks_of(b"BT /F1 10 Tf 0 0 Td (AB\x01) Tj ET", font=font) == ["é€fi"]
    cmap = b"2 beginbfrange <0001> <0003> <0041> <0010> <0011> [<00480049> <D83DDE00>] endbfrange 1 beginbfchar <0020> <0020> endbfchar"
    wide = {5: b"<< /Subtype /Type0 /ToUnicode 6 0 R /DescendantFonts [7 0 R] >>", 6: stream(zlib.compress(cmap), b"/Filter /FlateDecode"), 7: b"<< /W [1 [500 600] 3 17 700] /DW 400 >>"}
    assert blocks_of(b"BT /F1 10 Tf 0 0 Td <000100020003002000100011> Tj ET", more=wide) == ["ABC HI\U0001F600"]


def test_forms_filters_and_inline_images():
    form = {8: stream(b"BT /F1 10 Tf 5 5 Td (inside) Tj ET", b"/Subtype /Form /Matrix [1 0 0 1 10 400]"), 9: stream(b"/Me Do", b"/Subtype /Form")}
    resources = b"<< /Font << /F1 5 0 R >> /XObject << /Me 8 0 R /Loop 9 0 R >> >>"
    assert blocks_of(b"/Me Do BI /W 1 ID \x00(\xff EI BT /F1 10 Tf 0 0 Td (after) Tj ET", resources, form) == ["inside", "after"]
    raw = b"BT /F1 10 Tf 0 0 Td (coded) Tj ET"
    import base64

    assert blocks_of(stream(raw.hex().encode() + b">", b"/Filter /ASCIIHexDecode")) == ["coded"]
    assert blocks_of(stream(base64.a85encode(zlib.compress(raw)) + b"~>", b"/Filter [/ASCII85Decode /FlateDecode]")) == ["coded"]


def packed(predictor):
    """The same page with objects in an object stream and cross references in a stream."""
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", 5: b"<< /Subtype /Type1 >>"}
    heads, body = b"", b""
    for n, o in inner.items():
        heads += b"%d %d " % (n, len(body))
        body += o + b" "
    out = bytearray(b"%PDF-1.5\n")
    places = {}
    for n, o in ((4, stream(b"BT /F1 10 Tf 0 0 Td (packed) Tj ET")), (6, stream(zlib.compress(heads + body), b"/Type /ObjStm /N 4 /First %d /Filter /FlateDecode" % len(heads)))):
        places[n] = len(out)
        out += b"%d 0 obj\n%b\nendobj\n" % (n, o)
    at = len(out)
    rows = [(0, 0, 255), (2, 6, 0), (2, 6, 1), (2, 6, 2), (1, places[4], 0), (2, 6, 3), (1, places[6], 0), (1, at, 0)]
    rows = [bytes([a]) + b.to_bytes(2, "big") + bytes([c]) for a, b, c in rows]
    how = b""
    if predictor:
        how = b"/DecodeParms << /Predictor 12 /Columns 4 >>"
        rows = [b"\x02" + bytes((x - y) & 255 for x, y in zip(r, above, strict=True)) for r, above in zip(rows, [bytes(4), *rows], strict=False)]
    table = stream(zlib.compress(b"".join(rows)), b"/Type /XRef /W [1 2 1] /Size 8 /Root 1 0 R /Filter /FlateDecode " + how)
    return bytes(out) + b"7 0 obj\n%b\nendobj\nstartxref\n%d\n%%%%EOF" % (table, at)


@pytest.mark.parametrize("predictor", [False, True])
def test_object_streams(predictor):
    data = packed(predictor)
    assert read(data) == [(1, None, ["packed"])]
    assert read(data.replace(b"startxref", b"startxxxx")) == [(1, None, ["packed"])]  # found by a search


def test_row_predictors():
    rng = random.Random(2)
    rows = [bytes(rng.randrange(256) for _ in range(6)) for _ in range(5)]
    coded, above = b"", bytes(6)
    for kind, row in enumerate(rows):
        coded += bytes([kind])
        for i, x in enumerate(row):
            a, b, c = (row[i - 2] if i > 1 else 0), above[i], (above[i - 2] if i > 1 else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            coded += bytes([(x - [0, a, b, (a + b) // 2, paeth][kind]) & 255])
        above = row
    assert pdf_format.unpredicted(coded, {"Predictor": 15, "Columns": 3, "Colors": 2}) == b"".join(rows)


def test_broken_and_encrypted_files():
    content = b"BT /F1 10 Tf 0 0 Td (still here) Tj ET"
    assert blocks_of(content, broken=True) == ["still here"]
    for data in (b"", b"not a file", page_of(content, trailer="<< /Root 1 0 R /Encrypt 9 0 R >>")):
        with pytest.raises(pdf_format.BadPdf):
            opened(data)
    looped = page_of(content, more={2: b"<< /Type /Pages /Kids [2 0 R 3 0 R] >>"})
    assert len(list(opened(looped).pages(0, 10))) >= 0  # ends


def test_a_large_file_is_many_tasks(spark, tmp_path):
    texts = [f"Page number {k}. " + " ".join(f"w{k}x{j}" for j in range(60)) for k in range(400)]
    (tmp_path / "big.pdf").write_bytes(written(texts))
    (tmp_path / "small.pdf").write_bytes(written(["only one"]))
    df = pdf.read_pdf(spark, str(tmp_path), rangeBytes=20_000)
    assert df.rdd.getNumPartitions() > 5
    got = {(r.source, r.page): r.blocks for r in df.collect()}
    assert len(got) == 401 and got["small.pdf", 1] == ["only one"]
    assert all(" ".join(got["big.pdf", k + 1][0].split()) == t for k, t in enumerate(texts))
    assert pdf.read_pdf(spark, f"{tmp_path}/s*.pdf").count() == 1 and pdf.read_pdf(spark, f"{tmp_path}/big.pdf").count() == 400


def test_documents_are_written_and_read_back(spark, tmp_path):
    rows = [(f"s{k % 3}" if k % 7 else None, k, f"Doc {k} says é.\n\nIt ends here." if k else None) for k in range(120)]
    pages = spark.createDataFrame(rows, files.PAGES).repartition(4)
    pdf.write_pdf(pages, f"{tmp_path}/out", filePages=20)
    found = pdf.read_pdf(spark, f"{tmp_path}/out")
    assert {(int(r.label), tuple(r.blocks)) for r in found.collect()} == {(k, (f"Doc {k} says é.", "It ends here.") if k else ()) for k in range(120)}
    assert max(r["count"] for r in found.groupBy("source").count().collect()) <= 20
    texts = {r.text for r in files.pdf_pages(spark, f"{tmp_path}/out").collect()}
    assert "Doc 5 says é.\n\nIt ends here." in texts and len(texts) == 119
    pdf.write_pdf(pages.where("page < 3"), f"{tmp_path}/out", mode="overwrite")
    assert pdf.read_pdf(spark, f"{tmp_path}/out").count() == 3


def test_files_of_failed_writes_do_not_count(spark, tmp_path):
    pages = spark.createDataFrame([("s", k, "text") for k in range(20)], files.PAGES)
    pdf.write_pdf(pages, f"{tmp_path}/out")
    with pytest.raises(Exception, match="failed on purpose"):
        pdf.write_pdf(pages.withColumn("label", F.when(F.col("page") > 15, F.raise_error(F.lit("failed on purpose")))), f"{tmp_path}/out")
    (tmp_path / "out" / "left-over.pdf").write_bytes(written(["of a lost task"]))
    assert pdf.read_pdf(spark, f"{tmp_path}/out").count() == 20


def test_bad_files_fail_or_are_left_out(spark, tmp_path):
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    (tmp_path / "good.pdf").write_bytes(written(["fine"]))
    with pytest.raises(Exception, match="bad.pdf"):
        pdf.read_pdf(spark, str(tmp_path)).collect()
    assert [r.blocks for r in pdf.read_pdf(spark, str(tmp_path), mode="DROPMALFORMED").collect()] == [["fine"]]


def test_the_sample_document(spark, tmp_path):
    sample.write_sample(spark, f"{tmp_path}/sample")
    got = {r.page: r.text for r in files.pdf_pages(spark, f"{tmp_path}/sample").collect()}
    want = {r.page: r.text for r in sample.sample_pages(spark).collect()}
    assert set(got) == set(want)
    for k, text in want.items():
        title, body = text.split("\n\n")
        assert got[k] == f"{title}\n\n{body}\n\nHarbour rules, page {k}"


def test_lines_are_cut_and_read_at_once(monkeypatch):
    """Lines as cut place by place, and less than one parsed object for each line that is shown."""
    import io
    import random

    from tessera.sources import pdf_format, pdf_text, pdf_write

    def plain(line):
        out, begin, last = [], 0, 0
        for cut in (*(m.start() for m in pdf_write.CUT.finditer(line)), len(line)):
            if cut - begin > pdf_write.LINE and last > begin:
                out.append(line[begin:last])
                begin = last + 1
            last = cut
        return [x for x in (*out, line[begin:]) if x.strip()]

    rng = random.Random(4)
    for _ in range(300):
        line = "".join(rng.choice(["a", "bcd-", " ", " ", "  ", "efghijk", "x" * rng.randint(1, 120)]) for _ in range(rng.randint(0, 60)))
        assert pdf_write.wrapped(line) == plain(line)
    text = "\n".join(f"line {k} of a text, and so on" for k in range(200))
    out = io.BytesIO()
    writer = pdf_write.PdfWriter(out)
    writer.page(text, "1")
    writer.close()
    calls = []
    monkeypatch.setattr(pdf_text, "parsed", lambda *a: calls.append(1) or pdf_format.parsed(*a))
    found = list(pdf_text.pages(pdf_format.PdfFile(io.BytesIO(out.getvalue()), len(out.getvalue())), 0, 1))
    assert [x[2] for x in found] == [[text]] and len(calls) < 200
