"""Corpus folders, parsers, index tables and result files."""

import io
import json
import os
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom import cli, models
from docloom.operators import answer as answering
from docloom.functions import recognition
from docloom.operators import corpus, index, transcribe
from docloom.sources import images, index_store, parsers, questions, results
from docloom.sources import corpus as folder
from docloom.streaming import ingest
from tests import cases


@pytest.fixture
def root(tmp_path):
    for rel, units in cases.CORPUS:
        path = tmp_path / "corpus" / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("ticket,fixed in\nORR-1847,4.3.2\nORR-2000,4.4.0\n" if rel.endswith(".csv") else units[0][0])
    for name, data in ((".hidden.txt", b"hidden"), ("_under.txt", b"under"), ("empty.txt", b""), ("blob.bin", b"x"), ("nul.txt", b"a\0b"), ("fake.docx", b"no zip"), ("latin.txt", "é€".encode("cp1252")), ("bom.txt", b"\xef\xbb\xbfok")):
        (tmp_path / "corpus" / name).write_bytes(data)
    (tmp_path / "corpus" / "void").mkdir()
    return str(tmp_path / "corpus")


def test_every_file_is_a_row(spark, root):
    rows = {r.rel: r for r in folder.read_corpus(spark, root, filesPerPartition=3).collect()}
    assert list(sorted(rows, key=lambda r: rows[r].file_ord)) == [r for r, _, _ in folder.listing(root)]
    assert {r: rows[r].skip for r in ("blob.bin", "nul.txt", "fake.docx")} == {"blob.bin": "unknown type", "nul.txt": "binary content", "fake.docx": "not a zip container (likely encrypted Office file)"}
    assert rows["latin.txt"].units[0].text == "é€" and rows["bom.txt"].units[0].text == "ok" and rows[".hidden.txt"].kind == "text"
    assert [u.text for u in rows["tickets/index.csv"].units] == [u[0] for u in cases.CORPUS[-1][1]]
    out = {r.rel: r.reason for r in corpus.skipped(spark.createDataFrame(list(rows.values()), folder.SCHEMA)).collect()}
    assert out["empty.txt"] == "no text" and "_under.txt" not in out


def test_many_small_files_share_a_partition_and_a_light_child(tmp_path):
    for n in range(300):
        (tmp_path / f"{n:03}.txt").write_text("x" * n)
    parts = lambda **options: [[f[1] for f in p.files] for p in folder.CorpusReader({"path": str(tmp_path), **options}).partitions()]
    names = [f"{n:03}.txt" for n in range(300)]
    assert parts() == [names]
    assert parts(filesPerPartition="150") == [names[:150], names[150:]]
    by_size = parts(bytesPerPartition="299")
    assert sum(by_size, []) == names and by_size[0] == names[:24] and by_size[-1] == names[-1:]
    assert parts(bytesPerPartition="299", filesPerPartition="150", parse="false") == [names]
    sizes = [sum(int(f[:3]) for f in p) for p in by_size]
    assert max(sizes) <= 299 and all(s + int(after[0][:3]) > 299 for s, after in zip(sizes, by_size[1:]))
    loaded = subprocess.run([sys.executable, "-c", "import sys, docloom.sources.parse_child; print({'pyspark', 'pandas'} & set(sys.modules))"], capture_output=True, text=True, check=True)
    assert loaded.stdout == "set()\n"


def test_a_file_that_hangs_costs_itself_only(root, tmp_path):
    os.mkfifo(os.path.join(root, "pipe.txt"))
    child = folder.ParseProcess(root, 20)
    assert child.parse("pipe.txt") == {"skip": "not a regular file"}
    assert child.parse("gone.txt") == {"skip": "not a regular file"}
    child.child.kill()
    child.child.wait()
    assert child.parse("_under.txt") == {"kind": "text", "units": [["under", "file", False]]}
    child.seconds = 0
    assert child.parse("_under.txt")["skip"].startswith("parser failure: timeout")
    child.seconds = 20
    assert child.parse("_under.txt")["kind"] == "text"
    child.close()


def test_index_is_built_once_and_answers(spark, root, tmp_path):
    held, built = index_store.ensure_index(spark, root, str(tmp_path / "index"))
    assert built
    held, built = index_store.ensure_index(spark, root, str(tmp_path / "index"))
    assert not built
    asked = spark.createDataFrame([(q, said) for q, said, *_ in cases.QUESTIONS], "qid string, question string")
    recorded = models.Recorded(reply_table=spark.createDataFrame([(q, r) for q, _, r, *_ in cases.QUESTIONS], "qid string, reply string"))
    out = {r.qid: (r.answer, r.citations, r.confidence) for r in answering.answer(held, asked, recorded).collect()}
    assert out == {q: (a, c, n) for q, _, _, a, c, n in cases.QUESTIONS}
    written = results.write_files(results.answer_json(answering.answer(held, asked, recorded)), str(tmp_path / "out"))
    assert written == 5 and json.loads((tmp_path / "out" / "q2_output.json").read_text())["citations"] == ["specs/pump_r2.txt"]
    row = index_store.report(spark, str(tmp_path / "index")).first()
    assert row.files == len(cases.CORPUS) + 4 and {s.rel for s in row.skipped} == {"blob.bin", "nul.txt", "fake.docx", "empty.txt"}
    with open(os.path.join(root, "new.txt"), "w") as file:
        file.write("new")
    assert index_store.ensure_index(spark, root, str(tmp_path / "index"))[1]


def test_dense_ranking_and_picker(spark):
    files = corpus.documents_as_files(spark.createDataFrame([(1, "alpha value 5"), (2, "beta value 5"), (3, "gamma")], "doc_id long, text string"))
    built = index.build_index(files)
    vectors = built.chunks.select("chunk_id", F.array(F.lit(0.0), F.lit(2.0)).alias("vector"))
    recorded = models.Recorded(
        reply_table=spark.createDataFrame([("q", '{"answer": "5", "sources": ["doc/1.txt", "doc/2.txt"]}')], "qid string, reply string"),
        query_vectors=spark.createDataFrame([("q", [0.0, 3.0])], "qid string, query_vector array<double>"),
        chunk_vectors=vectors,
        pick_table=spark.createDataFrame([("q", "doc/2.txt")], "qid string, rel string"),
    )
    held = index.build_index(files, recorded.chunks(built.chunks))
    asked = spark.createDataFrame([("q", "which value?")], "qid string, question string")
    assert answering.answer(held, asked, recorded, recorded, recorded).first().citations == ["doc/2.txt"]
    assert answering.answer(held, asked, recorded, recorded).first().citations == ["doc/1.txt"]


def test_empty_index_and_no_questions(spark):
    held = index.build_index(corpus.documents_as_files(spark.createDataFrame([], "doc_id long, text string")))
    recorded = models.Recorded(reply_table=spark.createDataFrame([], "qid string, reply string"))
    asked = spark.createDataFrame([("q", "what?")], "qid string, question string")
    assert [tuple(r) for r in answering.answer(held, asked, recorded).collect()] == [("q", "", [], 0.0)]
    assert answering.answer(held, asked.limit(0), recorded).collect() == []


STUBS = {
    "pypdf.py": "class Page:\n    def extract_text(self, **_): return ''\nclass PdfReader:\n    is_encrypted = False\n    pages = [Page(), Page()]\n    def __init__(self, data, strict): pass\n",
    "pypdfium2.py": """
from PIL.Image import Picture
class Page:
    def __init__(self, n): self.n = n
    def render(self, scale): return self
    def to_pil(self): return Picture(b"scan %d" % self.n)
class PdfDocument:
    def __init__(self, data): pass
    def __enter__(self): return self
    def __exit__(self, *_): pass
    def __len__(self): return 2
    def __getitem__(self, i): return Page(i + 1)
""",
    "PIL/__init__.py": "",
    "PIL/ImageOps.py": "def exif_transpose(image): return image\n",
    "PIL/Image.py": """
class Picture:
    mode, size, info = "RGB", (800, 600), {}
    def __init__(self, data): self.data = data
    def getbands(self): return "RGB"
    def convert(self, mode): return self
    def save(self, out, kind): out.write(self.data)
def open(file):
    data = file.read()
    if data == b"broken": raise ValueError("bad image")
    return Picture(data)
""",
}


def test_folder_index_holds_transcriptions_and_vectors(spark, tmp_path, monkeypatch):
    for name, body in STUBS.items():
        (tmp_path / "stubs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "stubs" / name).write_text(body)
    monkeypatch.setitem(spark.sparkContext.environment, "PYTHONPATH", str(tmp_path / "stubs"))
    root, path = tmp_path / "corpus", str(tmp_path / "index")
    root.mkdir()
    for name, data in (("a.png", b"picture"), ("b.png", b"broken"), ("mute.png", b"unread"), ("s.pdf", b"%PDF"), ("t.txt", b"plain")):
        (root / name).write_bytes(data)

    class Models:
        def transcribe(self, shown):
            return shown.where("name <> 'mute.png'").select("name", F.concat(F.lit(" saw "), F.col("content").cast("string"), F.lit("\n")).alias("reply"), F.array(F.lit(1.0)).alias("probabilities"))

        def chunks(self, parts):
            return parts.select("chunk_id", F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))

    left_out = lambda: {s.rel: s.reason for s in index_store.report(spark, path).first().skipped}
    held, built = index_store.ensure_index(spark, str(root), path)
    assert built and held.vectors is None and [f.rel for f in held.files.collect()] == ["t.txt"]
    assert left_out() == dict.fromkeys(["a.png", "b.png", "mute.png", "s.pdf"], "not transcribed")
    held, built = index_store.ensure_index(spark, str(root), path, Models(), Models())
    assert built and {f.rel: f.text for f in held.files.collect()} == {"a.png": "saw picture", "s.pdf": "saw scan 1\nsaw scan 2", "t.txt": "plain"}
    assert {(c.rel, c.loc) for c in held.chunks.collect()} == {("a.png", "text in image"), ("s.pdf", "page 1"), ("s.pdf", "page 2"), ("t.txt", "file")}
    assert {v.chunk_id for v in held.vectors.collect()} == {c.chunk_id for c in held.chunks.collect()}
    assert left_out() == {"b.png": "ocr failed: ValueError: bad image", "mute.png": "ocr failed: no reply"}
    held, built = index_store.ensure_index(spark, str(root), path, Models(), Models())
    assert not built and held.vectors.count() == 4
    (root / "new.txt").write_text("new")
    held, built = index_store.ensure_index(spark, str(root), path)
    assert built and index_store.load_index(spark, path).vectors is None and held.files.count() == 2


def zipped(**parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, body in parts.items():
            archive.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_rels", ".rels") if "rels" not in name else "xl/_rels/workbook.xml.rels", body)
    return buffer.getvalue()


def test_office_files_from_their_parts():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={style!r}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    table = "<w:tbl><w:tr><w:tc>" + p("pin") + "</w:tc><w:tc>" + p("use") + "</w:tc></w:tr><w:tr><w:tc>" + p("B1") + "</w:tc><w:tc>" + p("fan") + "</w:tc></w:tr></w:tbl>"
    body = f'<w:document {w}><w:body>{p("intro")}{p("Pins", "H1")}{p("text")}{table}{p("end")}</w:body></w:document>'
    styles = f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    data = zipped(word__document_xml=body, word__styles_xml=styles, word__header1_xml=f"<w:hdr {w}>{p('Doc 7')}</w:hdr>")
    assert parsers.parse("a.docx", data) == ("docx", [("intro", "body", False), ("Pins\ntext", "Pins", False), ("table 1 (Pins) columns: pin | use", "table 1 (Pins) header", True), ("table 1 (Pins) | pin: B1 | use: fan", "table 1 (Pins) row 2", True), ("end", "Pins", False), ("Doc 7", "header/footer", False)])
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row r="3"><c r="B3"><v>5.0</v></c></row></sheetData></worksheet>'
    data = zipped(xl__workbook_xml=f'<workbook {s}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', rels='<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>', xl__sharedStrings_xml=f"<sst {s}><si><t>id</t></si></sst>", xl__worksheets__s_xml=sheet)
    assert parsers.parse("b.xlsx", data) == ("xlsx", [("sheet One columns: id | n", "sheet One header", True), ("sheet One | n: 5", "sheet One row 3", True)])
    with pytest.raises(parsers.Skip, match="open failed"):
        parsers.parse("c.docx", b"PK\x03\x04 broken")
    # Stretches end behind what makes them long enough, at headings, and at each of two tables in a row.
    long = "x" * 700
    body = f'<w:document {w}><w:body>{table}{table}{p(long)}{p(long)}{p("after")}{p("One", "Title")}{p("Two", "H1")}{p("")}{p("last")}</w:body></w:document>'
    units = parsers.parse("d.docx", zipped(word__document_xml=body, word__styles_xml=styles))[1]
    assert [(u[0], u[1]) for u in units if not u[2]] == [(f"{long}\n{long}", "body"), ("after", "body"), ("One", "One"), ("Two\nlast", "Two")]
    assert [u[1] for u in units if u[2]] == ["table 1 header", "table 1 row 2", "table 2 header", "table 2 row 2"]


def test_question_files_on_disk(spark, tmp_path):
    (tmp_path / "ask.json").write_text('[{"id": "a", "question": "x?"}, "y?"]')
    out = [(r.qid, r.question) for r in questions.read_questions(spark, str(tmp_path / "ask.json")).orderBy("n").collect()]
    assert out == [("a", "x?"), ("ask_2", "y?")]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"ID-{i} text\n" * (i * 100 + 1)) for i in range(4)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    ingest.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = corpus.chunks(corpus.documents_as_files(docs)).select("chunk_id", "text")
    assert sorted(spark.read.parquet(str(tmp_path / "out" / "chunks")).select("chunk_id", "text").collect()) == sorted(batch.collect())


def test_transcriptions_and_transcribed_files(spark):
    shown = spark.createDataFrame([("a.png", b"1"), ("b.png", b"2")], "name string, content binary")
    recorded = models.Recorded(transcriptions=spark.createDataFrame([("a.png", "TYPE: US_PLATE\nTEXT: Texas 7abc", [0.5, 0.25])], "name string, reply string, probabilities array<double>"))
    out = sorted(tuple(r) for r in transcribe.transcriptions(shown, recorded).collect())
    assert out == [("a.png", "7ABC", "US_PLATE", 0.3536), ("b.png", "", "SIGN", 0.0)]
    assert {r.body for r in results.transcription_json(transcribe.transcriptions(shown, recorded)).collect()} == {'{"text":"7ABC","confidence":0.3536}', '{"text":"","confidence":0.0}'}
    parsed = spark.createDataFrame([("x_WITHDRAWN.png", 0, "image", None, []), ("s.pdf", 1, "pdf_scanned", None, []), ("e.png", 2, "image", None, []), ("t.txt", 3, "text", None, [("t", "file", False)])], f"rel string, file_ord long, kind string, skip string, units {folder.UNITS}")
    pages = spark.createDataFrame([("x_WITHDRAWN.png", 1, "B14: FAN", None), ("s.pdf", 2, "two", None), ("s.pdf", 1, "one", None), ("e.png", 1, None, "broken")], "rel string, page int, text string, error string")
    filled = transcribe.with_transcribed(parsed, pages)
    files = {r.rel: r for r in corpus.file_records(filled).collect()}
    assert files["s.pdf"].text == "one\ntwo" and [u.loc for u in files["s.pdf"].units] == ["page 1", "page 2"]
    assert not files["x_WITHDRAWN.png"].withdrawn and set(files) == {"x_WITHDRAWN.png", "s.pdf", "t.txt"}
    assert [tuple(r) for r in corpus.skipped(filled).collect()] == [("e.png", "ocr failed: broken")]


def test_files_without_images_meet_no_join(spark, tmp_path):
    parsed = spark.createDataFrame([("t.txt", 0, "text", None, [("t", "file", False)]), ("x.bin", 1, None, "unknown type", []), ("i.png", 2, "image", None, [])], f"rel string, file_ord long, kind string, skip string, units {folder.UNITS}")
    parsed.write.parquet(str(tmp_path / "parsed"))
    pages = spark.createDataFrame([("i.png", 1, "seen", None), ("t.txt", 1, "other", None)], "rel string, page int, text string, error string")
    filled = transcribe.with_transcribed(spark.read.parquet(str(tmp_path / "parsed")), pages)
    assert {r.rel: (r.skip, [u.text for u in r.units]) for r in filled.collect()} == {"t.txt": (None, ["t"]), "x.bin": ("unknown type", []), "i.png": (None, ["seen"])}
    texts = filled._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    assert texts.lstrip().startswith("Union") and "Relation" in texts


def test_signatures_count_repeated_rows(spark):
    told = lambda *rows: spark.createDataFrame(list(rows), "rel string, size long, mtime_ns long")
    a, b = ("a", 1, 1), ("b", -1, None)
    assert folder.same_signature(told(a, b), told(b, a)) and folder.same_signature(told(), told())
    assert not folder.same_signature(told(a, a, b), told(a, b, b)) and not folder.same_signature(told(a), told()) and not folder.same_signature(told(), told(b))


def test_scaled_sizes_equal_the_expression(spark):
    for w, h in ((800, 600), (3200, 1600), (320, 100), (1, 1), (5000, 1)):
        s = spark.range(1).select(recognition.model_size(F.lit(w), F.lit(h)).alias("s")).first().s
        assert (s.width, s.height) == images.scaled_size(w, h, 640, 1600)


def test_command_line(spark, root, tmp_path):
    (tmp_path / "replies.json").write_text("\n".join(json.dumps({"qid": q, "reply": r}) for q, _, r, *_ in cases.QUESTIONS))
    (tmp_path / "ask.json").write_text(json.dumps([{"id": q, "question": said} for q, said, *_ in cases.QUESTIONS]))
    args = ["--index", root, "--store", str(tmp_path / "store"), "--query-file", str(tmp_path / "ask.json"), "--replies", str(tmp_path / "replies.json"), "--output-dir", str(tmp_path / "out")]
    assert cli.main(args, spark) == 0
    for q, _, _, answer, cited, sure in cases.QUESTIONS:
        assert json.loads((tmp_path / "out" / f"{q}_output.json").read_text()) == {"answer": answer, "citations": cited, "confidence": sure}
    assert cli.asked(spark, cli.arguments(["--store", "x", "what", "is", "it"])).first().question == "what is it"
