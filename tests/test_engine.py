"""Sources, OCR seam, roster, report and command line, end to end on small files."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerlift.__main__ import main
from ledgerlift.functions import text
from ledgerlift.operators import index, pages
from ledgerlift.operators.confidence import document_text
from ledgerlift.plans.pipeline import run
from ledgerlift.schemas import RESULTS, WORDS
from ledgerlift.sources import config, files, ocr, roster, tsv
from ledgerlift.streaming import ingest

from .test_geometry import ASSETS, CAPITAL, NOW, REVENUE, words_of

CACHE = "key string, path string, payload string, created_at timestamp"
TSV = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t10\t20\t30\t18\t88\t{}\n"


def reader(content: bytes, settings: ocr.Settings):
    """A stub: the file says its text and, for each resolution, its confidence."""
    said, *sure = content.decode().split("|")
    if said == "broken":
        raise ValueError("no document")
    for page in (1, 2, 3):
        yield page, f"{said} {page} at {settings.dpi}", TSV.format(said), float(dict(x.split("=") for x in sure).get(str(settings.dpi), 0)), settings.dpi, ["grey"]


def test_files_are_scanned_read_retried_and_cached(spark, tmp_path):
    given = {"a.pdf": "good|300=90", "sub/b.pdf": "poor|300=40|400=85|600=99", "sub/deep/c.pdf": "worse|300=50|400=10|600=20", "d.pdf": "broken", "e.PDF": "other", "f.txt": "other", "g.pdf": "known|300=99"}
    for name, content in given.items():
        os.makedirs(tmp_path / "in" / os.path.dirname(name), exist_ok=True)
        (tmp_path / "in" / name).write_text(content)
    scanned = files.fingerprinted(files.scan_files(spark, str(tmp_path / "in")))
    found = {os.path.relpath(r.path.removeprefix("file:"), tmp_path / "in"): r.doc_id for r in scanned.collect()}
    assert set(found) == {n for n in given if n.endswith(".pdf")}
    stat = os.stat(tmp_path / "in/a.pdf")
    assert found["a.pdf"] == hashlib.sha1(f"{stat.st_size}{int(stat.st_mtime)}".encode() + given["a.pdf"].encode()).hexdigest()
    old = spark.createDataFrame([(found["g.pdf"], "g", '{"text": "from the cache", "pages": []}', None)], CACHE)
    settings = ocr.Settings(dpi_retry=[400, "x", 600, 300], confidence_threshold=70, page_limit=2)
    layer = spark.createDataFrame([(found["a.pdf"], 1, "own text"), (found["a.pdf"], 2, " ")], "doc_id string, page int, text string")
    cache, failures = ocr.read_documents(scanned, old, reader, settings, str(tmp_path / "work"), layer)
    read = {r.key: r.d for r in cache.select("key", files.from_payload(F.col("payload")).alias("d")).collect()}
    assert set(read) == {found[n] for n in ("a.pdf", "sub/b.pdf", "sub/deep/c.pdf", "g.pdf")}
    assert read[found["g.pdf"]].text == "from the cache" and read[found["g.pdf"]].text_source == "tesseract"
    a, b, c = (read[found[n]] for n in ("a.pdf", "sub/b.pdf", "sub/deep/c.pdf"))
    assert (a.text, a.text_source, [p.page_number for p in a.pages]) == ("own text\ngood 2 at 300", "pdfplumber+tesseract", [1, 2])
    assert (b.average_confidence, b.pages[0].dpi, b.text) == (85.0, 400, "poor 1 at 400\npoor 2 at 400")
    assert (c.average_confidence, c.pages[0].dpi, c.pages[0].tsv[0]["text"]) == (50.0, 300, "worse")
    assert [(r.doc_id, r.error) for r in failures.collect()] == [(found["d.pdf"], "ValueError: no document")]
    attempts = [spark.read.parquet(str(tmp_path / f"work/attempt-{n}")).select("doc_id").distinct().count() for n in range(3)]
    assert attempts == [4, 3, 2]  # the broken file is tried again, a sure one is not
    again, none = ocr.read_documents(scanned.where(F.col("doc_id") != found["d.pdf"]), cache, reader, settings, str(tmp_path / "work2"))
    assert again.count() == 4 and none.count() == 0


def test_no_page_beyond_the_limit_is_made_and_no_bytes_are_moved(spark, tmp_path):
    """A counting stub tells the pages that it makes; ranges of pages are read apart; the plan deals ids and paths alone."""
    (tmp_path / "in").mkdir()
    for name in ("a", "b", "broken"):
        (tmp_path / "in" / f"{name} č.pdf").write_text(name)
    log = str(tmp_path / "made")
    os.makedirs(log)

    def counting(content: bytes, settings: ocr.Settings):
        name = content.decode()
        for page in range(settings.first_page, 100):
            with open(f"{log}/{name}-{page}-{settings.first_page}", "w"):
                pass
            if name == "broken" and page == 6:
                raise ValueError("torn")
            yield page, f"{name} {page}", "", 1.0, settings.dpi, []

    narrow = files.fingerprinted(files.scan_files(spark, str(tmp_path / "in"))).select("doc_id", "path")
    read = ocr.read_pages(narrow, counting, ocr.Settings(page_limit=7, pages_each=3))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not any("content" in line for line in plan.splitlines() if "Exchange" in line)
    found = read.collect()
    assert sorted(r.page for r in found if r.text and r.text.startswith("a ")) == list(range(1, 8))
    assert sorted(os.listdir(log)) == sorted([f"{n}-{p}-{(p - 1) // 3 * 3 + 1}" for n in ("a", "b", "broken") for p in range(1, 8)])
    cache, failures = ocr.read_documents(narrow, spark.createDataFrame([], CACHE), counting, ocr.Settings(page_limit=7, pages_each=3), str(tmp_path / "work"))
    assert cache.count() == 2 and [r.error for r in failures.collect()] == ["ValueError: torn"]


def test_failures_reach_the_report(spark, tmp_path):
    rows = spark.createDataFrame([(2, "12345678", "12345678", None, None, None)], "row_index long, raw_value string, mb string, revenue long, assets long, capital_loss long")
    failures = spark.createDataFrame([("new", "ValueError: torn")], "doc_id string, error string")
    done = run(rows, *statements(spark), config=config.Config(as_of_year=2021), failures=failures)
    notes = done.report.first().notes
    assert "OCR failed for in/new.pdf: ValueError: torn" in notes and done.roster.first().revenue is None and done.roster.first().assets == 333


def test_settings_and_config(tmp_path):
    s = ocr.Settings(dpi="-5", page_limit="abc", confidence_threshold="0", dpi_retry="400")
    assert (s.dpi, s.page_limit, s.confidence_threshold, s.dpi_retry, s.at(400).dpi, s.at(400).dpi_retry) == (300, 30, None, [400], 400, [])
    path = tmp_path / "c.json"
    path.write_text('{"year_preference": "Prethodna", "overwrite_nonempty": "YES", "page_limit": "7", "dpi": 200}')
    c = config.load(str(path), year_preference=None)
    assert (c.year_preference, c.overwrite_nonempty, c.clear_on_overwrite, c.page_limit, c.options) == ("previous", True, False, 7, {"dpi": 200})
    assert config.load(str(path), year_preference="current").year_preference == "current"
    path.write_text("[1]")
    with pytest.raises(ValueError):
        config.load(str(path))


def test_regions_periods_words_and_text(spark):
    box = lambda *b: F.array(*[F.lit(float(x)) for x in b])
    row = spark.range(1).select(text.region(box(10, 20, 50, 60), 100, 80).alias("corners"), text.region(box(90, 70, 30, 40), 100, 80).alias("size"), text.region(box(-5, -5, 0, 0), 100, 80).alias("none")).first()
    assert (tuple(row.corners), tuple(row["size"])) == ((10, 20, 40, 40), (90, 70, 10, 10)) and row.none.left == 0 and row.none.width >= 1
    labels = spark.createDataFrame([(" Текућа ",), ("pret",), ("Q3",), ("  ",)], "t string").select(text.period_label(F.col("t")).alias("l"))
    assert [r.l for r in labels.collect()] == ["current", "previous", "q3", None]
    table = spark.createDataFrame([("d", 1, TSV.format("реч") + "5\t1\t1\n\n4\t1\t1\t1\t1\t1\tx\t0\t0\t0\t\t\n")], "doc_id string, page int, tsv string")
    read = tsv.words(tsv.parse(table)).collect()
    assert [(r.level, r.left, r.width, r.conf, r.text) for r in read] == [(5, 10, 30, "88", "реч"), (4, None, 0, "", "")]
    joined = document_text(spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("d", 3, None)], "doc_id string, page int, text string")).first()
    assert joined.text == "a\nb\n"


def test_bands(spark):
    layout = [[(10, "100:а 300:б"), (40, "104:в 310:г"), (70, "600:д")]]
    found = pages.bands_of(spark.createDataFrame(words_of("d", layout), WORDS)).first().bands
    assert [(b.left, b.right, b.text) for b in found] == [(100, 156, "а\nв"), (300, 362, "б\nг"), (600, 652, "д")]


def sheet_files(path) -> str:
    os.makedirs(path)
    (path / "part-1.csv").write_text("Назив;Матични број;ПОСЛОВНИ приходи (000  РСД);Место\nA;12345678;;Ниш\nB;;;Бор\n", encoding="utf-8")
    (path / "part-2.csv").write_text("Назив;Матични број;ПОСЛОВНИ приходи (000  РСД);Место\nC;00087654;19;Чачак\nD;11112222;;\n", encoding="utf-8")
    return str(path)


def test_rosters_keep_their_rows_and_columns(spark, tmp_path):
    path = sheet_files(tmp_path / "r.csv")
    raw = roster.sheet(spark, path)
    read = {r.row_index: (r.raw_value, r.mb, r.revenue, r.assets) for r in roster.from_table(raw).collect()}
    assert read == {2: ("12345678", "12345678", None, None), 3: (None, "", None, None), 4: ("00087654", "00087654", 19, None), 5: ("11112222", "11112222", None, None)}
    wide = spark.range(3000).select(F.col("id").alias("mb"), F.lit("x" * 100).alias("pad"))
    wide.coalesce(1).write.csv(str(tmp_path / "wide"), header=True, sep=";")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        numbered = roster.sheet(spark, str(tmp_path / "wide"))
        assert numbered.rdd.getNumPartitions() > 4
        assert {int(r.mb): r._row for r in numbered.select("mb", "_row").collect()} == {i: i + 2 for i in range(3000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    results = spark.createDataFrame([(2, 7, 8, 9)], "row_index long, revenue long, assets long, capital_loss long")
    full = roster.filled(raw, results)
    assert full.columns == ["_row", "Назив", "Матични број", RESULTS["revenue"], "Место", RESULTS["assets"], RESULTS["capital_loss"]]
    with pytest.raises(roster.UnsupportedRosterError):
        roster.sheet(spark, "old.xls")
    with pytest.raises(ValueError):
        roster.id_column(["Назив"])


def test_rosters_with_quoted_line_breaks(spark, tmp_path):
    """Rows are the sheet's rows, whatever is quoted in them and however the file is cut into blocks; written, they can be read again."""
    import csv

    os.makedirs(tmp_path / "r.csv")
    sheet = {}
    for part, count in (("part-1.csv", 400), ("part-2.csv", 30)):
        with open(tmp_path / "r.csv" / part, "w", encoding="utf-8", newline="") as f:
            writer = csv.writer(f, delimiter=";", lineterminator="\n")
            writer.writerow(["Назив", "Матични број", 'Опис "у\nдва реда"'])
            for i in range(count):
                name = [f"A{i}", f'"quoted" {i}', f"two\nlines {i}", f'a;b\n\n"c"\n{i}', "plain"][i % 5]
                row = [name, str(10_000_000 + len(sheet)), f"x{i}\n" * (i % 3) + "y" * (i % 90)]
                sheet[len(sheet) + 2] = tuple(c or None for c in row)
                writer.writerow(row)
                if i % 50 == 7:
                    f.write("\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert spark.read.text(str(tmp_path / "r.csv")).rdd.getNumPartitions() > 8
        raw = roster.sheet(spark, str(tmp_path / "r.csv"))
        assert raw.columns == ["_row", "Назив", "Матични број", 'Опис "у\nдва реда"']
        got = {r[0]: tuple(r[1:]) for r in raw.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sheet
    roster.write(raw, str(tmp_path / "again.csv"))
    again = {r[1]: tuple(r[1:]) for r in roster.sheet(spark, str(tmp_path / "again.csv")).select("_row", "Матични број", "Назив", 'Опис "у\nдва реда"').collect()}
    assert again == {v[1]: (v[1], v[0], v[2]) for v in sheet.values()}


def statements(spark) -> tuple:
    """Documents of two companies: an old and a new income statement, one balance sheet."""
    layouts = {
        "old": ("12345678 биланс успеха 2020", [[(25, NOW), (90, f"{REVENUE} 640:{{a}}")]], 111),
        "new": ("12345678 bilans uspeha 2021", [[(25, NOW), (90, f"{REVENUE} 640:{{a}}")]], 222),
        "bs": ("12345678 биланс стања 2021", [[(25, NOW), (60, f"{ASSETS} 640:{{a}}"), (120, f"{CAPITAL} 640:-70")]], 333),
        "lead": ("087654321 биланс успеха 2021", [[(25, NOW), (90, f"{REVENUE} 640:{{a}}")]], 444),
    }
    words = spark.createDataFrame([r for d, (_, p, a) in layouts.items() for r in words_of(d, p, amount=a)], WORDS)
    texts = spark.createDataFrame([(d, 1, t[0]) for d, t in layouts.items()], "doc_id string, page int, text string").withColumn("confidence", F.lit(90.0))
    docs = spark.createDataFrame([(d, f"in/{d}.pdf") for d in layouts], "doc_id string, path string").withColumn("mtime", F.lit("2022-01-01").cast("timestamp"))
    return docs, texts, words


def test_command_line(spark, tmp_path, capsys):
    for name, table in zip(("documents", "pages", "words"), statements(spark), strict=True):
        table.write.parquet(str(tmp_path / "ocr" / name))
    (tmp_path / "c.json").write_text('{"as_of_year": 2021}')
    argv = ["--config", str(tmp_path / "c.json"), "--roster", sheet_files(tmp_path / "r.csv"), "--documents", str(tmp_path / "ocr"), "--output", str(tmp_path / "out.csv"), "--report", str(tmp_path / "report"), "--work", str(tmp_path / "work")]
    assert main(argv, spark) == 0
    told = capsys.readouterr().out.splitlines()
    assert told[0] == "Processed 4 rows (3 with Матични број). Updated 1 rows, wrote 3 values (skipped 1 existing)." and told[1].startswith("Missing fields: revenue:1, assets:2")
    out = [r.asDict() for r in spark.read.csv(str(tmp_path / "out.csv"), header=True, sep=";").collect()]
    assert {(r["Назив"], r["Место"]) for r in out} == {("A", "Ниш"), ("B", "Бор"), ("C", "Чачак"), ("D", None)}
    first = next(r for r in out if r["Назив"] == "A")
    assert [first[h] for h in RESULTS.values()] == ["222", "333", "70"] and list(first)[2] == RESULTS["revenue"]
    parts = [p for p in os.listdir(tmp_path / "report") if p.endswith(".csv")]
    data = (tmp_path / "report" / parts[0]).read_bytes()
    lines = data.decode().split("\r\n")
    assert len(parts) == 1 and lines[0] == "MB;missing_bu;missing_bs;missing_fields;notes" and lines[-1] == ""
    assert lines[2] == "<missing>;no;no;;Excel row is missing Матични број"
    assert lines[4] == "11112222;yes;yes;assets,capital_loss,revenue;No BU PDF found for MB 11112222 | No BS PDF found for MB 11112222"
    assert "Multiple BU forms detected for MB 12345678" in lines[1] and "in/new.pdf, in/old.pdf" in lines[1]
    assert main([*argv[:3], str(tmp_path / "old.xls"), *argv[4:]], spark) == 2


def tsv_reader(content: bytes, settings: ocr.Settings):
    """A stub: a file holds its pages as JSON, text and word table."""
    for number, (said, tsv) in enumerate(json.loads(content), 1):
        yield number, said, tsv, 90.0, settings.dpi, []


def test_files_to_roster_in_one_command(spark, tmp_path, capsys):
    """The command reads files that it has not read yet, and gives what the run over tables of the same documents gives."""
    from .test_incremental import HEADER

    (tmp_path / "in").mkdir()
    docs, texts, words = statements(spark)
    said, rows = {r.doc_id: r.text for r in texts.collect()}, words.collect()
    for doc in said:
        tsv = HEADER + "".join("\t".join(map(str, (r.level, r.page, r.block, r.par, r.line, r.word, r.left, r.top, r.width, r.height, r.conf, r.text))) + "\n" for r in rows if r.doc_id == doc)
        (tmp_path / "in" / f"{doc}.pdf").write_text(json.dumps([[said[doc], tsv]]))
        os.utime(tmp_path / "in" / f"{doc}.pdf", (1_640_995_200, 1_640_995_200))
    (tmp_path / "in" / "torn.pdf").write_text("no json")
    (tmp_path / "c.json").write_text('{"as_of_year": 2021, "reader": "tests.test_engine:tsv_reader"}')
    argv = ["--config", str(tmp_path / "c.json"), "--roster", sheet_files(tmp_path / "r.csv"), "--files", str(tmp_path / "in"), "--output", str(tmp_path / "out.csv"), "--report", str(tmp_path / "report"), "--work", str(tmp_path / "work")]
    for again in (False, True):
        assert main(argv, spark) == 0
        told = capsys.readouterr().out.splitlines()
        assert told[0] == "Processed 4 rows (3 with Матични број). Updated 1 rows, wrote 3 values (skipped 1 existing)."
        first = next(r for r in spark.read.csv(str(tmp_path / "out.csv"), header=True, sep=";").collect() if r["Назив"] == "A")
        assert [first[h] for h in RESULTS.values()] == ["222", "333", "70"]
        listed = [r.path for r in spark.read.csv(str(tmp_path / "work/unclassified"), header=True).collect()]
        assert len(listed) == 1 and listed[0].endswith("torn.pdf")
        read = spark.read.parquet(str(tmp_path / "work/reading/todo")).count()
        assert read == (1 if again else 5)  # the torn file alone is tried again
    (tmp_path / "c.json").write_text('{"as_of_year": 2021}')
    assert main(argv, spark) == 2


@pytest.mark.parametrize(("overwrite", "clear", "want"), [(False, False, (1, 333, 70)), (True, False, (222, 333, 70)), (True, True, (222, 333, 70))])
def test_overwriting(spark, tmp_path, overwrite, clear, want):
    rows = spark.createDataFrame([(2, "12345678", "12345678", 1, None, None), (3, "87654321", "87654321", 5, 6, None)], "row_index long, raw_value string, mb string, revenue long, assets long, capital_loss long")
    done = run(rows, *statements(spark), config=config.Config(overwrite_nonempty=overwrite, clear_on_overwrite=clear, as_of_year=2021), work=str(tmp_path / "work"))
    found = {r.row_index: (r.revenue, r.assets, r.capital_loss) for r in done.roster.collect()}
    assert found[2] == want
    assert found[3] == ((5, 6, None) if not overwrite else (444, None, None) if clear else (444, 6, None))
    assert done.counters.first().rows_total == 2 and "WARNING" in done.report.where("row_index = 2").first().notes


@pytest.mark.parametrize("few", [256, 4])
def test_duplicate_notes_of_a_company_with_many_documents(spark, monkeypatch, few):
    monkeypatch.setattr(index, "FEW", few)
    rows = [("10000001", "bu", f"d/{i:03d}/a.pdf", 2000 + i * 7 % 13, i * 5 % 11) for i in range(60)] + [("10000002", "bs", "d/x.pdf", 2020, 1), ("10000003", "bu", "e/b.pdf", None, 2), ("10000003", "bu", "e/b.pdf", None, 2)]
    rows += [("10000004", "bs", "f/b.pdf", 2020, 1), ("10000004", "bs", "f/a.pdf", 2020, None)]
    entries = spark.createDataFrame(rows, "mb_key string, form_type string, path string, year int, t int").selectExpr("*", "struct(cast(null as string) as label, year) as period", "timestamp_seconds(t) as mtime")
    got = {(r.mb_key, r.form_type, r.ord): r.note.partition("Candidates: ")[2] for r in index.duplicate_notes(entries).collect()}
    want = {}
    for n in range(2, 61):
        held = sorted(rows[:n], key=lambda r: (-r[3], -r[4], r[2]))
        want["10000001", "bu", n] = ", ".join(r[2] for r in held)
    want["10000004", "bs", 2] = "f/a.pdf, f/b.pdf"  # a null time comes first
    assert got == want


def test_registrations_grow_with_the_documents_alone(spark):
    """100,000 documents of one company: a row each, numbered in both orders."""
    entries = spark.range(0, 100_000, 1, 4).selectExpr("'10000001' AS mb_key", "'bu' AS form_type", "concat('d/', lpad(id, 6, '0')) AS path", "struct(cast(null as string) as label, cast(2000 + id % 7 as int) as year) AS period", "timestamp_seconds(id % 1000) AS mtime")
    found = index.registrations(entries)
    told = found.agg(F.count("*"), F.sum("ord"), F.sum("place"), F.min("n"), F.max("n"), F.countDistinct("place")).first()
    assert tuple(told) == (100_000, 5_000_050_000, 5_000_050_000, 100_000, 100_000, 100_000)
    first = found.where("place = 1").first()
    number = int(first.path[2:])
    assert first.ord == number + 1 and (number % 7, number % 1000) == (6, 999)


def test_detectors_can_be_replaced(spark):
    docs = spark.createDataFrame([("p", "no. 77 profit", None)], "path string, text string, mtime timestamp")
    own = index.classify(docs, id_of=lambda t: F.regexp_extract(t, r"no\. (\d+)", 1), forms=lambda t: F.array(F.when(t.contains("profit"), "bu"))).first()
    assert (own.mb_key, own.forms) == ("77", ["bu"])


def test_words_stream_in(spark, tmp_path):
    _, _, words = statements(spark)
    words.repartition(3, "doc_id").write.parquet(str(tmp_path / "in"))
    seen = []
    query = ingest.process(ingest.stream_words(spark, str(tmp_path / "in"), 1), lambda df, n: seen.extend((n, r.doc_id) for r in pages.bands_of(df).collect()), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert sorted(d for _, d in seen) == ["bs", "lead", "new", "old"] and len({n for n, _ in seen}) > 1
