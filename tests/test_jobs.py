from pyspark.sql import functions as F

from marlstone import schema
from marlstone.config import ExtractionConfig
from marlstone.plans import jobs
from marlstone.sources import files


def layout(spark):
    spans, cells = [], []

    def line(doc, page, block, n, text, y, size=10.0, bold=False):
        spans.append((doc, page, 800.0, block, n, 0, text, size, bold, 50.0, float(y), 500.0, float(y) + 10))

    for p in range(4):
        line("d", p, 0, 0, f"Acme Annual Report {p + 1}", 20)
        line("d", p, 9, 0, f"The report page {p + 1}", 780)
    line("d", 0, 1, 0, "Item 1. Business", 100, 14.0, True)
    line("d", 0, 2, 0, "The company sells lamps and infor-", 130)
    line("d", 0, 2, 1, "mation. It has many shops in the north.", 142)
    line("d", 1, 1, 0, "Balance Sheet (in millions)", 100)
    line("d", 1, 2, 0, "Cash 120 100 inside the table", 205)
    line("d", 2, 1, 0, "Item 7. Results", 100, 14.0, True)
    line("d", 2, 2, 0, 'Results grew a lot in the year. Free Cash Flow ("FCF") was high and costs were low.', 130)
    line("d", 3, 1, 0, "Glossary of Terms", 100, 14.0, True)
    line("d", 3, 2, 0, "Margin: profit by sales. Debt: what is owed", 130)
    line("s", 0, 0, 0, "x", 100)
    for r, row in enumerate([["", "2018", "2017"], ["Cash", "$", "120", "$", "100"], ["Debt", "(50)", "(40)"]]):
        for c, cell in enumerate(row):
            cells.append(("d", 1, 0, r, c, cell, 40.0, 190.0, 510.0, 260.0))
    for r in range(3):  # prose that looks like a table
        cells.append(("d", 2, 0, r, 0, "only words", 40.0, 120.0, 510.0, 150.0))
    catalog = [("d", "l", "10k", "Acme", "2018"), ("s", "l", "10k", "Scan", "2018"), ("m", "l", "10k", None, None)]
    toc = spark.createDataFrame([], "doc_name string, level int, title string, page int, ord long")
    return spark.createDataFrame(spans, schema.LAYOUT_SPAN), spark.createDataFrame(cells, schema.TABLE_CELL), toc, spark.createDataFrame(catalog, schema.CATALOG)


def test_layout_to_answers(spark, tmp_path):
    spans, cells, toc, catalog = layout(spark)
    corpus = jobs.build_corpus(spans, cells, toc, catalog, ExtractionConfig(min_chunk_tokens=4))
    chunks = corpus.chunks.orderBy("chunk_index").collect()
    assert [c.chunk_type for c in chunks] == ["narrative", "table", "narrative", "narrative"]
    assert chunks[0].text.startswith("Item 1. Business") and "information. It has" in chunks[0].text and "Annual Report" not in chunks[0].text and chunks[0].section_id == "item_1"
    assert chunks[0].text.endswith("Balance Sheet (in millions)") and chunks[0].page_end == 1
    assert chunks[1].text.startswith("Balance Sheet (in millions) (Acme, 2018, in millions)\n\n| Line Item | 2018 | 2017 |") and chunks[1].structured.table_id == "d__table001"
    assert [r.value for r in chunks[1].structured.rows] == [120.0, 100.0, -50.0, -40.0] and chunks[1].structured.row_range == [0, 1]
    assert chunks[2].section_id == "item_7" and chunks[3].section == "Glossary of Terms"
    assert chunks[1].prev_chunk_id == chunks[0].chunk_id == "d__p0000__c0000" and chunks[3].next_chunk_id is None
    terms = {(r.term, r.definition, r.pattern_type) for r in corpus.glossary.collect()}
    assert terms == {("FCF", "Results grew a lot in the year. Free Cash Flow", "paren_abbr"), ("Margin", "profit by sales", "glossary_section_line"), ("Debt", "what is owed", "glossary_section_line")}
    report = {r.doc_name: (r.status, r.n_chunks_narrative, r.n_chunks_table, r.n_glossary_entries) for r in corpus.report.collect()}
    assert report == {"d": ("ok", 3, 1, 3), "s": ("likely_scanned_or_image", None, None, None), "m": ("source_missing", None, None, None)}

    files.write_jsonl(corpus.chunks, str(tmp_path / "chunks"))
    back = files.read_chunks(spark, str(tmp_path / "chunks"))
    index = jobs.build_index(back)
    asked = spark.createDataFrame([(1, "d", "what does the company sell", "The company sells lamps", [("lamps",)])], "query_id int, doc_name string, question string, answer string, evidence array<struct<evidence_text:string>>")
    answers = jobs.answer_questions(asked, back, index, 2)
    means, samples = jobs.evaluate(answers)
    one = samples.first()
    assert one.retrieved_passages[0].chunk_id == "d__p0000__c0000" and one.token_f1 > 0 and one.context_precision > 0 and means.first().n_samples == 1


def test_contents_give_sections(spark):
    spans, cells, _, catalog = layout(spark)
    toc = spark.createDataFrame([("d", 1, "Part A", 2, 0), ("d", 2, "Sub", 3, 1), ("d", 1, "Part B", 4, 2)], "doc_name string, level int, title string, page int, ord long")
    corpus = jobs.build_corpus(spans, cells, toc, catalog, ExtractionConfig(min_chunk_tokens=4))
    got = [(c.section, c.page_start) for c in corpus.chunks.orderBy("chunk_index").collect()]
    assert got == [(None, 0), ("Part A", 1), ("Part A", 2)]  # no flush where the contents change


def test_whole_run(spark, tmp_path):
    """Index, answers and report below one folder; a second run of answers is appended."""
    from marlstone.operators.vectors import VectorStore

    chunks = spark.createDataFrame([(f"c{i}", "d", i, i, t, "narrative") for i, t in enumerate(["red apples are sweet.", "green pears grow.", "blue plums"])], "chunk_id string, doc_name string, chunk_index int, page_start int, text string, chunk_type string")
    chunks = chunks.withColumns({c: F.lit(None).cast("string") for c in ("doc_type", "company", "doc_period")})
    asked = spark.createDataFrame([(i, "d", q, a, [(a,)]) for i, (q, a) in enumerate([("what grows", "green pears grow."), ("what is sweet", "red apples")])], "query_id int, doc_name string, question string, answer string, evidence array<struct<evidence_text:string>>")
    path = str(tmp_path / "run")
    means, samples = jobs.two_step(spark, chunks, asked, path, limit=2, k=2)
    assert means.first().n_samples == 2 and means.first().token_f1 > 0 and means.first().total_inference_time_s >= 0
    import json

    told = json.load(open(f"{path}/report/report.json"))["aggregate"]
    assert told["n_samples"] == 2 and spark.read.json(f"{path}/report/per_sample").count() == 2 and json.load(open(f"{path}/manifest.json"))["n_chunks"] == 3
    index = VectorStore(spark, f"{path}/vectors").table()
    assert jobs.answer_driver(asked, chunks, index, f"{path}/answers", 1).count() == 3
    rate = jobs.encoding_rate(chunks)
    assert rate["n_chunks"] == 3 and rate["chunks_per_s"] > 0 and rate["of"](6) > 0


def test_shown(spark):
    hits = spark.createDataFrame([(1, 1, 0.123456, "d", 0, "a\n" + "b" * 300)], "query_id int, rank int, score double, doc_name string, page_start int, text string")
    r = jobs.shown(hits).first()
    assert r.score == 0.1235 and len(r.text) == 203 and r.text.startswith("a b") and r.text.endswith("...")
    assert hits.select(F.count("rank")).first()[0] == 1


def test_report_and_neighbours_come_from_the_fold(spark):
    """Neither counts nor neighbours' ids need the texts of chunks once more in the order of their documents."""
    spans, cells, toc, catalog = layout(spark)
    corpus = jobs.build_corpus(spans, cells, toc, catalog, ExtractionConfig(min_chunk_tokens=4))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan(corpus.report.drop("n_glossary_entries")) and "lag(" not in plan(corpus.chunks)


def test_linked_chunks():
    from marlstone.operators.chunking import linked_chunks

    made = [{"chunk_index": i, "page_start": i // 2, "chunk_type": t} for i, t in enumerate(["narrative", "table", "narrative", "table"])]
    got = linked_chunks("d", made)
    assert [c["k"] for c in got] == [None, 1, None, 2]
    assert [c["prev_chunk_id"] for c in got] == [None, "d__p0000__c0000", "d__p0000__c0001", "d__p0001__c0002"]
    assert [c["next_chunk_id"] for c in got] == ["d__p0000__c0001", "d__p0001__c0002", "d__p0001__c0003", None] and linked_chunks("d", []) == []
