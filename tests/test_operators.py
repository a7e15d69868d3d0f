import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.config import ExtractionConfig, RetrievalConfig
from marlstone.operators import answering, chunking, glossary, layout, metrics, retrieval, tables, vectors


@pytest.mark.parametrize("sizes,groups", [([4, 4, 4, 4], [(0, 2), (1, 3), (2, 4)]), ([6, 6], [(0, 1), (1, 2)]), ([3, 20, 3], [(0, 1), (0, 2), (2, 3)]), ([], [])])
def test_pack(sizes, groups):
    assert chunking.pack(sizes, 10, 4) == groups


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(1, 40), st.integers(0, 12))
def test_pack_covers_in_order(sizes, limit, overlap):
    groups = chunking.pack(sizes, limit, overlap)
    assert [i for s, e in groups for i in range(s, e)][:1] == [0][: len(sizes)]
    for (s, e), (s2, e2) in zip(groups, groups[1:]):
        assert s <= s2 <= e < e2 or (s2 <= e and e2 > e)
        assert sum(sizes[s2:e]) <= overlap
    assert not groups or groups[-1][1] == len(sizes)
    for s, e in groups:
        assert sum(sizes[s : e - 1]) <= limit or sum(sizes[s : e - 1]) <= overlap


def _run(spark, events):
    rows = [{"kind": k, "page": i, "section": "s", "section_id": "s", "text": " ".join(["w"] * n) if n else None, "n": 1} for i, (k, n) in enumerate(events)]
    df = spark.createDataFrame([("d", rows)], f"doc string, events array<{chunking.EVENT}>")
    config = ExtractionConfig(min_chunk_tokens=5)
    return [(r.chunk_type, r.n_tokens, r.page_start, r.page_end) for r in chunking.flush_chunks(df, "doc", "events", config).orderBy("chunk_index").collect()]


def test_flush(spark):
    assert _run(spark, [("para", 2), ("table", 1), ("para", 8)]) == [("table", 1, 1, 1), ("narrative", 10, 0, 2)]
    assert _run(spark, [("para", 8), ("table", 1), ("para", 2)]) == [("narrative", 8, 0, 0), ("table", 1, 1, 1), ("narrative", 2, 2, 2)]
    assert _run(spark, [("para", 8), ("flush", 0), ("para", 2)]) == [("narrative", 10, 0, 2)]
    assert _run(spark, [("para", 2)]) == [("narrative", 2, 0, 0)]
    assert [c[0] for c in _run(spark, [("table", 1), ("table", 1)])] == ["table", "table"]


def plain_flush(events, config):
    """Each group on its own, by the four rules: large enough, joined to narrative before it, held, forced."""
    done, held, buffer = [], [], []

    def close(end):
        nonlocal held, buffer
        units, buffer, pending = held + buffer, [], []
        held = []
        ranges = chunking.pack([len(p["text"].split()) for p in units], config.chunk_size, config.chunk_overlap)
        for at, (s, e) in enumerate(ranges):
            both = pending + units[s:e]
            text = "\n\n".join(p["text"] for p in both)
            if len(text.split()) >= config.min_chunk_tokens or (not (done and done[-1][0] == "narrative") and end and at == len(ranges) - 1):
                done.append(["narrative", text, both[0]["page"], both[-1]["page"], units[s]["section"]])
                pending = []
            elif done and done[-1][0] == "narrative":
                done[-1][1] += "\n\n" + text
                done[-1][3] = both[-1]["page"]
                pending = []
            else:
                pending = both
        held = pending

    for e in events:
        if e["kind"] == "para":
            buffer.append(e)
        else:
            close(False)
            if e["kind"] == "table":
                done.extend(["table", e["text"], e["page"], e["page"], e["section"]] for _ in range(e["n"]))
    close(True)
    return done


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["para", "para", "para", "flush", "table"]), st.integers(1, 14)), max_size=40), st.integers(5, 25), st.integers(0, 8), st.integers(1, 12))
def test_flush_equals_plain_rules(kinds, size, overlap, least):
    events = [{"kind": k, "page": i, "section": f"s{i}", "section_id": f"s{i}", "text": " ".join([f"w{i}"] * n), "n": n % 3} for i, (k, n) in enumerate(kinds)]
    config = ExtractionConfig(chunk_size=size, chunk_overlap=overlap, min_chunk_tokens=least)
    got = chunking.flush_events(events, config)
    assert [[c["chunk_type"], c["text"], c["page_start"], c["page_end"], c["section"]] for c in got] == plain_flush(events, config)
    assert all(c["n_tokens"] == len(c["text"].split()) for c in got)


def test_flush_failures_stay_with_their_document(spark):
    rows = [("good", [("para", 0, "s", "s", "a b", 1)]), ("bad", [("para", 0, "s", "s", None, 1)])]
    df = spark.createDataFrame(rows, f"doc string, events array<{chunking.EVENT}>")
    got = {r.doc: r for r in chunking.flush_chunks(df, "doc", "events", errors=True).collect()}
    assert got["good"].error is None and got["good"].text == "a b" and "Error" in got["bad"].error and got["bad"].chunk_id is None


@pytest.mark.parametrize("chars,block", [(1 << 22, 1 << 24), (0, 1 << 24), (0, 10)])
def test_terms_as_whole_words(spark, monkeypatch, chars, block):
    """Every kind of term against every text, as one regular expression each; dictionaries sent to tasks, or met in blocks."""
    import regex

    monkeypatch.setattr(glossary, "DICTIONARY_CHARS", chars)
    monkeypatch.setattr(glossary, "BLOCK_CHARS", block)

    texts = ["a/b costs", "net income (EBIT) and ebit", "Net-income, net  income", "über alles überall", "-- dashes --", "", None, "C++ and C", "x_y y"]
    terms = ["a/b", "EBIT", "net income", "Net", "über", "--", "C++", "C", "x_y", "y", "income"]
    t = spark.createDataFrame([(i, "d", x) for i, x in enumerate(texts)] + [(99, "other", "EBIT")], "i int, doc_name string, text string")
    e = spark.createDataFrame([("d", k, x, f"def {x}") for k, x in enumerate(terms)] + [("d", 50, "EBIT", "later")], "doc_name string, ord int, term string, definition string")
    got = {(r.i, r.term, r.definition) for r in glossary.match_terms(t, e, ["i"]).collect()}
    assert got == {(i, x, f"def {x}") for i, text in enumerate(texts) for x in terms if text and regex.search(rf"\b{regex.escape(x)}\b", text)}


def test_neighbours(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", i, "t") for i in range(4)], "chunk_id string, doc_name string, chunk_index int, text string")

    def near(at, w):
        hits = spark.createDataFrame([(1, 1, "d", at)], "query_id int, rank int, doc_name string, chunk_index int")
        return [r.neighbor_id for r in retrieval.neighbours(hits, chunks, w).orderBy("offset").collect()]

    assert near(0, 1) == ["c1"] and near(1, 1) == ["c0", "c2"] and near(3, 1) == ["c2"] and near(1, 2) == ["c0", "c2", "c3"] and near(9, 1) == [] and near(1, 0) == []
    linked = {r.chunk_id: r for r in chunking.link_neighbors(chunks).collect()}
    assert linked["c0"].prev_chunk_id is None and all(linked[linked[c].prev_chunk_id].next_chunk_id == c for c in ("c1", "c2", "c3"))


def test_metrics(spark):
    rows = [("The U.S.", "the us"), ("", ""), ("a b b", "b b c"), ("x", "y")]
    df = spark.createDataFrame(rows, "p string, g string")
    got = df.select(metrics.exact_match(F.col("p"), F.col("g")), F.round(metrics.token_f1(F.col("p"), F.col("g")), 6)).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0), (1.0, 0.0), (0.0, 0.666667), (0.0, 0.0)]
    passages = F.array(F.lit("the x"), F.lit("y"))
    one = spark.range(1).select(metrics.context_precision(passages, F.lit("the cash")), metrics.context_precision(passages, F.lit(""))).first()
    assert tuple(one) == (0.5, 0.0)


def test_lcs_two_ways(spark):
    random.seed(3)
    rows = [(i, [random.choice("abc") for _ in range(random.randint(0, 9))], [random.choice("abc") for _ in range(random.randint(0, 9))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = step(row, x, b)
        return row[-1]

    def step(before, x, b):
        out = [0]
        for i, y in enumerate(b):
            out.append(before[i] + 1 if x == y else max(before[i + 1], out[i]))
        return out

    assert all(r.n == plain(r.a, r.b) for r in df.select("a", "b", metrics.lcs_lengths(F.col("a"), F.col("b")).alias("n")).collect())


def test_rollup_and_dedupe(spark):
    e = spark.createDataFrame([("A", 1, "FCF", "free cash flow"), ("B", 1, "fcf", "Free cash flow"), ("A", 2, "fcf", "FREE CASH FLOW")], "doc_name string, ord int, term string, definition string")
    kept = glossary.dedupe_entries(e, "doc_name", ["ord"])
    assert kept.count() == 2 and glossary.dedupe_entries(kept, "doc_name", ["ord"]).count() == 2
    r = glossary.rollup(kept).first()
    assert (r.term, r.definitions, r.doc_count, r.example_doc) == ("fcf", ["Free cash flow", "free cash flow"], 2, "A")


def test_glossary_forms(spark):
    text = 'Our "Adjusted Income" means income before tax. Free Cash Flow ("FCF") grew. "EBIT" as used herein, refers to earnings.. Acme (ACME) fell.'
    df = spark.createDataFrame([(1, text, "Results"), (2, "Alpha: first thing. Beta – second thing", "GLOSSARY of terms")], "i int, text string, section string")
    got = [(r.term, r.definition, r.pattern_type) for r in glossary.glossary_entries(df, ["i"]).orderBy("i", "pattern_ord", "match_ord").collect()]
    assert ("Adjusted Income", "income before tax", "quoted_defines") in got and ("FCF", "Free Cash Flow", "paren_abbr") in got and ("EBIT", "earnings", "abbr_means") in got
    assert ("Alpha", "first thing", "glossary_section_line") in got and not any(g[0] == "ACME" for g in got)


def test_table_chunks(spark):
    rows = [(1, 0, ["", "2018", "2017"]), (1, 1, ["Cash", "$", "120", "$", "100"]), (1, 2, ["Debt", "(50)", "(40)"]), (1, 3, ["Assets", ""])]
    cells = tables.cell_records(tables.parsed_rows(spark.createDataFrame(rows, "t int, row_no int, cells array<string>")), ["t"])
    assert sorted(r.value for r in cells.collect()) == [-50.0, -40.0, 100.0, 120.0]
    title, unit = tables.title_and_unit(F.lit("Balance Sheet (in millions)"))
    facts = spark.range(1).select(F.lit(1).alias("t"), title.alias("title"), unit.alias("unit"), F.lit("Acme").alias("company"), F.lit("2018").alias("period"))
    one = tables.table_chunks(cells, facts, ["t"]).first()
    assert (one.first_label, one.last_label) == (0, 1)
    assert one.text == "Balance Sheet (in millions) (Acme, 2018, in millions)\n\n| Line Item | 2018 | 2017 |\n| --- | --- | --- |\n| Cash | $120 | $100 |\n| Debt | (50) | (40) |"
    said = tables.table_chunks(cells, facts, ["t"], "sentences").first().text.split("\n")[1:]
    assert said == ["Cash, 2018: $120", "Cash, 2017: $100", "Debt, 2018: (50)", "Debt, 2017: (40)"]
    many = spark.createDataFrame([(1, i, [f"L{i}", "12"]) for i in range(7)], "t int, row_no int, cells array<string>")
    groups = tables.table_chunks(tables.cell_records(tables.parsed_rows(many), ["t"]), facts, ["t"]).orderBy("group_no").collect()
    assert [(g.first_label, g.last_label) for g in groups] == [(0, 4), (5, 6)]


def test_layout(spark):
    spans = [("d", p, 800.0, 0, 0, s, t, 10.0, b, 0.0, 20.0, 9.0, 30.0) for p in range(5) for s, (t, b) in enumerate([("Acme ", False), (f"Report {p}", True), ("  ", False)])]
    names = "doc_name string, page int, page_height double, block int, line int, span int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double"
    lines = layout.lines_of_spans(spark.createDataFrame(spans, names))
    assert {r.text for r in lines.collect()} == {f"Acme Report {p}" for p in range(5)} and lines.where("not bold").count() == 0
    margin = lines.where(layout.in_margin(F.col("y0"), F.col("page_height")))
    keys = layout.boilerplate_keys(margin, spark.createDataFrame([("d", 5)], "doc_name string, n_pages int"))
    assert [(r.key, r.n) for r in keys.collect()] == [("acme report", 5)] and layout.without_boilerplate(lines, keys).count() == 0
    assert layout.body_size(lines, lines).first().body_size == 10.0
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    got = spark.range(1).select(layout.overlap_share(box(0, 0, 10, 10), box(0, 0, 10, 6)), layout.overlap_share(box(0, 0, 10, 10), box(0, 0, 10, 5))).first()
    assert tuple(got) == (0.6, 0.5)
    toc = spark.createDataFrame([("d", 1, "Item 1. A", 1, 0), ("d", 1, "Early", 3, 1), ("d", 1, "Late", 3, 2), ("d", 2, "Sub", 4, 3), ("d", 1, "Bad", -1, 4)], "doc_name string, level int, title string, page int, ord long")
    pages = spark.createDataFrame([("d", i) for i in range(4)], "doc_name string, page int")
    assert [r.section for r in layout.toc_sections(toc, pages).orderBy("page").collect()] == ["Item 1. A", "Item 1. A", "Late", "Late"]
    blocks = spark.createDataFrame([("d", 0, 5.0, 0), ("d", 0, 1.0, 1)], "doc_name string, page int, y0 double, block int")
    found = spark.createDataFrame([("d", 0, 5.0, 0)], "doc_name string, page int, y0 double, table_no int")
    assert [(r.kind, r.ord) for r in layout.page_items(blocks, found, ["doc_name", "page"]).orderBy("item").collect()] == [(0, 1), (0, 0), (1, 0)]


def test_vector_search(spark, tmp_path):
    random.seed(5)
    rows = [(i, f"d{i % 3}", [random.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    v = spark.createDataFrame(rows, "id long, doc_name string, vector array<double>")
    q = v.where("id < 20").withColumnRenamed("id", "query_id")
    want = {}
    for i, _, a in rows[:20]:
        want[i] = [x for _, x in sorted((-round(sum(p * w for p, w in zip(a, b)), 6), j) for j, _, b in rows)[:5]]
    for found in (vectors.exact_top_k(q, v, 5), vectors._blocked_top_k(q, v, 5, "query_id", "id", 64)):
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, []).append((r.score, -r.id))
        assert {k: [-i for _, i in sorted(x, reverse=True)[:5]] for k, x in got.items()} == want
    scoped = vectors.exact_top_k(q, v, 3, scope="doc_name").join(v.select("id", F.col("doc_name").alias("d")), "id").join(q.select("query_id", "doc_name"), "query_id")
    assert scoped.where("d <> doc_name").count() == 0 and scoped.count() == 60
    store = vectors.VectorStore(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError):
        store.table()
    with pytest.raises(ValueError):
        vectors.VectorStore(spark, "x", "other")
    store.add(v)
    store.add(v)
    assert store.count() == 400
    store.add(v, overwrite=True)
    store.upsert(v.where("id < 3").withColumn("doc_name", F.lit("new")).union(v.where("id = 3").withColumn("id", F.lit(900).cast("long"))))
    assert store.count() == 201 and store.table().where("doc_name = 'new'").count() == 3
    store.add(v, overwrite=True)
    assert store.count() == 200 and store.query(q, 2, where=F.col("doc_name") == "none").count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e-4, 1e18])
def test_best_rows_by_blocks(monkeypatch, scale):
    """Against all pairs: ties, copies, halves that are rounded, lists of few rows, and sizes that single precision can't hold."""
    import numpy as np

    from marlstone.operators import ranking

    monkeypatch.setattr(ranking, "CELLS", 900)
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=(300, 8)), np.round(rng.normal(size=(300, 8)) * 8) / 16]) * scale
    v[400:420] = v[3]
    q, ids = v[::7], rng.permutation(len(v))
    exact = ranking.rounded(np.cumsum(q[:, None] * v[None], axis=2)[:, :, -1])
    best, some = ranking.Best(q, 5), np.arange(0, len(q), 2)
    for i in range(0, 500, 50):
        best.take(v[i : i + 50], ids[i : i + 50])
    best.take(v[500:], ids[500:], some)
    got: dict = {}
    for at, score, k in zip(*(x.tolist() for x in best.rows())):
        got.setdefault(at, []).append((-score, k))
    for j in range(len(q)):
        n = len(v) if j % 2 == 0 else 500
        assert sorted(got[j]) == sorted((-exact[j, i].item(), ids[i].item()) for i in range(n))[:5]
    assert ranking.rounded(np.array([0.0078125, -0.0078125, 2.5e-7])).tolist() == [0.007813, -0.007813, 0.0]


def shuffled(spark) -> int:
    """Rows shuffled by the session so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("backend", ["exact", "ivf"])
def test_many_queries_are_not_copied_for_each_block(spark, monkeypatch, backend):
    """Queries beyond one broadcast: the rows shuffled are a few for each query and task."""
    import numpy as np

    from marlstone.operators import ivf

    n = 9000
    monkeypatch.setattr(ivf, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(n)], "id long, vector array<double>")
    before = shuffled(spark)
    made = vectors.BACKENDS[backend](v.withColumnRenamed("id", "query_id"), v, 2, **({"scan": 0.5, "lists": 32} if backend == "ivf" else {}))
    assert len(made.collect()) == 2 * n and shuffled(spark) - before < 25 * n
    assert "CoGroups" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["backend_recall", "vector_store", "knn_topk", "ablate_k", "resolve_hits"])
def test_queries_in_rounds(spark, sf_dir, monkeypatch, name):
    """With queries that no broadcast takes: the rows of the SQL, and few rows shuffled."""
    from marlstone.operators import ivf, ranking
    from marlstone.plans.registry import ORACLE, QUERIES
    from tests.oracle import connect, spark_rows, sql_rows

    monkeypatch.setattr(ivf, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(ranking, "ROUND_BYTES", 150_000)
    before = shuffled(spark)
    made = QUERIES[name](spark, sf_dir)
    assert spark_rows(made) == sql_rows(connect(sf_dir), ORACLE[name])
    assert shuffled(spark) - before < 100 * 500 and "CoGroups" not in made._jdf.queryExecution().executedPlan().toString()


def test_search_and_answers(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", i, i, t) for i, t in enumerate(["red apples are sweet.", "green pears. they grow slowly.", "blue plums"])], "chunk_id string, doc_name string, chunk_index int, page_start int, text string")
    asked = spark.createDataFrame([(1, "d", "how do they grow", "they grow slowly.")], "query_id int, doc_name string, question string, ground_truth string")
    terms = spark.createDataFrame([("d", 1, "pears", "a fruit"), ("d", 2, "pear", "no")], "doc_name string, ord int, term string, definition string")
    hits = retrieval.search(asked, chunks, 2, glossary=terms)
    top = hits.where("rank = 1").first()
    assert top.chunk_id == "c1" and [n.neighbor_id for n in top.neighbors] == ["c0", "c2"] and [t.term for t in top.glossary_matches] == ["pears"]
    assert RetrievalConfig().k(0) == 5 and RetrievalConfig().k(None) == 5 and RetrievalConfig().k(2) == 2
    answers = answering.answer_records(asked, hits).withColumn("ground_truth_evidence", F.lit("pears"))
    one = metrics.per_sample(answers).first()
    assert one.generated_answer == "they grow slowly." and one.exact_match == 1.0 and one.token_f1 == 1.0 and one.rougeL == 1.0 and one.context_precision == 0.5
    report = metrics.aggregate_report(metrics.per_sample(answers)).first()
    assert report.n_samples == 1 and report.token_f1 == 1.0
    assert metrics.aggregate_report(metrics.per_sample(answers.limit(0))).first().token_f1 == 0.0
    assert "[Passage 1] (doc=d, page=1)" in one.prompt


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_inverted_lists_recall(spark, sf):
    """Of the registered query, and without each query's own row, which always hits."""
    from marlstone.plans.registry import QUERIES

    r = QUERIES["ablate_backend"](spark, f"/root/testdata/{sf}").selectExpr("avg(recall) r", "avg((n_found - 1) / (n_exact - 1)) other").first()
    print(sf, r)
    assert r.r >= 0.9 and r.other >= 0.9


@pytest.mark.parametrize("bytes_", [1 << 23, 0])
def test_inverted_lists_of_few_and_repeated_vectors(spark, monkeypatch, bytes_):
    from marlstone.operators import ivf
    from marlstone.operators.vectors import exact_top_k, ivf_top_k

    monkeypatch.setattr(ivf, "BROADCAST_BYTES", bytes_)
    rows = [(i % 50, [float(i % 7), float(i % 5) - 2, 1.0]) for i in range(60)] + [(99, None)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    q = v.where("id < 9").withColumnRenamed("id", "query_id").dropDuplicates(["query_id"])
    want = sorted(map(tuple, exact_top_k(q, v, 4).collect()))
    assert sorted(map(tuple, ivf_top_k(q, v, 4, scan=1.0).collect())) == want and len(want) == 36
    assert ivf_top_k(q, v.limit(2), 4).count() > 0 and ivf_top_k(q, v.limit(0), 4).count() == 0


def test_index_is_kept_and_pruned(spark, tmp_path):
    """Built once; a query opens the files of its parts only, and looks at the codes of a tenth of the rows."""
    import numpy as np

    rng = np.random.default_rng(4)
    tops = rng.normal(size=(40, 32))
    rows = [(i, i % 3, [float(x) for x in tops[i % 40] + 0.25 * rng.normal(size=32)]) for i in range(4000)]
    store = vectors.VectorStore(spark, str(tmp_path / "v"), "ivf")
    store.add(spark.createDataFrame(rows, "id long, kind int, vector array<double>"))
    index = store.index(lists=200, parts=40)
    assert store.index().folder.path == index.folder.path and index.told["rows"] == 4000 and index.told["version"] == 1
    one = store.table().where("id = 7").withColumnRenamed("id", "query_id")
    probed = index.probes(one, 0.1)
    assert probed.first().scanned <= 400
    plan = index.candidates(probed, 64)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan
    parts = {r.part for r in index.table().where(F.col("list").isin(probed.first().lists)).select("part").distinct().collect()}
    files = index.table().where(F.col("part").isin(sorted(parts))).select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 0.5 * len(index.table().inputFiles())
    many = store.table().where("id % 50 = 0").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.id) for r in index.search(many, 5, scan=0.1).collect()}
    want = {(r.query_id, r.id) for r in vectors.exact_top_k(many, store.table(), 5).collect()}
    assert len(got & want) >= 0.9 * len(want)
    only = store.query(many, 5, where=F.col("kind") == 1)
    assert {r.id % 3 for r in only.select("id").collect()} == {1}
    store.upsert(spark.createDataFrame([(7, 5, [9.0] * 32)], "id long, kind int, vector array<double>"))
    assert store.index().told["version"] == 2 and store.query(one, 1, where=F.col("kind") == 5).first().id == 7


def test_blocks_and_tables_of_a_crowded_page(spark):
    """A page of 10^5 blocks and 10^4 tables: only what shares a tile is compared, and the result is that of all pairs."""
    import time

    import numpy as np

    rng = np.random.default_rng(1)

    def boxes(n, w, h, page):
        x, y = rng.uniform(0, 5000, n), rng.uniform(0, 5000, n)
        return [(page, i, float(a), float(b), float(a + c), float(b + d)) for i, (a, b, c, d) in enumerate(zip(x, y, rng.uniform(1, w, n), rng.uniform(1, h, n)))]

    kind = "page int, block int, x0 double, y0 double, x1 double, y1 double"
    small = boxes(400, 300, 300, 1) + [(1, 1000, 1.0, 1.0, 1.0, 1.0), (1, 1001, None, 1.0, 2.0, 2.0), (2, 1, 0.0, 0.0, 1.0, 1.0)]
    over = boxes(60, 900, 900, 1) + [(3, 1, 0.0, 0.0, 9.0, 9.0)]

    def covered(a, b):
        if None in a or (a[4] - a[2]) * (a[5] - a[3]) <= 0:
            return False
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        return w > 0 and h > 0 and w * h / ((a[4] - a[2]) * (a[5] - a[3])) > 0.5

    got = {(r.page, r.block) for r in layout.blocks_outside_tables(spark.createDataFrame(small, kind), spark.createDataFrame(over, kind), on=("page",)).collect()}
    assert got == {a[:2] for a in small if not any(a[0] == b[0] and covered(a, b) for b in over)}
    many, tables_ = spark.createDataFrame(boxes(100_000, 20, 10, 1), kind), spark.createDataFrame(boxes(10_000, 60, 40, 1), kind)
    began = time.time()
    left = layout.blocks_outside_tables(many, tables_, on=("page",)).count()
    assert 0 < left < 100_000 and time.time() - began < 60


def test_chunk_store_reads_the_buckets_of_its_documents(spark, tmp_path):
    from marlstone.sources.files import ChunkStore

    store = ChunkStore(spark, str(tmp_path / "c"), buckets=16)
    rows = [(f"d{i % 50}__c{i}", f"d{i % 50}", f"text {i}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_name string, text string, at int")
    store.put(df)
    store.put(spark.createDataFrame([("d7__c7", "d7", "new", 1), ("d7__c7", "d7", "newer", 2), ("d7__c57", "d8", "moved", 3)], df.schema), order="at")
    hits = spark.createDataFrame([("d7", "d7__c7", 1), ("d7", "none", 2), ("d8", "d7__c57", 3)], "doc_name string, chunk_id string, rank int")
    assert {(r["rank"], r.text) for r in store.resolve(hits).collect()} == {(1, "newer"), (3, "moved")}
    found = store.of(hits.select("doc_name"))
    assert found.count() == 20 and store.read().count() == 500
    assert len(found.inputFiles()) <= 4 < len(store.read().inputFiles())
    assert "In(doc_name" in found._jdf.queryExecution().executedPlan().toString()


def test_shared_words_of_long_answers(spark):
    """Equal to counting, and linear: two answers of 100,000 words."""
    import time
    from collections import Counter

    random.seed(3)
    rows = [([random.choice("abcd") for _ in range(random.randint(0, 12))], [random.choice("abce") for _ in range(random.randint(0, 12))]) for _ in range(300)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in df.select("a", "b", metrics.shared_count(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n == sum((Counter(r.a) & Counter(r.b)).values())
    counted = lambda m: F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: (i % m).cast("string"))
    long = spark.range(1).select(counted(70_001).alias("a"), counted(90_001).alias("b"))
    began = time.time()
    assert long.select(metrics.shared_count(F.col("a"), F.col("b")).alias("n")).first().n == sum((Counter(i % 70_001 for i in range(1, 100_001)) & Counter(i % 90_001 for i in range(1, 100_001))).values())
    assert time.time() - began < 20


def test_alignment_of_real_vectors(spark):
    """Greedy alignment by a model whose vectors are not one-hot, with weights and baseline, against the plain sums."""
    import math

    import numpy as np

    def load():
        return lambda texts: [[float(len(t)), float(ord(t[0]) % 7), 1.0] for t in texts]

    model = vectors.ModelEmbedder("lengths", load, batch=3)
    pairs = [("the red apple", "a red pear"), ("", "gold"), ("word", None), ("!!!", "gold"), ("x x y", "x")] + [(f"w{i} " * 700, f"v{i} w{i}") for i in range(3)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, pred string, gold string")
    words = lambda t: [w for w in (t if t and t.strip() else "N/A").lower().translate(str.maketrans("", "", "!/")).split()]
    unit = lambda w: np.array(load()([w])[0]) / np.linalg.norm(load()([w])[0])
    golds = [set(words(g)) for _, g in pairs]
    for idf in (False, True):
        got = {r.id: r for r in metrics.alignment(df, "id", "pred", "gold", model, idf=idf, baseline=0.2).collect()}
        for i, (p, g) in enumerate(pairs):
            weight = lambda w: math.log((len(pairs) + 1) / (sum(w in x for x in golds) + 1)) if idf else 1.0  # noqa: E731, B023
            def side(a, b):
                total = sum(weight(w) for w in a)  # noqa: B023
                return sum(weight(w) * max(unit(w) @ unit(v) for v in b) for w in a) / total if a and b and total else 0.0  # noqa: B023
            pr, rc = side(words(p), words(g)), side(words(g), words(p))
            f1 = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
            want = [0.0] * 3 if not (p and p.strip()) else [(x - 0.2) / 0.8 for x in (pr, rc, f1)]
            assert [got[i].align_precision, got[i].align_recall, got[i].align_f1] == pytest.approx(want)


def test_a_failing_score_loses_the_metric_only(spark):
    from marlstone.plans import jobs

    answers = spark.createDataFrame([("q", "red pear", "red", "e", [])], "question string, ground_truth string, generated_answer string, ground_truth_evidence string, retrieved_passages array<struct<text:string>>")
    good, _ = jobs.evaluate(answers, score=metrics.alignment_score(vectors.HashedWords()))
    assert good.first().bertscore_f1 == pytest.approx(0.6667) and good.first().token_f1 == pytest.approx(0.6667)

    def load():
        raise RuntimeError("no model here")

    means, samples = jobs.evaluate(answers, score=metrics.alignment_score(vectors.ModelEmbedder("none", load)))
    assert "bertscore_f1" not in means.columns and means.first().token_f1 == pytest.approx(0.6667) and samples.count() == 1


def test_versioned_table(spark, tmp_path, monkeypatch):
    """Upserts touch their buckets only; a writer that dies at any step leaves the last version; of two writers one commits."""
    from marlstone.sources import versions

    t = versions.VersionedTable(spark, str(tmp_path / "t"), "id", buckets=8)
    make = lambda a, b, s: spark.range(a, b).select("id", F.lit(s).alias("s"))
    with pytest.raises(ValueError):
        t.read()
    assert t.append(make(0, 100, "a")) == 1
    before = t.state()
    assert t.upsert(make(5, 6, "b").union(make(200, 201, "c"))) == 2
    after = t.state()
    moved = {b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)}
    assert len(moved) <= 2 and t.read().count() == 101 and [r.s for r in t.read().where("id = 5").collect()] == ["b"] and t.read(1).count() == 100
    looked = t.lookup(spark.createDataFrame([(5,), (200,), (999,)], "id long"))
    assert sorted(map(tuple, looked.collect())) == [(5, "b"), (200, "c")]
    assert {x.split("/_bucket=")[1].split("/")[0] for x in looked.inputFiles()} <= {str(r.b) for r in spark.createDataFrame([(5,), (200,), (999,)], "id long").select(t._bucket(after).alias("b")).collect()}
    rows = sorted(map(tuple, t.read().collect()))
    for step in ("_write", "_commit"):
        with monkeypatch.context() as m:
            def dies(*a, real=getattr(t, step), **k):
                if step == "_write":
                    real(*a, **k)  # files are there, the commit is not
                raise RuntimeError("lost")

            m.setattr(t, step, dies)
            for change in (t.upsert, t.append, t.overwrite):
                with pytest.raises(RuntimeError):
                    change(make(0, 50, "x"))
        assert sorted(map(tuple, versions.VersionedTable(spark, str(tmp_path / "t"), "id").read().collect())) == rows
    stale = t.state(1)
    monkeypatch.setattr(t, "state", lambda version=None, real=t.state: stale if version is None else real(version))
    with pytest.raises(versions.Conflict):
        t.append(make(0, 1, "y"))
    monkeypatch.undo()
    t.append(make(0, 1, "again"))
    assert t.read().where("id = 0").count() == 2 and t.upsert(make(0, 1, "one")) and [r.s for r in t.read().where("id = 0").collect()] == ["one"]
    assert t.vacuum(retention_s=1000) == [] and len(t.vacuum(retention_s=-1)) > 3 and t.versions() == [4] and t.read().count() == 101
    assert t.overwrite(make(0, 3, "z")) == 5 and t.read().count() == 3
    empty = versions.VersionedTable(spark, str(tmp_path / "e"), "id")
    empty.upsert(make(0, 0, "n"))
    assert empty.read().count() == 0 and empty.read().columns == ["id", "s"]
