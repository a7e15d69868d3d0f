"""Queries over vectors, retrieval, prompts and answer metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import ablation, answering, metrics, vectors
from marlstone.operators import retrieval as search_ops
from marlstone.plans.inputs import PACKED, QA, chunk_texts, qa_pairs, sql_words, table
from marlstone.plans.query import query
from marlstone.sources.tables import shared_folder, written

TOP = 5


@query(f"""
WITH t AS (SELECT doc_id, ('0x' || substr(md5(unnest({sql_words('text')})), 1, 7))::BIGINT % 256 AS bucket FROM documents),
c AS (SELECT doc_id, bucket, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c
""")
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = table(spark, sf_dir, "documents").select("doc_id", F.explode(vectors.HashedWords().weights(F.col("text"))).alias("w"))
    return coded.select("doc_id", F.col("w.bucket").cast("long").alias("bucket"), F.round("w.weight", 6).alias("weight"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    return v.withColumnRenamed("id", "query_id"), v


_SCORES = "s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON {on})"
_RANKED = "SELECT query_id, (row_number() OVER w)::INT AS rank, id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= {k}"


@query(f"WITH {_SCORES.format(on='true')} {_RANKED.format(k=TOP)}")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top_k(*_vectors(spark, sf_dir), TOP)


@query(f"WITH {_SCORES.format(on='q.label = v.label')} {_RANKED.format(k=TOP)}")
def knn_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top_k(*_vectors(spark, sf_dir), TOP, scope="label")


@query(f"WITH {_SCORES.format(on='true')}, h AS ({_RANKED.format(k=TOP)}) SELECT query_id, rank, id, lang, source FROM h JOIN documents d ON d.doc_id = h.id")
def resolve_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vectors.exact_top_k(*_vectors(spark, sf_dir), TOP)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return search_ops.resolve_hits(hits, docs, "id").select("query_id", "rank", "id", "lang", "source")


@query(f"""
WITH RECURSIVE {PACKED} SELECT a.chunk_id, (b.chunk_index - a.chunk_index)::INT AS "offset", b.chunk_id AS neighbor_id FROM ch a JOIN ch b ON a.doc_name = b.doc_name AND abs(a.chunk_index - b.chunk_index) BETWEEN 1 AND 2
""")
def expand_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_texts(spark, sf_dir)
    every = chunks.select(F.col("chunk_id").alias("query_id"), F.lit(1).alias("rank"), "doc_name", "chunk_index")
    return search_ops.neighbours(every, chunks, 2).select(F.col("query_id").alias("chunk_id"), "offset", "neighbor_id")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Chunks for every benchmark text."""
    chunks, embedder = written(chunk_texts(spark, sf_dir)), vectors.HashedWords()  # packed once, for vectors and texts
    coded = embedder.encode(chunks.select("chunk_id", "text"), "text").select(F.col("chunk_id").alias("id"), "vector")
    hits = vectors.exact_top_k(embedder.encode(_questions(spark, sf_dir), "question"), coded, k).withColumnRenamed("id", "chunk_id")
    return search_ops.resolve_hits(hits, chunks)


def _ranked_sql(k: int) -> str:
    return f"""{PACKED},
b AS (SELECT item_id::VARCHAR AS id, 1 AS side, unnest({sql_words('text')}) AS w FROM benchmark UNION ALL SELECT chunk_id, 0, unnest({sql_words('text')}) FROM ch),
n AS (SELECT side, id, ('0x' || substr(md5(w), 1, 7))::BIGINT % 256 AS k, count(*)::DOUBLE AS n FROM b GROUP BY ALL),
u AS (SELECT side, id, k, n / sqrt(sum(n * n) OVER (PARTITION BY side, id)) AS x FROM n),
sc AS (SELECT q.id::BIGINT AS query_id, c.id AS chunk_id, round(sum(q.x * c.x), 6) AS score FROM u q JOIN u c ON q.side = 1 AND c.side = 0 AND q.k = c.k GROUP BY ALL),
hits AS (SELECT query_id, (row_number() OVER r)::INT AS rank, chunk_id, score, doc_name, chunk_index, page_start, text FROM sc JOIN ch USING (chunk_id)
      WINDOW r AS (PARTITION BY query_id ORDER BY score DESC, chunk_id) QUALIFY row_number() OVER r <= {k})"""


@query(f"WITH RECURSIVE {_ranked_sql(TOP)} SELECT query_id, rank, chunk_id, doc_name, chunk_index, score FROM hits")
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, TOP).select("query_id", "rank", "chunk_id", "doc_name", "chunk_index", "score")


@query(f"""
WITH RECURSIVE {_ranked_sql(3)},
c AS (SELECT query_id, string_agg('[Passage ' || rank || '] (doc=' || doc_name || ', page=' || page_start || ')' || chr(10) || trim(replace(text, chr(10), ' ')), chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id)
SELECT query_id, 'Context passages:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer (using only the context above):' AS prompt
FROM c JOIN benchmark ON item_id = query_id
""")
def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.build_prompts(_questions(spark, sf_dir), _hits(spark, sf_dir, 3)).select("query_id", "prompt")


@query(f"WITH {QA} SELECT qa_id, question, answer, answer || ' ' || coalesce(question, '') AS evidence FROM qa")
def qa_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = qa_pairs(spark, sf_dir)
    evidence = F.array(F.struct(F.col("answer").alias("evidence_text")), F.struct(F.col("question").alias("evidence_text")))
    return pairs.select("qa_id", "question", "answer", answering.evidence_text(evidence).alias("evidence"))


_N = f"""
a AS (SELECT qa_id, {sql_words('question')} AS p, {sql_words('answer')} AS g FROM qa),
x AS (SELECT qa_id, w, count(*) AS n FROM (SELECT qa_id, unnest(p) AS w FROM a) GROUP BY ALL),
y AS (SELECT qa_id, w, count(*) AS n FROM (SELECT qa_id, unnest(g) AS w FROM a) GROUP BY ALL),
f AS (SELECT a.qa_id, array_to_string(p, ' ') = array_to_string(g, ' ') AS em, len(p) AS np, len(g) AS ng, coalesce(c, 0) AS c FROM a
      LEFT JOIN (SELECT qa_id, sum(least(x.n, y.n)) AS c FROM x JOIN y USING (qa_id, w) GROUP BY qa_id) USING (qa_id)),
m AS (SELECT qa_id, em::INT::DOUBLE AS exact_match, round(CASE WHEN c > 0 THEN 2 * (c / np) * (c / ng) / (c / np + c / ng) ELSE 0.0 END, 6) AS token_f1 FROM f)
"""


@query(f"WITH {QA}, {_N} SELECT qa_id, exact_match FROM m")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_pairs(spark, sf_dir).select("qa_id", metrics.exact_match(F.col("question"), F.col("answer")).alias("exact_match"))


def _f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_pairs(spark, sf_dir).select("qa_id", F.round(metrics.token_f1(F.col("question"), F.col("answer")), 6).alias("token_f1"))


@query(f"WITH {QA}, {_N} SELECT qa_id, token_f1 FROM m")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f1(spark, sf_dir)


@query(f"""
WITH RECURSIVE {_ranked_sql(TOP)},
e AS (SELECT item_id, {sql_words('text')} AS ev FROM benchmark)
SELECT query_id, round(avg(list_has_any({sql_words('substr(text, 1, 500)')}, ev)::INT), 6) AS context_precision FROM hits JOIN e ON item_id = query_id GROUP BY query_id
""")
def context_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = _hits(spark, sf_dir, TOP).groupBy("query_id").agg(F.collect_list(F.substring("text", 1, answering.PASSAGE_CHARS)).alias("passages"))
    joined = passages.join(_questions(spark, sf_dir), "query_id")
    return joined.select("query_id", F.round(metrics.context_precision(F.col("passages"), F.col("question")), 6).alias("context_precision"))


_ROUGE_WORDS = "list_filter(string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_ROUGE = f"""
r AS (SELECT qa_id, {_ROUGE_WORDS.format(c='question')} AS p, {_ROUGE_WORDS.format(c='answer')} AS g FROM qa),
r2 AS (SELECT qa_id, p, g, list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1]) AS pp, list_transform(range(1, len(g)), lambda i: g[i] || ' ' || g[i + 1]) AS gg FROM r),
gm AS (SELECT qa_id, 1 AS n, 'p' AS side, unnest(p) AS w FROM r2 UNION ALL SELECT qa_id, 1, 'g', unnest(g) FROM r2 UNION ALL SELECT qa_id, 2, 'p', unnest(pp) FROM r2 UNION ALL SELECT qa_id, 2, 'g', unnest(gg) FROM r2),
gc AS (SELECT qa_id, n, w, count(*) FILTER (side = 'p') AS a, count(*) FILTER (side = 'g') AS b FROM gm GROUP BY ALL),
gs AS (SELECT qa_id, n, sum(least(a, b)) AS c, sum(a) AS np, sum(b) AS ng FROM gc GROUP BY ALL),
gf AS (SELECT qa_id, n, round(CASE WHEN c > 0 THEN 2 * (c / np) * (c / ng) / (c / np + c / ng) ELSE 0.0 END, 4) AS v FROM gs),
rg AS (SELECT qa_id, coalesce(max(v) FILTER (n = 1), 0.0) AS rouge1, coalesce(max(v) FILTER (n = 2), 0.0) AS rouge2 FROM r2 LEFT JOIN gf USING (qa_id) GROUP BY qa_id)
"""


@query(f"WITH {QA}, {_ROUGE} SELECT qa_id, rouge1, rouge2 FROM rg")
def rouge12_nostem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_rouge(qa_pairs(spark, sf_dir), "question", "answer", longest=False).select("qa_id", "rouge1", "rouge2")


# the longest common subsequence by anti-diagonals: each step makes a whole diagonal from the two before it
_LCS = f"""
r AS (SELECT qa_id, {_ROUGE_WORDS.format(c='question')} AS p, {_ROUGE_WORDS.format(c='answer')} AS g FROM qa),
dg AS (SELECT qa_id, p, g, 1 AS d, list_transform(range(len(p) + 1), lambda i: 0) AS one, list_transform(range(len(p) + 1), lambda i: 0) AS two FROM r
      UNION ALL
      SELECT qa_id, p, g, d + 1, list_transform(range(len(p) + 1), lambda i: CASE WHEN i = 0 OR d + 1 - i <= 0 OR d + 1 - i > len(g) THEN 0
        WHEN p[i] = g[d + 1 - i] THEN two[i] + 1 ELSE greatest(one[i + 1], one[i]) END), one FROM dg WHERE d < len(p) + len(g)),
lc AS (SELECT qa_id, one[len(p) + 1] AS c, len(p) AS np, len(g) AS ng FROM dg WHERE d = len(p) + len(g)),
rl AS (SELECT r.qa_id, round(CASE WHEN c > 0 THEN 2 * (c / np) * (c / ng) / (c / np + c / ng) ELSE 0.0 END, 4) AS rougeL FROM r LEFT JOIN lc USING (qa_id))
"""


@query(f'WITH RECURSIVE {QA}, {_LCS} SELECT qa_id, rougeL AS "rougeL" FROM rl')
def rougel_nostem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_rouge(qa_pairs(spark, sf_dir), "question", "answer").select("qa_id", "rougeL")


@query()
def rouge_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With Porter stems, which SQL has not."""
    return metrics.with_rouge(qa_pairs(spark, sf_dir), "question", "answer", stemmed=True).select("qa_id", "rouge1", "rouge2", "rougeL")


@query(f"""
WITH {QA}, {_N}, {_ROUGE}
SELECT count(*) AS n_samples, round(avg(exact_match), 4) AS exact_match, round(avg(round(token_f1, 4)), 4) AS token_f1, round(avg(rouge1), 4) AS rouge1, round(avg(rouge2), 4) AS rouge2 FROM m JOIN rg USING (qa_id)
""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa_pairs(spark, sf_dir).select("qa_id", "question", "answer")
    pred, gold = F.col("question"), F.col("answer")
    samples = rows.withColumn("exact_match", metrics.exact_match(pred, gold)).withColumn("token_f1", F.round(F.round(metrics.token_f1(pred, gold), 6), 4))
    return metrics.aggregate_report(metrics.with_rouge(samples, "question", "answer", longest=False))


# the hashed embedder gives a word one dimension, so a word's best similarity is 1 where the other side has that dimension
_ALIGN = f"""
sf AS (SELECT qa_id, trim(coalesce(question, '')) = '' AS blank, CASE WHEN trim(coalesce(question, '')) = '' THEN 'N/A' ELSE question END AS q, CASE WHEN trim(coalesce(answer, '')) = '' THEN 'N/A' ELSE answer END AS a FROM qa),
aw AS (SELECT qa_id, 0 AS side, unnest({sql_words('q')}) AS w FROM sf UNION ALL SELECT qa_id, 1, unnest({sql_words('a')}) FROM sf),
ad AS (SELECT w, count(DISTINCT qa_id) AS d FROM aw WHERE side = 1 GROUP BY w),
ax AS (SELECT qa_id, side, ln(((SELECT count(*) FROM qa) + 1.0) / (coalesce(d, 0) + 1)) AS x, ('0x' || substr(md5(w), 1, 7))::BIGINT % 256 AS k FROM aw LEFT JOIN ad USING (w)),
ah AS (SELECT DISTINCT qa_id, side, k FROM ax),
ap AS (SELECT ax.qa_id, ax.side, sum(CASE WHEN ah.k IS NULL THEN 0.0 ELSE x END) / nullif(sum(x), 0) AS v FROM ax LEFT JOIN ah ON ah.qa_id = ax.qa_id AND ah.side = 1 - ax.side AND ah.k = ax.k GROUP BY ALL),
al AS (SELECT sf.qa_id, CASE WHEN blank THEN 0.0 ELSE coalesce(p.v, 0.0) END AS pr, CASE WHEN blank THEN 0.0 ELSE coalesce(r.v, 0.0) END AS rc FROM sf
      LEFT JOIN ap p ON p.qa_id = sf.qa_id AND p.side = 0 LEFT JOIN ap r ON r.qa_id = sf.qa_id AND r.side = 1),
af AS (SELECT qa_id, pr, rc, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM al)
"""


@query(f"WITH {QA}, {_ALIGN} SELECT qa_id, round(pr, 6) AS align_precision, round(rc, 6) AS align_recall, round(f1, 6) AS align_f1 FROM af")
def alignment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question held against its answer by the vectors of their words, with inverse document weights."""
    rows = metrics.alignment(qa_pairs(spark, sf_dir), "qa_id", "question", "answer", vectors.HashedWords(), idf=True)
    return rows.select("qa_id", *[F.round(c, 6).alias(c) for c in ("align_precision", "align_recall", "align_f1")])


def _broken() -> None:
    raise RuntimeError("this model can't be loaded")


@query(f"""
WITH {QA}, {_N}, {_ALIGN}
SELECT 'scored' AS run, count(*) AS n_samples, round(avg(round(token_f1, 4)), 4) AS token_f1, round(avg(round(f1, 4)), 4) AS bertscore_f1 FROM m JOIN af USING (qa_id)
UNION ALL SELECT 'failed', count(*), round(avg(round(token_f1, 4)), 4), NULL FROM m
""")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with a model-based score: one whose model works, and one whose model fails while it runs and costs the report this metric only."""
    rows = qa_pairs(spark, sf_dir).select("qa_id", "question", "answer")
    samples = rows.withColumn("token_f1", F.round(F.round(metrics.token_f1(F.col("question"), F.col("answer")), 6), 4))
    good, _ = metrics.with_score(samples, metrics.alignment_score(vectors.HashedWords(), "question", "answer", idf=True))
    bad, error = metrics.with_score(samples, metrics.alignment_score(vectors.ModelEmbedder("broken", _broken), "question", "answer"))
    assert error and "bertscore_f1" not in bad.columns
    named = lambda df, run: df.withColumn("run", F.lit(run))
    both = metrics.aggregate_report(named(good, "scored"), ["run"]).unionByName(metrics.aggregate_report(named(bad, "failed"), ["run"]), allowMissingColumns=True)
    return both.select("run", "n_samples", "token_f1", "bertscore_f1")


@query(f"""
WITH {QA}, {_N}
(SELECT 'worst' AS kind, qa_id, token_f1 FROM m ORDER BY token_f1, qa_id LIMIT 3) UNION ALL (SELECT 'best', qa_id, token_f1 FROM m ORDER BY token_f1 DESC, qa_id DESC LIMIT 3)
""")
def best_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _f1(spark, sf_dir)
    worst = scored.orderBy("token_f1", "qa_id").limit(3).select(F.lit("worst").alias("kind"), "qa_id", "token_f1")
    best = scored.orderBy(F.desc("token_f1"), F.desc("qa_id")).limit(3).select(F.lit("best").alias("kind"), "qa_id", "token_f1")
    return worst.unionByName(best)


@query(f"""
WITH {_SCORES.format(on='true')}, h AS ({_RANKED.format(k=10)}), j AS (SELECT k, q.label = v.label AS hit FROM h JOIN (SELECT unnest([3, 5, 7, 10]) AS k) ON rank <= k
 JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON v.vec_id = id)
SELECT k, count(*) AS n_hits, round(avg(hit::INT), 6) AS same_label FROM j GROUP BY k
""")
def ablate_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of hits with the query's label for each k, from one ranking."""
    q, v = _vectors(spark, sf_dir)
    hits = ablation.by_k(vectors.exact_top_k(q, v, 10))
    named = hits.join(q.select("query_id", F.col("label").alias("ql")), "query_id").join(v.select("id", "label"), "id")
    return named.groupBy("k").agg(F.count(F.lit(1)).alias("n_hits"), F.round(F.avg((F.col("ql") == F.col("label")).cast("int")), 6).alias("same_label"))


@query()
def ablate_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the inverted lists against exact search. These vectors have no structure, so more than half of the codes are looked at."""
    q, v = _vectors(spark, sf_dir)
    return ablation.recall_of(vectors.ivf_top_k(q, v, TOP, scan=0.6), vectors.exact_top_k(q, v, TOP))


@query(f"""
WITH RECURSIVE {PACKED} SELECT count(*) AS n_chunks, round(count(*) / 250.0, 6) AS seconds, ceil(count(*) / 64.0)::BIGINT AS batches FROM ch
""")
def throughput_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time to encode all chunks at a given rate (250 a second) in batches of 64; ``jobs.encoding_rate`` measures a rate."""
    n = chunk_texts(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_chunks"))
    return n.select("n_chunks", F.round(F.col("n_chunks") / 250.0, 6).alias("seconds"), F.ceil(F.col("n_chunks") / 64.0).cast("long").alias("batches"))


@query(f"""
WITH RECURSIVE {PACKED} SELECT 'hashed-words-256' AS embedding_model, 'exact' AS backend, count(*) AS n_chunks, count(DISTINCT doc_name) AS n_documents, 64::BIGINT AS batch_size FROM ch
""")
def index_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index job writes beside the vectors of all chunks, and the documents that the vector table holds."""
    from marlstone.plans import jobs

    none = F.lit(None).cast("string")
    chunks = written(chunk_texts(spark, sf_dir).withColumns({"doc_type": none, "company": none, "doc_period": none, "chunk_type": F.lit("narrative")}))
    path = shared_folder(spark)
    jobs.index_driver(spark, chunks, path)
    told = spark.read.option("multiLine", True).json(f"{path}/manifest.json").select("embedding_model", "backend", "n_chunks", "batch_size")
    n = vectors.VectorStore(spark, f"{path}/vectors").table().select("doc_name").distinct().count()
    return told.withColumn("n_documents", F.lit(n).cast("long"))
