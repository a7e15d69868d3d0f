"""Answer metrics as column expressions over arrays of words, and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.stem import stem_words
from marlstone.functions.text import answer_words, normalise_answer, strip
from marlstone.sources.tables import written


def numbered_words(words: Column) -> Column:
    """The words of an array in order, each with its number among equal ones, so that none is there twice."""

    def numbered(s: Column) -> Column:
        last = F.size(s) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.get(s, i) != F.get(s, i + 1)))

        def of_runs(e: Column) -> Column:
            start = lambda j: F.coalesce(F.get(e, j - 1), F.lit(-1))
            return F.flatten(F.transform(e, lambda i, j: F.transform(F.sequence(F.lit(1), i - start(j)), lambda k: F.concat(F.get(s, i), F.lit("\0"), k.cast("string")))))

        return F.when(last >= 0, F.get(F.transform(F.array(ends), of_runs), F.lit(0))).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(F.sort_array(words)), numbered), F.lit(0))


def shared_count(a: Column, b: Column) -> Column:
    """Size of the multiset intersection: both sides are sorted once and equal words numbered, which leaves a plain intersection."""
    return F.size(F.array_intersect(numbered_words(a), numbered_words(b)))


def f_measure(common: Column, n_pred: Column, n_gold: Column) -> Column:
    """2PR/(P+R); 0 where nothing is shared."""
    p, r = common / n_pred, common / n_gold
    return F.when(common > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def exact_match(pred: Column, gold: Column) -> Column:
    return (normalise_answer(pred) == normalise_answer(gold)).cast("double")


def token_f1(pred: Column, gold: Column) -> Column:
    # a one-element array binds the words, which the lambdas would else split anew for each word
    words = F.array(F.struct(answer_words(pred).alias("p"), answer_words(gold).alias("g")))
    return F.get(F.transform(words, lambda x: f_measure(shared_count(x["p"], x["g"]), F.size(x["p"]), F.size(x["g"]))), F.lit(0))


def context_precision(passages: Column, evidence: Column) -> Column:
    """Share of passages with a word of the evidence; 0 without passages or evidence."""

    def share(asked: Column) -> Column:
        hits = F.size(F.filter(passages, lambda p: F.arrays_overlap(answer_words(p), asked)))
        return F.when((F.size(passages) > 0) & (F.size(asked) > 0), hits / F.size(passages)).otherwise(F.lit(0.0))

    return F.get(F.transform(F.array(answer_words(evidence)), share), F.lit(0))


def rouge_words(c: Column) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def ngrams(words: Column, n: int) -> Column:
    if n == 1:
        return words
    at = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " ")))


def lcs_of(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits: a zero at i says that the table's row grows at word i of a; a word of b changes all of it at once."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def lcs_lengths(a: Column, b: Column) -> Column:
    """``lcs_of`` over columns, in Arrow batches."""
    import pandas as pd

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([lcs_of(list(p), list(q)) for p, q in zip(x, y)], dtype="int32")

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "int")(a, b)


def with_rouge(rows: DataFrame, pred: str, gold: str, stemmed: bool = False, longest: bool = True) -> DataFrame:
    """Adds rouge1, rouge2 and (if asked) rougeL F-measures, rounded to four places."""
    out = rows.withColumn("_p", rouge_words(F.col(pred))).withColumn("_g", rouge_words(F.col(gold)))
    if stemmed:
        out = out.withColumn("_p", stem_words(F.col("_p"))).withColumn("_g", stem_words(F.col("_g")))
    for n in (1, 2):
        p, g = ngrams(F.col("_p"), n), ngrams(F.col("_g"), n)
        out = out.withColumn(f"_p{n}", p).withColumn(f"_g{n}", g)
        out = out.withColumn(f"rouge{n}", F.round(f_measure(shared_count(F.col(f"_p{n}"), F.col(f"_g{n}")), F.size(f"_p{n}"), F.size(f"_g{n}")), 4))
    if longest:
        out = out.withColumn("_l", lcs_lengths(F.col("_p"), F.col("_g"))).withColumn("rougeL", F.round(f_measure(F.col("_l"), F.size("_p"), F.size("_g")), 4))
    return out.drop("_p", "_g", "_p1", "_g1", "_p2", "_g2", "_l")


MEANS = ("exact_match", "token_f1", "context_precision", "rouge1", "rouge2", "rougeL", "retrieval_time_s", "generation_time_s", "total_inference_time_s")
#: The column of a model-based score.
MODEL_SCORE = "bertscore_f1"


def with_total_time(answers: DataFrame) -> DataFrame:
    """Adds ``total_inference_time_s``, the sum of the two measured times (absent or null ones count as 0), to three places."""
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in answers.columns else F.lit(0.0)
    return answers.withColumn("total_inference_time_s", F.round(part("retrieval_time_s") + part("generation_time_s"), 3))


def per_sample(answers: DataFrame, stemmed: bool = True) -> DataFrame:
    """Metrics of answer records (``ground_truth, ground_truth_evidence, generated_answer, retrieved_passages``), rounded to four
    places; times that the records carry stay, with their sum."""
    answers = with_total_time(answers) if {"retrieval_time_s", "generation_time_s"} & set(answers.columns) else answers
    if "question" in answers.columns:  # its head is enough for a report
        answers = answers.withColumn("question", F.substring("question", 1, 120))
    gold, pred = F.coalesce("ground_truth", F.lit("")), F.coalesce("generated_answer", F.lit(""))
    passages = F.coalesce(F.transform("retrieved_passages", lambda p: F.coalesce(p["text"], F.lit(""))), F.array().cast("array<string>"))
    rows = answers.withColumn("_gold", gold).withColumn("_pred", pred)
    rows = rows.withColumn("exact_match", exact_match(F.col("_pred"), F.col("_gold"))).withColumn("token_f1", F.round(token_f1(F.col("_pred"), F.col("_gold")), 4))
    rows = rows.withColumn("context_precision", F.round(context_precision(passages, F.coalesce("ground_truth_evidence", F.lit(""))), 4))
    return with_rouge(rows, "_pred", "_gold", stemmed).drop("_gold", "_pred")


def safe_text(c: Column) -> Column:
    """Model-based scores read N/A for blanks."""
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", F.lit("N/A")).otherwise(c)


def token_weights(rows: DataFrame, key: str, tokens: str, of: str) -> DataFrame:
    """``key, weights``: a map from each distinct word of the ``tokens`` to its inverse document weight ``ln((n + 1) / (d + 1))``, d being the
    number of the n rows whose ``of`` words hold it."""
    n = rows.count()
    held = rows.select(F.explode(F.array_distinct(of)).alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("_d"))
    asked = rows.select(key, F.explode(F.array_distinct(tokens)).alias("_w"))
    weight = F.log(F.lit(n + 1.0) / (F.coalesce("_d", F.lit(0)) + 1))
    return asked.join(held, "_w", "left").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_w", weight.alias("x")))).alias("weights"))


def alignment(rows: DataFrame, key: str, pred: str, gold: str, embedder, idf: bool = False, baseline: float = 0.0) -> DataFrame:
    """``key, align_precision, align_recall, align_f1``: how well the words of two texts match by their vectors. Every word is aligned with the
    most similar word of the other text; the similarities are averaged over the prediction's words (precision) and the
    gold words (recall), with inverse document weights of the gold texts if asked, and rescaled so that ``baseline`` becomes 0. Blank texts
    read N/A; a blank prediction scores 0. Words are embedded in the tasks, each once a batch; similarities are made in blocks."""
    import numpy as np
    import pyarrow as pa

    texts = rows.select(key, answer_words(safe_text(F.col(pred))).alias("_p"), answer_words(safe_text(F.col(gold))).alias("_g"), (strip(F.coalesce(F.col(pred), F.lit(""))) == "").alias("_blank"))
    if idf:
        weighed = texts.withColumn("_all", F.concat("_p", "_g"))
        texts = texts.join(token_weights(weighed, key, "_all", "_g"), key, "left")
        of = lambda c: F.transform(c, lambda w: F.coalesce(F.try_element_at("weights", w), F.lit(0.0)))
    else:
        of = lambda c: F.transform(c, lambda _: F.lit(1.0))
    texts = texts.select(key, "_p", "_g", of("_p").alias("_pw"), of("_g").alias("_gw"), "_blank")
    load = embedder.words_model()

    def best(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not len(x) or not len(y):
            return np.zeros(len(x))
        return np.concatenate([(x[i : i + 1024] @ y.T).max(axis=1) for i in range(0, len(x), 1024)])

    def mean(sims: np.ndarray, w: np.ndarray) -> float:
        return float((sims * w).sum() / w.sum()) if w.sum() > 0 else 0.0

    def run(batches):
        model = load()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                p_, g_, pw, gw, blank = (b.column(i).to_pylist() for i in range(1, 6))
                vocabulary = sorted({w for side in (p_, g_) for ws in side for w in ws})
                place = {w: i for i, w in enumerate(vocabulary)}
                vectors = np.asarray(model(vocabulary), float).reshape(len(vocabulary), -1)
                out = []
                for p, g, u, v, none in zip(p_, g_, pw, gw, blank):
                    ip, ig = ([place[w] for w in ws] for ws in (p, g))
                    up, ug = sorted(set(ip)), sorted(set(ig))  # a word counts as often as it stands, but is compared once
                    sp, sg = dict(zip(up, best(vectors[up], vectors[ug]))), dict(zip(ug, best(vectors[ug], vectors[up])))
                    pr = mean(np.array([sp[i] for i in ip]), np.array(u, float)), mean(np.array([sg[i] for i in ig]), np.array(v, float))
                    f1 = 2 * pr[0] * pr[1] / (pr[0] + pr[1]) if pr[0] + pr[1] > 0 else 0.0
                    out.append([0.0 if none else (x - baseline) / (1 - baseline) for x in (*pr, f1)])
                scores = [pa.array([x[i] for x in out], pa.float64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([b.column(0), *scores], names=[key, "align_precision", "align_recall", "align_f1"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.mapInArrow(run, f"`{key}` {kind}, align_precision double, align_recall double, align_f1 double")


def with_score(samples: DataFrame, score, column: str = MODEL_SCORE) -> tuple[DataFrame, str | None]:
    """samples (written) with a model-based score, rounded to four places, and None; where the model can't be loaded or fails on
    any row, the samples as they were and its error: the report loses the metric and nothing else. ``score`` maps samples to ``_row, value``."""
    rows = written(samples.withColumn("_row", F.monotonically_increasing_id()))
    try:
        scored = written(score(rows).select("_row", F.round("value", 4).alias(column)))
    except Exception as e:  # whatever a model raises
        return rows.drop("_row"), f"{type(e).__name__}: {e}"
    return rows.join(scored, "_row", "left").drop("_row"), None


def alignment_score(embedder, pred: str = "generated_answer", gold: str = "ground_truth", **how):
    """The alignment's F as a score for ``with_score``."""
    return lambda rows: alignment(rows, "_row", pred, gold, embedder, **how).select("_row", F.col("align_f1").alias("value"))


def aggregate_report(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (per value of ``by``): the number of samples and the means of their rounded metrics; 0 where there are none. A model-based score
    (``with_score``) is among them when the samples have it."""
    names = [m for m in (*MEANS, MODEL_SCORE) if m in samples.columns]
    aggs = [F.count(F.lit(1)).alias("n_samples"), *[F.coalesce(F.round(F.avg(m), 4), F.lit(0.0)).alias(m) for m in names]]
    return samples.groupBy(*(by or [])).agg(*aggs)
