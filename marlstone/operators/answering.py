"""Prompts, generators and answer records."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import answer_words, strip

#: The default instruction of a model; ``ModelGenerator`` takes any other.
SYSTEM_PROMPT = "You answer questions about company filings. Use nothing but the passages given. Keep it short, and close with the numbers of the passages that you used."
#: Characters kept of a passage in answer records, of a question in reports, and of texts shown to readers.
PASSAGE_CHARS = 500
QUESTION_CHARS, SNIPPET_CHARS = 120, 150


def evidence_text(evidence: Column) -> Column:
    texts = F.transform(F.coalesce(evidence, F.array().cast("array<struct<evidence_text:string>>")), lambda x: F.coalesce(x["evidence_text"], F.lit("")))
    return F.array_join(texts, " ")


def passage_text(rank: Column, doc: Column, page: Column, text: Column) -> Column:
    head = F.concat(F.lit("[Passage "), rank.cast("string"), F.lit("] (doc="), F.coalesce(doc, F.lit("unknown")), F.lit(", page="), F.coalesce(page.cast("string"), F.lit("?")), F.lit(")\n"))
    return F.concat(head, strip(F.replace(text, F.lit("\n"), F.lit(" "))))


def build_prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, question, prompt``; hits have ``query_id, rank, doc_name, page_start, text``."""
    one = passage_text(F.col("rank"), F.col("doc_name"), F.col("page_start"), F.col("text"))
    context = F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("p")))), lambda x: x["p"])
    joined = hits.groupBy("query_id").agg(F.array_join(context, "\n\n").alias("context"))
    both = questions.join(joined, "query_id", "left")
    parts = (F.lit("Context passages:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("question"), F.lit("\n\nAnswer (using only the context above):"))
    return both.select("query_id", "question", F.concat(*parts).alias("prompt"))


class Generator(ABC):
    name: str

    @abstractmethod
    def generate(self, df: DataFrame) -> DataFrame:
        """Adds ``generated_answer`` to ``question, prompt, context`` rows."""


class Extractive(Generator):
    """The sentence of the context that shares the most words with the question; of equal ones the first."""

    name = "extractive"

    def generate(self, df: DataFrame) -> DataFrame:
        asked = F.array_distinct(answer_words(F.col("question")))
        ranked = F.transform(
            F.split("context", r"(?<=[.!?])\s+"), lambda s, i: F.struct((-F.size(F.array_intersect(F.array_distinct(answer_words(s)), asked))).alias("n"), i.alias("i"), s.alias("s"))
        )
        return df.withColumn("generated_answer", F.coalesce(F.array_min(ranked)["s"], F.lit("")))


class ModelGenerator(Generator):
    """Any callable (system, prompt) -> answer, made once per worker by ``load``."""

    def __init__(self, name: str, load: Callable[[], Callable[[str, str], str]], system: str = SYSTEM_PROMPT):
        self.name, self.load, self.system = name, load, system

    def generate(self, df: DataFrame) -> DataFrame:
        import pandas as pd

        load, system = self.load, self.system

        def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = load()
            for s in series:
                answers, took = [], []
                for p in s:
                    start = time.perf_counter()
                    answers.append(model(system, p))
                    took.append(time.perf_counter() - start)
                yield pd.DataFrame({"generated_answer": answers, "generation_time_s": took})

        run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        made = df.withColumn("_made", F.pandas_udf(run, "generated_answer string, generation_time_s double")("prompt"))
        return made.select(*[c for c in df.columns], "_made.generated_answer", F.round("_made.generation_time_s", 3).alias("generation_time_s"))


GENERATORS: dict[str, Callable[[], Generator]] = {"extractive": Extractive}


def answer_records(questions: DataFrame, hits: DataFrame, generator: Generator | None = None) -> DataFrame:
    """One record per question with its passages, cut to 500 characters, and the generated answer."""
    generator = generator or Extractive()
    passage = F.struct("rank", "chunk_id", "doc_name", "page_start", F.round("score", 4).alias("score"), F.substring("text", 1, PASSAGE_CHARS).alias("text"))
    kept = F.transform(F.array_sort(F.collect_list(passage)), lambda x: x.dropFields("rank"))
    context = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ")
    found = hits.groupBy("query_id").agg(kept.alias("retrieved_passages"), context.alias("context"))
    prompted = build_prompts(questions, hits).drop("question")
    rows = questions.join(found, "query_id", "left").join(prompted, "query_id").withColumn("context", F.coalesce("context", F.lit("")))
    return generator.generate(rows).drop("context")
