"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

1. Sources in code-point order (null last) weigh ``weights`` in turn and share all words; a target stops
   at ``max_repeats`` times its source, the excess is shared again by weight (a water level, found in
   closed form).
2. Blocks of ``block_words`` words are seats. Sources are parties, their targets the votes: seats go to
   the highest quotients ``target / (2k - 1)``. Only seats near the final divisor are ranked: with n
   parties the divisor lies between V/(B + n/2) and V/(B - n/2), which fixes all but about 3n seats.
3. A source is cut into shards of about ``shard_docs`` documents by a seeded hash of id and text (so that null and repeated
   ids spread too), and its seats are apportioned to its shards by the same rule, so no window holds more than a shard's
   documents. Sources themselves are ranked in one window: one row a source, and about three seats, are its bound.
4. In a shard, documents stand on a line in seeded order. The quota takes whole passes over the line and
   then its first blocks; a document's take is its share of that.

Defined results: null and blank texts have size 0 and are taken 0 times; texts are counted whole, however long. Of equal quotients the
source or shard of smaller rank has the seat. A null source is a source of its
own, and a null id hashes like an empty one. Ties in the seeded order go to the smaller id; repeated rows are separate documents of equal place
(their order does not change the sum). An empty table gives no rows. Only the columns named by the
parameters are read, so others can't clash; ``mixed_documents`` returns all columns, and takes every row by a number of its
own, so that null and repeated ids keep their sources' targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialize, numbered, read_table, small, words

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK_WORDS = 4
SHARD_DOCS = 2048
SEED = "mix-1"


def seeded(key: Column, salt: str) -> Column:
    """A 60-bit number from a key and the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size`` with ``rank, weight, target`` added; one row a source, so one window is enough."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sources.withColumn("rank", rank).withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights)).cast("double"))
    # sources fill up in the order of capacity by weight; level k is what the rest gets when k - 1 are full
    cap = F.col("source_size") * float(max_repeats)
    by = Window.orderBy((cap / F.col("weight")).asc(), "rank")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum(cap).over(earlier), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    filled = ranked.withColumn("level", level).withColumn("full", cap / F.col("weight") < F.col("level"))
    # the first that is not full sets the level for all that follow
    water = F.min(F.when(~F.col("full"), F.struct(cap / F.col("weight"), "rank", "level"))).over(everything)["level"]
    return filled.withColumn("water", water).withColumn(
        "target", F.when(F.col("water").isNull(), cap).otherwise(F.least(cap, F.col("weight") * F.col("water")))
    ).drop("level", "full", "water")


def sainte_lague(parties: DataFrame, votes: str, group: list[str], order: str, seats: Column) -> DataFrame:
    """parties with ``seats`` added: within each group, ``seats`` seats by highest quotients votes/(2k - 1),
    ties to the smaller ``order``."""
    w = Window.partitionBy(*(group or [F.lit(0)]))
    v = F.col(votes)
    t = parties.withColumn("_b", seats).withColumn("_v", F.sum(v).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    half = F.col("_n") / 2
    # a seat less and a seat more than the extreme divisors give: no rounding can matter
    low = F.greatest(F.lit(0).cast("long"), F.floor(v * F.greatest(F.lit(0.0), F.col("_b") - half) / F.col("_v") + 0.5) - 1)
    high = F.floor(v * (F.col("_b") + half) / F.col("_v") + 0.5) + 1
    t = t.withColumn("_low", F.when(F.col("_v") > 0, low).otherwise(F.lit(0).cast("long"))).withColumn("_high", F.when(v > 0, high).otherwise(F.lit(0).cast("long")))
    t = t.withColumn("_open", F.col("_b") - F.sum("_low").over(w))
    tried = t.withColumn("_k", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))))
    quotient = v / (2 * F.col("_k") - 1)
    place = F.row_number().over(w.orderBy(F.col("_k").isNull(), quotient.desc(), order, "_k"))
    won = tried.withColumn("_won", (F.col("_k").isNotNull() & (place <= F.col("_open"))).cast("long"))
    keys = parties.columns
    return won.groupBy(*keys, "_low").agg(F.sum("_won").alias("_more")).select(*keys, (F.col("_low") + F.col("_more")).alias("seats"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
    seed: str = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    row_col: str | None = None,
) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``, and ``source, shard, seats`` of its shard, and ``row`` if there is a
    column that numbers the rows."""
    row = [] if row_col is None else [F.col(row_col).alias("row")]
    sizes = docs.select(
        *row,
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words(text_col)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col(text_col), F.lit(""))), 1, 10), 16, 10).cast("long").alias("mark"),
    )
    sizes = materialize(sizes, "mix-sizes")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    per_source = materialize(targets(per_source, weights, max_repeats), "mix-sources")
    total = F.sum("source_size").over(Window.partitionBy())
    quotas = sainte_lague(
        per_source.withColumn("total", total), "target", [], "rank", F.floor(F.col("total") / block_words + 0.5).cast("long")
    ).withColumnRenamed("seats", "source_seats")
    quotas = materialize(quotas, "mix-quotas")

    key = seeded(F.col("doc_id"), seed)
    shard = F.pmod(F.shiftright(key, 20) + F.col("mark"), F.ceil(F.col("docs") / shard_docs).cast("long"))
    per_rank = small(quotas.select(F.col("source").alias("_source"), "rank", "docs", "source_size", "target", "source_seats"))
    placed = sizes.join(per_rank, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("key", key).withColumn("shard", shard)

    shards = placed.groupBy("rank", "shard", "source_seats").agg(F.sum("size").alias("shard_size"))
    shard_quotas = sainte_lague(shards, "shard_size", ["rank"], "shard", F.col("source_seats")).select(
        F.col("rank").alias("_rank"), F.col("shard").alias("_shard"), "shard_size", "seats"
    )
    on = (F.col("rank") == F.col("_rank")) & (F.col("shard") == F.col("_shard"))
    lined = placed.join(small(materialize(shard_quotas, "mix-shards")), on).drop("_rank", "_shard")
    before = F.coalesce(
        F.sum("size").over(Window.partitionBy("rank", "shard").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")
    )
    quota = F.least(F.col("seats") * block_words, F.col("shard_size") * max_repeats)
    passes = F.when(F.col("shard_size") > 0, F.expr("quota div shard_size")).otherwise(F.lit(0).cast("long"))
    lined = lined.withColumn("quota", quota).withColumn("passes", passes).withColumn("before", before)
    rest = F.col("quota") - F.col("passes") * F.col("shard_size") - F.col("before")
    return lined.select(
        "doc_id", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))).alias("taken"),
        "source", "shard", "seats", *(["row"] if row else []),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix as documents: each row as often as its take, rounded to whole texts, is its size. A shard's first documents are taken once
    more than its last, so rounding costs a shard half a document."""
    rows = numbered(docs)
    read = rows.select("row", *[F.col(f"value.`{c}`").alias(n) for c, n in ((id_col, "doc_id"), (source_col, "source"), (text_col, "text"))])
    taken = mix(read, row_col="row", **how).select("row", F.floor(F.try_divide("taken", "size") + 0.5).cast("int").alias("times"))
    return rows.join(taken.where("times > 0"), "row").select(F.explode(F.array_repeat("value", F.col("times"))).alias("value")).select("value.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Targets by repeated sharing, seats by listing every quotient: a plainer form of the same rules.
MIXED_SQL = rf"""
z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
      ('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 15))::BIGINT AS key,
      ('0x' || substr(md5(coalesce(text, '')), 1, 10))::BIGINT AS mark FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs,
      row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM z GROUP BY source),
wt AS (SELECT *, ((rank - 1) % {len(WEIGHTS)} + 1)::DOUBLE AS weight, {MAX_REPEATS}.0::DOUBLE * source_size AS cap FROM src),
lv AS (SELECT c.rank AS r, (SELECT sum(source_size) FROM wt) - coalesce(sum(w.cap) FILTER (w.cap / w.weight < c.cap / c.weight), 0) AS rest,
      sum(w.weight) FILTER (w.cap / w.weight >= c.cap / c.weight) AS ws, min(c.cap / c.weight) AS full_at FROM wt c CROSS JOIN wt w GROUP BY c.rank),
lvl AS (SELECT arg_min(rest / ws, full_at) AS water FROM lv WHERE full_at >= rest / ws),
tg AS (SELECT wt.*, CASE WHEN water IS NULL THEN cap ELSE least(cap, weight * water) END AS target FROM wt, lvl),
b AS (SELECT floor(sum(source_size) / {BLOCK_WORDS} + 0.5)::BIGINT AS blocks FROM src),
q AS (SELECT rank, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, rank, k) AS place FROM
      (SELECT rank, target, unnest(range(1, (target / {BLOCK_WORDS})::BIGINT + 50)) AS k FROM tg WHERE target > 0)),
ss AS (SELECT q.rank, count(*) AS source_seats FROM q, b WHERE place <= blocks GROUP BY q.rank),
p AS (SELECT z.*, tg.rank, source_size, target, coalesce(source_seats, 0) AS source_seats,
      ((key >> 20) + mark) % ceil(docs / {SHARD_DOCS}.0)::BIGINT AS shard FROM z JOIN tg ON z.source IS NOT DISTINCT FROM tg.source LEFT JOIN ss ON tg.rank = ss.rank),
sh AS (SELECT rank, shard, source_seats, sum(size) AS shard_size FROM p GROUP BY ALL),
sq AS (SELECT rank, shard, source_seats, row_number() OVER (PARTITION BY rank ORDER BY shard_size / (2 * k - 1) DESC, shard, k) AS place FROM
      (SELECT *, unnest(range(1, (3 * shard_size / {BLOCK_WORDS})::BIGINT + 50)) AS k FROM sh WHERE shard_size > 0)),
sn AS (SELECT rank, shard, count(*) AS seats FROM sq WHERE place <= source_seats GROUP BY rank, shard),
ln AS (SELECT p.*, shard_size, least(coalesce(seats, 0) * {BLOCK_WORDS}, {MAX_REPEATS} * shard_size) AS quota,
      coalesce(sum(size) OVER (PARTITION BY p.rank, p.shard ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM p JOIN sh USING (rank, shard) LEFT JOIN sn USING (rank, shard)),
mixed AS (SELECT doc_id, size, source_size, target, (CASE WHEN shard_size = 0 THEN 0 ELSE (quota // shard_size) * size
      + greatest(0, least(size, quota - (quota // shard_size) * shard_size - before)) END)::BIGINT AS taken FROM ln)
"""
ORACLE_SQL = f"WITH {MIXED_SQL} SELECT * FROM mixed"
