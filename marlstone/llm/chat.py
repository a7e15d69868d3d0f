"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every turn becomes a segment: ``<s>``, the marker of its role, a line end, its text, ``</s>``. The user is marked by ``[INST]``, the
assistant by ``[/INST]``, the system by ``<<SYS>>``, any other role by ``<<SYS>>role<</SYS>>``. Control strings inside texts
and roles are escaped by one more backslash after their first character, so ``</s>`` is written ``<\\/s>`` and what was ``<\\/s>`` before
becomes ``<\\\\/s>``; taking one away gives the text back. So control strings without a backslash are the template's alone.

A conversation's formatted text is its segments in the order of turns. It is expanded into one example for every assistant turn: its
prefix is all text before the reply, its target the reply and its end, its loss mask covers the reply's text and nothing else. Turns
after the last reply make one more example, a prefix without target and mask, so that examples hold every turn. What is under the
masks is read from the examples' own texts.

A conversation's rows meet in one group only up to ``BLOCK_TURNS`` of them. Longer ones are sorted by ranges and cut into blocks
of that many turns; offsets come from the blocks' lengths. Prefixes are quadratic in a block's text, so in a long conversation a prefix is written
from its block's start; ``before`` says how much of the conversation, its blocks before, stands in front. Only the digest of a whole conversation, being one SHA-256, needs its
text as one value (2 GB at most), put together from few rows.

Defined results: null texts and roles are empty ones; rows without a conversation id are one conversation; rows without a turn come
last; rows of one turn stand in the order of role, then of their text's MD5; repeated rows are turns of their own. Texts are never
cut. Columns beyond the four named are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialize, read_table, small

#: Turns of a conversation that one group holds.
BLOCK_TURNS = 1024
BEGIN, END = "<s>", "</s>"
MARKS = {"user": "[INST]", "assistant": "[/INST]", "system": "<<SYS>>"}
CLOSE = "<</SYS>>"
TRAINED = "assistant"
_CONTROL = r"(<){0}(\\*)(/?s>|</?SYS>>)|(\[){0}(\\*)(/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL.format(""), r"$1$4\\$2$5$3$6")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL.format(r"\\"), "$1$4$2$5$3$6")


def header(role: Column) -> Column:
    other = F.concat(F.lit(BEGIN + MARKS["system"]), escaped(role), F.lit(CLOSE + "\n"))
    for name, mark in MARKS.items():
        other = F.when(role == name, F.lit(f"{BEGIN}{mark}\n")).otherwise(other)
    return other


def segments(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, place, segment`` of every row; ``place`` orders the turns of a conversation."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    place = F.struct(F.col(turn).isNull().alias("no_turn"), F.col(turn).cast("long").alias("turn"), read(role).alias("role"), F.md5(read(text)).alias("mark"))
    whole = F.concat(header(read(role)), escaped(read(text)), F.lit(END))
    return conversations.select(F.col(conv).cast("long").alias("conv_id"), place.alias("place"), whole.alias("segment"))


def _joined(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    in_order = F.array_sort(F.collect_list(F.struct(place, "segment")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(in_order, lambda x: x["segment"]), "").alias("formatted"))


def formatted_blocks(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> tuple[DataFrame, DataFrame | None]:
    """``conv_id, block, formatted``: of conversations of one block, and of longer ones (written; None if there are none)."""
    long_ = turns.groupBy("conv_id").count().where(F.col("count") > block_turns).select(F.col("conv_id").alias("_long"), F.lit(True).alias("_cut"))
    long_ = materialize(long_, "chat-long")
    if not long_.limit(1).count():
        return _joined(turns, ["conv_id"], "place").select("conv_id", F.lit(0).cast("long").alias("block"), "formatted"), None
    marked = turns.join(small(long_), F.col("conv_id").eqNullSafe(F.col("_long")), "left").drop("_long")
    whole = _joined(marked.where("_cut is null"), ["conv_id"], "place").select("conv_id", F.lit(0).cast("long").alias("block"), "formatted")
    # equal rows differ in the last key, so that no range is larger than others
    rows = marked.where("_cut").select("conv_id", "place", "segment", F.monotonically_increasing_id().alias("row"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "place", "row"]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    cut = materialize(_joined(ranged.withColumn("block", F.expr(f"at div {block_turns}")), ["conv_id", "block"], "at"), "chat-blocks")
    return whole, cut


def block_turns(blocks: DataFrame) -> DataFrame:
    """The turns read back from blocks: the blocks' columns, with ``pieces`` (their segments without ends) for the text, and ``no`` (from 0
    in the block), ``piece`` (the turn's own), ``head`` (code points of its header), ``role, text``."""
    pieces = F.split("formatted", END)
    kept = [c for c in blocks.columns if c != "formatted"]
    rows = blocks.select(*kept, F.slice(pieces, 1, F.size(pieces) - 1).alias("pieces")).select(*kept, "pieces", F.posexplode("pieces").alias("no", "piece"))
    piece, opened = F.col("piece"), BEGIN + MARKS["system"]
    close = F.instr(piece, CLOSE)  # only the header of another role holds one
    starts = [(n, f"{BEGIN}{m}\n") for n, m in MARKS.items()]
    role, head = unescaped(F.substr(piece, F.lit(len(opened) + 1), close - 1 - len(opened))), close + len(CLOSE)
    for name, mark in starts:
        it_is = piece.startswith(mark) & (close == 0)
        role, head = F.when(it_is, F.lit(name)).otherwise(role), F.when(it_is, F.lit(len(mark))).otherwise(head)
    return rows.withColumn("role", role).withColumn("head", head).withColumn("text", unescaped(F.substr(piece, F.col("head") + 1)))


def _offsets(blocks: DataFrame) -> DataFrame:
    """``conv_id, block, before, last``: code points of a conversation before each of its blocks, and whether more follow."""
    lengths = blocks.select("conv_id", "block", F.length("formatted").cast("long").alias("length"))
    by = Window.partitionBy("conv_id").orderBy("block")
    before = F.coalesce(F.sum("length").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return lengths.select("conv_id", "block", before.alias("before"), F.lead("block").over(by).isNull().alias("last"))


def turn_examples(blocks: DataFrame, cut: bool = False) -> DataFrame:
    """The turns of blocks with the example that each one ends: ``is_example, trained``, the example's ``prefix`` and ``target``, and as
    code points of the conversation's formatted text ``before`` (in front of the prefix), ``loss_start, loss_end, chars``; null where a turn ends
    none, or one without a target. ``cut``: the blocks are of conversations of several."""
    if cut:
        on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
        placed = blocks.join(_offsets(blocks).withColumnsRenamed({"conv_id": "_conv", "block": "_block"}), on).drop("_conv", "_block")
    else:
        placed = blocks.withColumn("before", F.lit(0).cast("long")).withColumn("last", F.lit(True))
    final = F.col("last") & (F.col("no") == F.size("pieces") - 1)
    turns = block_turns(placed).withColumn("trained", F.col("role") == TRAINED).withColumn("is_example", F.col("trained") | final)
    ended = lambda n, rest: F.array_join(F.concat(F.slice("pieces", F.lit(1), n), F.array(rest)), END)
    prefix = F.when(F.col("trained"), ended(F.col("no"), F.substr("piece", F.lit(1), F.col("head")))).when(F.col("is_example"), ended(F.col("no") + 1, F.lit("")))
    target = F.when(F.col("trained"), F.concat(F.substr("piece", F.col("head") + 1), F.lit(END)))
    turns = turns.withColumn("prefix", prefix).withColumn("target", target)
    start, size = F.col("before") + F.length("prefix"), F.length("target")
    return turns.select(
        "conv_id", "block", "no", "role", "text", "is_example", "trained", "before", "prefix", "target",
        F.when(F.col("trained"), start).alias("loss_start"), (start + size - len(END)).alias("loss_end"), (start + F.coalesce(size, F.lit(0))).alias("chars"),
    )


def example_texts(blocks: DataFrame) -> DataFrame:
    """Examples of conversations of one block: ``conv_id, no, context, reply, trained``. An example that is not trained
    has all its text as context. The output is quadratic in a conversation's length."""
    return turn_examples(blocks).where("is_example").select("conv_id", "no", F.col("prefix").alias("context"), F.col("target").alias("reply"), "trained")


def under_mask(examples: DataFrame) -> DataFrame:
    """The examples with ``learnt``: what their own text has under the loss mask, unescaped."""
    at, size = (F.col("loss_start") - F.col("before") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")
    return examples.withColumn("learnt", unescaped(F.substr(F.concat("prefix", "target"), at, size)))


def _told(examples: DataFrame) -> DataFrame:
    """Per block: what its turns and examples say."""
    line = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    in_order = F.array_sort(F.collect_list(F.struct("no", line.alias("line"), "trained", "learnt")))
    rows = under_mask(examples).groupBy("conv_id", "block").agg(
        in_order.alias("turns"), F.sum("chars").alias("chars"), F.sum(F.col("trained").cast("long")).alias("n_examples")
    )
    return rows.select(
        "conv_id", "block", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["line"]), "").alias("told"),
        F.array_join(F.transform(F.filter("turns", lambda x: x["trained"]), lambda x: x["learnt"]), "").alias("loss"), "chars", "n_examples",
    )


def _digests(rows: DataFrame) -> DataFrame:
    return rows.select(
        "conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.coalesce("chars", F.lit(0).cast("long")).alias("formatted_chars"), "n_examples",
    )


def conversation_digests(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Per conversation: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` (of all examples),
    ``n_examples`` (trained ones)."""
    whole, cut = formatted_blocks(segments(conversations), block_turns)
    out = _digests(_told(turn_examples(whole)))
    if cut is None:
        return out
    parts = _told(turn_examples(cut, cut=True))
    put = lambda c: F.array_join(F.transform("parts", lambda x: x[c]), "").alias(c)
    parts = parts.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "told", "loss"))).alias("parts"), *[F.sum(c).alias(c) for c in ("n_turns", "chars", "n_examples")]
    )
    return out.union(_digests(parts.select("conv_id", "n_turns", put("told"), put("loss"), "chars", "n_examples")))


#: Conversation -1: two turns whose text is made of control strings.
PROBE = "</s>[INST] ok [/INST]"


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long"), F.col("id"), role, F.lit(PROBE))
    return conversation_digests(rows.union(probe))


_ESC = r"regexp_replace({0}, '(<)(\\*)(/?s>|</?SYS>>)|(\[)(\\*)(/?INST\])', '\1\4\\\2\5\3\6', 'g')"
ORACLE_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, md5(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
      CASE role WHEN 'user' THEN 10 WHEN 'assistant' THEN 11 WHEN 'system' THEN 11 ELSE 19 + length({_ESC.format('role')}) END + length({_ESC.format('text')}) + 4 AS len FROM c),
e AS (SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY i) AS chars FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
      (sum(chars) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples
FROM e GROUP BY conv_id
"""
