"""Chat formatting with a grammar round trip, by DataFrame functions alone.

A turn is written ``<s>`` role ``[INST]`` text ``</s>`` newline.  A deterministic parser reads the turns back; a turn that it doesn't read
back as it was is written again with its control strings escaped (a backslash after their first character; strings that look escaped get
one more, so that the reader can take exactly one away), which always gives the source.

Defined results: a null role or text is the empty string; turns are ordered by turn (null first), then role and text, so ties and repeated
rows all stay, in one order; a null conv_id is a conversation of its own; an empty table gives an empty table; extra columns are ignored.
A conversation is one output row by contract; everything before its last step is done turn by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.llm.common import table

# The control strings of the template and of common chat formats, which may not stand in a text as they are.
OPEN, BODY, CLOSE = "<s>", "[INST]", "</s>"
CONTROL = r"(<)(\\*)(/?s>|</?SYS>>|\|im_start\|>|\|im_end\|>)|(\[)(\\*)(/?INST\])"
MARK = r"<s>|</s>|<</?SYS>>|<\|im_start\|>|<\|im_end\|>|\[/?INST\]"
ESCAPED = r"(<)\\(\\*)(/?s>|</?SYS>>|\|im_start\|>|\|im_end\|>)|(\[)\\(\\*)(/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$4\\$2$5$3$6")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$4$2$5$3$6")


def rendered(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(BODY), body, F.lit(f"{CLOSE}\n"))


def parsed(formatted: Column) -> Column:
    """Array of (role, text) that the grammar finds in a formatted conversation."""
    pieces = F.split(formatted, rf"\Q{CLOSE}\E\n")
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        at = F.instr(piece, BODY)
        start = len(OPEN) + 1
        return F.struct(unescaped(piece.substr(F.lit(start), at - start)).alias("role"),
                        unescaped(piece.substr(at + len(BODY), F.length(piece))).alias("text"))

    return F.transform(turns, turn)


def formatted_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, piece, body): piece is the turn in the template, body its text as it stands there."""
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = clean.withColumn("piece", rendered(F.col("role"), F.col("text")))
    source = F.array(F.struct("role", "text"))
    # Besides its own three marks a turn may hold no control string.
    conflict = ~((parsed(F.col("piece")) == source) & (F.regexp_count("piece", F.lit(MARK)) == 3))
    return plain.select(
        "conv_id", "turn", "role", "text", conflict.alias("escapes"),
        F.when(conflict, rendered(escaped(F.col("role")), escaped(F.col("text")))).otherwise(F.col("piece")).alias("piece"),
        F.when(conflict, escaped(F.col("text"))).otherwise(F.col("text")).alias("body"))


def formatted_conversations(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, exact): one row per conversation.

    ``loss_spans`` are the code-point spans (start from 0, length) of ``formatted`` to learn from: the texts of the ``learned`` role.
    ``exact`` says that the parser reads the source's roles and texts back.  One shuffle, on conv_id.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    ends = order.rowsBetween(W.unboundedPreceding, 0)
    placed = formatted_turns(turns).withColumn("end", F.sum(F.length("piece").cast("long")).over(ends)).withColumn(
        "place", F.row_number().over(order))
    span = F.struct((F.col("end") - F.length("body") - len(CLOSE) - 1).alias("start"), F.length("body").cast("long").alias("length"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "place", "piece", "role", "text", F.when(F.col("role") == learned, span).alias("span")))).alias("rows"))
    joined = F.array_join(F.transform("rows", lambda r: r["piece"]), "")
    source = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    return whole.select(
        "conv_id", F.size("rows").cast("long").alias("n_turns"), joined.alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"), source.alias("source")).select(
        "conv_id", "n_turns", "formatted", "loss_spans", (parsed(F.col("formatted")) == F.col("source")).alias("exact"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say of themselves: digests of the parsed turns and of the text under the loss mask."""
    turns = F.transform(parsed(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join(F.transform("loss_spans", lambda s: unescaped(
        F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.select("conv_id", "exact", turns.alias("turns"), learned.alias("learned"),
                            F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "exact")


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], given.schema)
    return read_back(formatted_conversations(given.unionByName(added)))


#: The source's own digests; formatted_chars adds the template (14 code points a turn) and one backslash per escaped control string.
OP4_SQL = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
    select *, '(<)(\\*)(/?s>|</?SYS>>|\|im_start\|>|\|im_end\|>)|(\[)(\\*)(/?INST\])' as control from turns),
sized as (
    select *, length(role) + length(text) + 3 + 6 + 5 + len(regexp_extract_all(role, control)) + len(regexp_extract_all(text, control)) as chars
    from marked)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars, true as exact
from sized group by conv_id"""
