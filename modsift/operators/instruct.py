"""Question-answer pairs and instruction records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modsift import values as V
from modsift.functions import scores as S
from modsift.functions.text import as_col
from modsift.operators.scale import hash_rank


def conversation_pairs(df: DataFrame, conv: str, turn: str, role: str, text: str, chunk: int = 1000) -> DataFrame:
    """Each user turn with the next turn that is there, if that is the assistant's.

    Turn numbers may have gaps.  A conversation is cut into chunks of turn numbers: the next turn is looked up inside a
    chunk, and for its last turn it is the first one of the next chunk that has any, so a long conversation is many
    small windows.  Of rows that share a turn number one is taken, by role and text.
    """
    rows = df.where(F.col(turn).isNotNull()).groupBy(conv, turn).agg(F.min(F.struct(F.col(role).alias("role"), F.col(text).alias("text"))).alias("__said"))
    rows = rows.withColumn("__chunk", F.floor(F.col(turn) / chunk))
    inside = Window.partitionBy(conv, "__chunk").orderBy(turn)
    firsts = rows.groupBy(conv, "__chunk").agg(F.min_by("__said", turn).alias("__first"))
    after = firsts.select(conv, "__chunk", F.lead("__first").over(Window.partitionBy(conv).orderBy("__chunk")).alias("__after"))
    found = rows.withColumn("__next", F.lead("__said").over(inside)).join(after, [conv, "__chunk"])
    reply = F.coalesce("__next", "__after")
    pairs = found.where((F.col("__said.role") == "user") & (reply["role"] == "assistant"))
    return pairs.select(conv, turn, F.col("__said.text").alias("question"), reply["text"].alias("answer"))


def conversation_records(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("data_type", F.lit("CONVERSATION")).withColumn("quality_score", F.lit(0.7))


def instruction_records(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("data_type", F.lit("INSTRUCTION_FOLLOWING")).withColumn("quality_score", F.lit(0.8))


def instruction_text(data_type: Column | str) -> Column:
    data_type = as_col(data_type)
    out = F.when(data_type.isNull(), F.lit(V.DEFAULT_INSTRUCTION))
    for name, words in V.INSTRUCTIONS.items():
        out = out.when(data_type == name, F.lit(words))
    return out.otherwise(F.lit(V.DEFAULT_INSTRUCTION))


def training_input(question: Column | str, topics: Column | str | None = None, context: Column | str | None = None) -> Column:
    parts = [F.lit(V.QUESTION_PREFIX), as_col(question)]
    if topics is not None:
        topics = as_col(topics)
        parts.append(
            F.when(F.size(topics) > 0, F.concat(F.lit(V.TOPIC_PREFIX), F.array_join(topics, ", "))).otherwise(F.lit(""))
        )
    if context is not None:
        context = as_col(context)
        parts.append(F.when(context.isNotNull(), F.concat(F.lit(V.CONTEXT_PREFIX), context)).otherwise(F.lit("")))
    return F.concat(*parts)


def to_instruction_format(
    df: DataFrame, question: str = "question", answer: str = "answer", data_type: str = "data_type",
    topics: str | None = None, context: str | None = None, meta: dict[str, Column] | None = None,
) -> DataFrame:
    """Add the instruction record as struct ``record``: instruction, input, output, metadata."""
    kind = F.coalesce(F.col(data_type), F.lit("QUESTION_ANSWER"))
    extra = [c.alias(k) for k, c in (meta or {}).items()]
    record = F.struct(
        instruction_text(data_type).alias("instruction"),
        training_input(question, topics, context).alias("input"),
        F.concat(F.lit(V.ANSWER_PREFIX), F.col(answer)).alias("output"),
        F.struct(*extra, kind.alias("data_type")).alias("metadata"),
    )
    return df.withColumn("record", record)


def to_simple_format(df: DataFrame, question: str = "question", answer: str = "answer", input_cap: int | None = None, output_cap: int | None = None) -> DataFrame:
    """Fixed-instruction record; optional length caps come from the training configuration."""
    q = F.concat(F.lit(V.QUESTION_PREFIX), F.col(question))
    a = F.concat(F.lit(V.ANSWER_PREFIX), F.col(answer))
    record = F.struct(
        F.lit(V.SIMPLE_INSTRUCTION).alias("instruction"),
        (F.substring(q, 1, input_cap) if input_cap else q).alias("input"),
        (F.substring(a, 1, output_cap) if output_cap else a).alias("output"),
    )
    return df.withColumn("record", record)


def assign_training_batches(df: DataFrame, row_id: Column, size: int = 1000, seed: str = "batch|") -> DataFrame:
    """Number valid samples and cut them into batches of ``size``; only the last batch is short.

    Arrival order carries no meaning between samples, so the order is the hash of the
    id: batches come out exact and no task ever sorts the whole table.
    """
    ranked = hash_rank(df, row_id, seed)
    batch = F.floor(F.col("rank") / size)
    full = (batch + 1) * size <= F.col("total")
    return ranked.withColumn("batch_id", batch).withColumn("batch_complete", full).drop("rank", "total")


def parse_training_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Epoch, loss and learning rate found in log lines; null where a line has none."""
    def after(word: str, value: str) -> Column:
        found = F.regexp_extract(line, rf"(?:^|\s){word}\s+{value}(?=\s|$)", 1)
        return F.when(found != "", found)

    number = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
    return (
        lines.withColumn("epoch", after("Epoch", r"(\d+)/\S*").try_cast("int"))
        .withColumn("loss", after("loss", number).try_cast("double"))
        .withColumn("learning_rate", after("learning_rate", number).try_cast("double"))
    )
