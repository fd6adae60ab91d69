"""The shapes in which training sources come, each brought to documents: a table with ``text``.

A source is a table that Spark has read, such as by ``readers.any_of``, which gives an empty one for what is missing.  Rows that a shape
does not accept go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import strip
from loomtext.operators import chat, mix
from loomtext.operators.gates import language_gate, web_gate

#: Documents of a web source, and their least and greatest lengths.
WEB_DOCS, WEB_MORE_THAN, WEB_CUT = 50_000, 200, 8000


def _first(rows: DataFrame, *names: str) -> Column:
    """The first of the columns that the table has and that says something, trimmed."""
    found = [F.nullif(F.col(n), F.lit("")) for n in names if n in rows.columns]
    return strip(F.coalesce(*found, F.lit("")))


def _with(rows: DataFrame, text: Column) -> DataFrame:
    return rows.withColumn("text", text).filter(F.col("text").isNotNull() & (F.col("text") != ""))


def messages_in_languages(rows: DataFrame, more_than: int = 30) -> DataFrame:
    """Single messages (lang, text) in an allowed language or none, trimmed, of more than 30 characters."""
    return _with(rows.filter(language_gate(F.col("lang"))), strip(F.coalesce("text", F.lit("")))).filter(F.length("text") > more_than)


def chats(rows: DataFrame, messages: str = "messages") -> DataFrame:
    """Chats as arrays of (role, content)."""
    return _with(rows, chat.render(F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("text")))))


def shared_chats(rows: DataFrame, conversations: str = "conversations", more_than: int = 100) -> DataFrame:
    """Shared chats as arrays of (from, value), of more than 100 characters."""
    turns = F.transform(conversations, lambda m: F.struct(m["from"].alias("role"), m["value"].alias("text")))
    return _with(rows, chat.render_two_sided(turns)).filter(F.length("text") > more_than)


def instructions(rows: DataFrame) -> DataFrame:
    """Instructions with an input or a context, and an output or a response."""
    return _with(rows, chat.instruction(_first(rows, "instruction"), _first(rows, "input", "context"), _first(rows, "output", "response")))


def questions(rows: DataFrame) -> DataFrame:
    """Questions with answers (text: array), of which the first counts."""
    return _with(rows, chat.instruction(F.col("question"), F.lit(""), F.nullif(chat.first_answer(F.col("answers")), F.lit(""))))


def code(rows: DataFrame) -> DataFrame:
    """A prompt or instruction, and its completion or output as fenced code."""
    asked, done = _first(rows, "prompt", "instruction"), _first(rows, "completion", "output")
    return _with(rows, chat.instruction(asked, F.lit(""), F.when(done != "", chat.fenced(done))))


def books(rows: DataFrame) -> DataFrame:
    """Long texts (text or content) in pieces of 4000 characters: chunk_no, text."""
    whole = rows.withColumn("text", _first(rows, "text", "content"))
    return mix.chunks(whole).withColumnRenamed("chunk", "text")


def encyclopedia(rows: DataFrame, more_than: int = 500) -> DataFrame:
    """Articles of an encyclopedia that are plain text, trimmed, of more than 500 characters."""
    return rows.withColumn("text", strip(F.coalesce("text", F.lit("")))).filter(F.length("text") > more_than)


def filtered_web(rows: DataFrame, most: int, position: str = "doc_id", cut: int = 2000) -> DataFrame:
    """The first ``most`` web texts by ``position`` that pass the web gate, cut at 2000; the gate sees the whole text as it is."""
    kept = rows.withColumn("text", F.coalesce("text", F.lit(""))).filter(web_gate(F.col("text")))
    return mix.within_budget(kept, F.lit(1), most, [position]).withColumn("text", F.substring("text", 1, cut))


def web(rows: DataFrame, position: str = "doc_id", most: int = WEB_DOCS, more_than: int = WEB_MORE_THAN, cut: int = WEB_CUT) -> DataFrame:
    """The first 50,000 web texts by ``position`` of more than 200 characters, trimmed and cut at 8000: the cap of the source is its feature."""
    kept = rows.withColumn("text", strip(F.coalesce("text", F.lit("")))).filter(F.length("text") > more_than)
    return mix.within_budget(kept, F.lit(1), most, [position]).withColumn("text", F.substring("text", 1, cut))


def registered(sources: dict[str, DataFrame]) -> DataFrame:
    """source, doc_id, text of all sources: the input of ``mix.mixed_stream``.

    A text's number is its hash, so it does not depend on how files are laid out; rows of one source that are equal have one number.
    """
    each = [df.select(F.lit(name).alias("source"), F.xxhash64("text").alias("doc_id"), "text") for name, df in sources.items()]
    return reduce(DataFrame.unionByName, each)
