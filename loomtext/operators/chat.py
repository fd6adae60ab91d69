"""Conversations: rendering, pairing, training targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.config import ASST, BOS, EOS, PAD, USER
from loomtext.functions.text import bound, strip
from loomtext.session import saved


def turns(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation with its turns in order: array of (turn, role, text)."""
    return rows.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def _line(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))


def _spoken(turns: Column, role) -> Column:
    """Turns that say something, trimmed, as marked lines under the role that ``role`` makes of theirs; a null role leaves the turn out."""
    said = F.transform(turns, lambda t: F.struct(role(F.lower(F.coalesce(t["role"], F.lit("")))).alias("role"), strip(F.coalesce(t["text"], F.lit(""))).alias("text")))
    return F.array_join(F.transform(F.filter(said, lambda t: t["role"].isNotNull() & (t["text"] != "")), lambda t: _line(t["role"], t["text"])), "")


def render(turns: Column) -> Column:
    """User and assistant turns (roles in any case) as marked lines, trimmed; blank turns and other roles are left out."""
    return _spoken(turns, lambda r: F.when(r.isin("user", "assistant"), r))


def render_two_sided(turns: Column) -> Column:
    """The policy of shared chats: ``human``, so written, is the user, every other role the assistant."""
    spoken = F.transform(turns, lambda t: F.struct(F.when(F.coalesce(t["role"] == "human", F.lit(False)), F.lit("user")).otherwise(F.lit("assistant")).alias("role"), t["text"].alias("text")))
    return _spoken(spoken, lambda r: r)


def instruction(instruction: Column, given: Column, output: Column) -> Column:
    """An instruction with its input, if any, and the answer, as a user and an assistant turn, trimmed; null without instruction or answer."""
    a, b, c = (strip(F.coalesce(x, F.lit(""))) for x in (instruction, given, output))
    asked = F.when(b != "", F.concat(a, F.lit("\n"), b)).otherwise(a)
    return F.when((a != "") & (c != ""), F.concat(_line(F.lit("user"), asked), _line(F.lit("assistant"), c)))


def first_answer(answers: Column) -> Column:
    return F.get(answers["text"], F.lit(0))


def fenced(code: Column) -> Column:
    return F.concat(F.lit("```\n"), code, F.lit("\n```"))


def tree_threads(messages: DataFrame, log: list[int] | None = None) -> DataFrame:
    """root, depth, message_id of the messages of each thread that is taken over: depth 0 is the root.

    From (arrival, message_id, parent_id, role); ids and arrivals must be distinct.  A message can be taken over if it is a root or the prompter's; by the first
    child that arrives after it, whoever asks.  That choice looks at arrivals alone, so the taken links are paths, and a path is a thread if its top is a root.  Tops are found by
    pointer doubling over narrow rows: each round a message jumps to where its jump leads, so a path of depth d takes about log2(d) rounds; ``log`` gets the
    open jumps of each.
    """
    m = saved(messages.select("arrival", "message_id", "parent_id", "role"))
    roots = m.filter("parent_id is null").select(F.col("message_id").alias("root"))
    open_ = m.filter("parent_id is null or role = 'prompter'").select(F.col("message_id").alias("parent_id"), F.col("arrival").alias("since"))
    kids = m.filter("parent_id is not null and role in ('assistant', 'prompter')").join(open_, "parent_id").filter("arrival > since")
    links = kids.groupBy("parent_id").agg(F.min(F.struct("arrival", "message_id")).alias("k")).select(F.col("k.message_id").alias("node"), F.col("parent_id").alias("jump"), F.lit(1).alias("hops"))
    links = saved(links)
    inner = links.select(F.col("node").alias("jump"), F.lit(False).alias("top"))
    paths = saved(links.join(inner, "jump", "left").select("node", "jump", "hops", F.coalesce("top", F.lit(True)).alias("top")))
    while n := paths.filter("not top").count():
        if log is not None:
            log.append(n)
        to = paths.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("hops").alias("more"), "top")
        moved = paths.filter("not top").drop("top").join(to, "jump").select("node", F.col("next").alias("jump"), (F.col("hops") + F.col("more")).alias("hops"), "top")
        paths = saved(paths.filter("top").unionByName(moved))
    taken = paths.join(roots, F.col("jump") == F.col("root"), "left_semi").select(F.col("jump").alias("root"), F.col("hops").alias("depth"), F.col("node").alias("message_id"))
    return roots.select("root", F.lit(0).alias("depth"), F.col("root").alias("message_id")).unionByName(taken)


def tree_pairs(messages: DataFrame, more_than: int = 100, cut: int = 2000, log: list[int] | None = None) -> DataFrame:
    """Threads of a message tree: (message_id, full), by the message that closes each.

    From (arrival, message_id, parent_id, role, lang, text).  A root opens; the first child by arrival takes the thread over: if it is
    the assistant's, it closes and emits it, if the prompter's, it carries it on.  A child that comes before
    its parent's thread is open, or after it was taken, is left.  Of a thread only as many messages meet as ``cut`` characters can hold.
    """
    least = 20
    m = messages.withColumn("text", strip(F.coalesce("text", F.lit("")))).filter((F.length("text") >= least) & F.coalesce(F.lower("lang"), F.lit("")).isin("", "fr", "en"))
    m = saved(m)
    threads = saved(tree_threads(m, log))
    closed = threads.join(m.filter("role = 'assistant' and parent_id is not null").select("message_id"), "message_id").select("root", F.col("message_id").alias("closing"))
    heads = threads.filter(F.col("depth") <= max(cut, more_than + 1) // least).join(closed, "root")
    line = _line(F.when((F.col("depth") > 0) & (F.col("role") == "assistant"), "assistant").otherwise("user"), F.col("text"))
    parts = heads.join(m.select("message_id", "role", "text"), "message_id").select("closing", F.struct("depth", line.alias("line")).alias("part"))
    whole = parts.groupBy(F.col("closing").alias("message_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["line"]), "").alias("full"))
    return whole.filter(F.length("full") > more_than).withColumn("full", F.substring("full", 1, cut))


def training_ids(messages: Column) -> Column:
    """BOS, for each message its role's token and its ids, EOS; every role but the user's is the assistant's."""
    body = F.flatten(F.transform(messages, lambda m: F.concat(F.array(F.when(m["role"] == "user", USER).otherwise(ASST)), m["ids"])))
    return F.concat(F.array(F.lit(BOS)), body, F.array(F.lit(EOS)))


def shifted(ids: Column) -> tuple[Column, Column]:
    """Inputs and targets: all but the last, all but the first."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n)


def length_gate(ids: Column, more_than: int = 10, at_most: int = 1024) -> Column:
    return (F.size(ids) > more_than) & (F.size(ids) <= at_most)


def padded_batches(df: DataFrame, inputs: str, targets: str, batch: int, position: str) -> DataFrame:
    """Rows in batches of ``batch`` along ``position``, filled up to the longest: inputs with PAD, targets with -1."""
    from loomtext.operators.mix import shard_ids

    df = shard_ids(df, batch, [position]).withColumnRenamed("shard_id", "batch_id")
    longest = F.max(F.size(inputs)).over(Window.partitionBy("batch_id"))
    df = df.withColumn("_n", longest)
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("_n") - F.size(c)))
    return df.withColumn(inputs, fill(F.col(inputs), PAD)).withColumn(targets, fill(F.col(targets), -1)).drop("_n")


def continuation_targets(ids: Column, starts: Column, prompt_chars: Column) -> Column:
    """Targets with -1 at positions 1 up to the first token that starts at or behind the prompt; unchanged without one."""
    at = F.array_min(F.filter(F.transform(starts, lambda s, i: F.when(s >= prompt_chars, i)), lambda i: i.isNotNull()))

    # found once a row: in the lambda of every token it would be found anew
    def masked(at: Column) -> Column:
        below = F.transform(ids, lambda x, i: F.when((i >= 1) & (i < at), -1).otherwise(x))
        return F.when((prompt_chars <= 0) | (F.size(ids) < 3) | at.isNull() | (at < 1), ids).otherwise(below)

    return bound(at, masked)


def recent_interests(rows: DataFrame, files: int = 5, limit: int = 30) -> DataFrame:
    """Distinct user messages of 21 to 199 characters, cut at 150, of the newest files: (modified, position, text) in, ordered by first place."""
    newest = rows.select("modified").distinct().orderBy(F.desc("modified")).limit(files)
    said = rows.join(newest, "modified", "left_semi").filter("role = 'user'").withColumn("topic", strip(F.coalesce("text", F.lit(""))))
    said = said.filter((F.length("topic") > 20) & (F.length("topic") < 200)).withColumn("topic", F.substring("topic", 1, 150))
    first = said.groupBy("topic").agg(F.min(F.struct((-F.col("modified").cast("double")).alias("age"), "position")).alias("at"))
    return first.orderBy("at").limit(limit).select("topic")
