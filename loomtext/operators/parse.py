"""Parsing of model replies and of streamed answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import SPACE, bound, strip

BULLET = r"^(?:[-*]|[0-9]+[).])"
CATEGORY = r"(?i)\[CAT:[{0}]*([^\]]+)\]".format(SPACE)


def facts_and_topics(replies: DataFrame, raw: str = "raw", key: str = "id", facts: int = 12, topics: int = 8) -> DataFrame:
    """key, kind (fact or topic), n (from 1), content, category.

    Headings set the section that bullets below inherit; bullets of under 15 characters are left out.  A reply of over 50
    characters in which neither was found gives its long lines as facts.
    """
    lines = replies.select(key, raw, F.posexplode(F.split(raw, "\n")).alias("line_no", "line")).withColumn("line", strip(F.col("line")))
    up = F.upper("line")
    section = F.when(up.startswith("FAIT"), "fact").when(up.startswith("SUJET") | up.startswith("CONNEXES"), "topic")
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("heading", section).withColumn("kind", F.last("heading", ignorenulls=True).over(before))
    content = strip(F.regexp_replace("line", rf"^[-*\p{{Nd}}).{SPACE}]+", ""))
    found = lines.filter(F.col("heading").isNull() & F.col("kind").isNotNull() & F.col("line").rlike(BULLET)).withColumn("content", content).filter(F.length("content") >= 15)
    is_fact = F.col("kind") == "fact"
    category = F.when(is_fact & F.col("content").rlike(CATEGORY), strip(F.regexp_extract("content", CATEGORY, 1)))
    found = found.withColumn("category", category).withColumn("content", F.when(is_fact, strip(F.regexp_replace("content", r"\[CAT:[^\]]*\]", ""))).otherwise(F.col("content"))).filter("content <> ''")
    found = found.select(key, "kind", "line_no", "content", "category")
    bare = strip(F.regexp_replace("line", r"^[-*]+", ""))
    rest = lines.filter(F.length(raw) > 50).withColumn("content", bare).filter((F.length("content") > 40) & (F.length("content") < 400))
    rest = rest.join(found.select(key).distinct(), key, "left_anti").select(key, F.lit("fact").alias("kind"), "line_no", "content", F.lit(None).cast("string").alias("category"))
    n = F.row_number().over(Window.partitionBy(key, "kind").orderBy("line_no"))
    return found.unionByName(rest).withColumn("n", n).filter(F.col("n") <= F.when(F.col("kind") == "fact", facts).otherwise(topics)).drop("line_no")


def action(reply: Column) -> Column:
    """answer, tool and args of a reply: args is a map, empty if it is not JSON; what is missing is null."""
    tag = lambda name, flags: F.when(reply.rlike(f"{flags}<{name}>.*?</{name}>"), strip(F.regexp_extract(reply, f"{flags}<{name}>(.*?)</{name}>", 1)))
    args = F.from_json(tag("args", "(?s)"), "map<string,string>")
    return F.struct(tag("answer", "(?s)").alias("answer"), tag("tool", "").alias("tool"), F.coalesce(args, F.create_map().cast("map<string,string>")).alias("args"))


def sentences(text: Column, n: int = 5) -> Column:
    """The first sentences, parted by white space after a mark."""
    return F.slice(F.split(text, rf"(?<=[.!?])[{SPACE}]+"), 1, n)


#: What JSON values count as nothing, as text.
_NOTHING = ("", "false", "0", "0.0", "[]", "{}")
_REPLY = "error string, response string, thinking string, message struct<content:string,thinking:string>, text string, output string, completion string, done boolean"


def _reply(line: Column) -> Column:
    """The fields of a JSON object; null for anything else."""
    return F.when(line.rlike(rf"^[{SPACE}]*\{{"), F.from_json(line, _REPLY))


def _said(value: Column) -> Column:
    return F.when(value.isNotNull() & ~value.isin(*_NOTHING), value)


def streamed(chunks: DataFrame, key: str = "id", position: str = "pos", line: str = "line") -> DataFrame:
    """key, text: what the JSON lines of a streamed reply say, up to the first that is done, trimmed.

    Each line adds its ``response`` and its ``message.content``, and ``thinking`` as long as nothing was added before.  Lines that are no
    object or report an error are skipped, also if they are done.
    """
    j = lambda c: F.col(f"_j.{c}")
    kept = chunks.withColumn("_j", _reply(F.col(line))).filter(F.col("_j").isNotNull() & _said(j("error")).isNull())
    before = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    content = F.nullif(j("message.content"), F.lit(""))
    adds = j("response").isNotNull() | j("thinking").isNotNull() | content.isNotNull()
    kept = kept.withColumn("_done", F.max(F.coalesce(j("done"), F.lit(False))).over(before)).withColumn("_begun", F.max(adds).over(before))
    thought = F.when(~F.coalesce("_begun", F.lit(False)) & j("response").isNull(), j("thinking"))
    piece = F.concat_ws("", j("response"), thought, content)
    kept = kept.filter(~F.coalesce("_done", F.lit(False))).select(key, F.struct(position, piece.alias("p")).alias("_p"))
    text = strip(F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda x: x["p"]), ""))
    return chunks.select(key).distinct().join(kept.groupBy(key).agg(text.alias("text")), key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def reply_text(reply: Column, cut: int = 2000) -> Column:
    """The text of a JSON reply: the first of response, thinking, message.content, message.thinking, text, output and completion that says something.

    Trimmed; thinking is cut at ``cut`` characters, the outer one with dots.  Empty for an error or what is no object.
    """

    def body(j: Column) -> Column:
        thought, inner = strip(j["thinking"]), strip(j["message"]["thinking"])
        said = [F.when(_said(j["response"]).isNotNull(), strip(j["response"]))]
        said += [F.when(_said(j["thinking"]).isNotNull(), F.when(F.length(thought) > cut, F.concat(F.substring(thought, 1, cut), F.lit("..."))).otherwise(thought))]
        said += [F.when(_said(j["message"]["content"]).isNotNull(), strip(j["message"]["content"])), F.when(_said(j["message"]["thinking"]).isNotNull(), F.substring(inner, 1, cut))]
        said += [F.when(_said(j[name]).isNotNull(), strip(j[name])) for name in ("text", "output", "completion")]
        return F.when(_said(j["error"]).isNull(), F.coalesce(*said))

    return F.coalesce(bound(_reply(reply), body), F.lit(""))


def resume_point(names: DataFrame, name: str = "name", first: tuple[str, ...] = ("distill_latest.pt", "distill_final.pt")) -> DataFrame:
    """name, step of the checkpoint to go on from: one of ``first``, in that order, else the highest step of ``distill_s<step>.pt``; none: no row."""
    rank = F.coalesce(*[F.when(F.col(name) == x, F.lit(i)) for i, x in enumerate(first)], F.lit(len(first)))
    step = F.nullif(F.regexp_extract(name, r"^distill_s([0-9]+)\.pt$", 1), F.lit("")).cast("long")
    found = names.withColumn("step", step).withColumn("_rank", rank).filter((F.col("_rank") < len(first)) | F.col("step").isNotNull())
    return found.orderBy("_rank", F.desc("step"), name).limit(1).drop("_rank")
