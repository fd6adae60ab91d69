"""Scans.  Every scan takes a path that Spark opens itself, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.config import SKIPPED_TITLES
from loomtext.functions import html as pages
from loomtext.functions import normalize
from loomtext.operators.gates import no_redirect, title_gate
from loomtext.operators.mix import running_sum
from loomtext.session import saved

DOCUMENT = "text string, source string, title string, url string"


def jsonl(spark: SparkSession, path: str, schema: str = DOCUMENT, bad: str = "_bad") -> DataFrame:
    """JSON lines; a line that is no JSON object has its text in ``bad`` and nulls elsewhere."""
    return parsed_lines(spark.read.text(path).withColumnRenamed("value", "line"), schema, "line", bad)


def parsed_lines(lines: DataFrame, schema: str = DOCUMENT, line: str = "line", bad: str = "_bad") -> DataFrame:
    """The same for a table of lines."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    parsed = F.from_json(line, f"{schema}, {bad} string", options)
    is_object = F.col(line).rlike(r"^\s*\{")
    out = lines.withColumn("_p", parsed)
    names = [f.split()[0] for f in schema.split(",")]
    failed = ~is_object | F.col(f"_p.{bad}").isNotNull()
    cols = [F.when(~failed, F.col(f"_p.{n}")).alias(n) for n in names]
    return out.select(*[c for c in lines.columns if c != line], *cols, F.when(failed, F.col(line)).alias(bad))


def _first_of_files(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in order of (file, pos): files are counted, and only the places of the file that crosses ``n`` are sorted, so no task gets the texts."""
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = rows.groupBy("file").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    last = files.filter(F.col("before") < n).orderBy(F.desc("file")).first()
    if last is None:
        return rows.limit(0)
    if last["before"] + last["n"] <= n:
        return rows.filter(F.col("file") <= last["file"])
    of_last = F.col("file") == last["file"]
    to = rows.filter(of_last).select("pos").orderBy("pos").limit(n - last["before"]).agg(F.max("pos")).first()[0]
    return rows.filter((F.col("file") < last["file"]) | (of_last & (F.col("pos") <= to)))


def corpus(spark: SparkSession, json_path: str | None, text_path: str | None = None, min_chars: int = 100, max_docs: int | None = None) -> DataFrame:
    """file, pos, text: JSON lines, normalised, the first ``max_docs`` in file order; then, if those did not fill the cap, whole text files, as they are.

    A cap of 0 is none.  A text file is one row, so it must fit a cell; what may grow beyond that belongs in JSON lines.
    """
    out = None
    if json_path:
        t = spark.read.schema("text string").json(json_path).select(F.col("_metadata.file_path").alias("file"), "text")
        t = t.withColumn("pos", F.monotonically_increasing_id()).withColumn("text", normalize.loaded(F.col("text"))).filter(F.length("text") >= min_chars)
        out = _first_of_files(t, max_docs) if max_docs else t
    if text_path and not (max_docs and out is not None and out.count() >= max_docs):
        t = spark.read.text(text_path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"), F.lit(0).cast("long").alias("pos")).filter(F.length("text") >= min_chars)
        out = t if out is None else out.unionByName(t)
    return out


def dump_pages(spark: SparkSession, path: str) -> DataFrame:
    """title, text of the pages of a MediaWiki XML dump."""
    schema = "title string, revision struct<text:struct<_VALUE:string>>"
    return spark.read.format("xml").option("rowTag", "page").schema(schema).load(path).select("title", F.col("revision.text._VALUE").alias("text"))


def articles(dump: DataFrame, min_chars: int = 500, cap: int | None = None) -> DataFrame:
    """Cleaned articles of a dump: no other namespaces, no redirects, long enough; the first ``cap`` by title."""
    kept = dump.filter(title_gate(F.col("title"), SKIPPED_TITLES) & F.col("text").isNotNull() & no_redirect(F.col("text")))
    kept = kept.withColumn("text", normalize.clean_wikitext(F.col("text"))).filter(F.length("text") >= min_chars).withColumn("chars", F.length("text"))
    return kept.orderBy("title").limit(cap) if cap is not None else kept


def forum_posts(listing: DataFrame, min_score: int = 10) -> DataFrame:
    """Self-posts with a text and enough points."""
    return listing.filter((F.col("score") >= min_score) & F.col("is_self") & (F.coalesce("selftext", F.lit("")) != ""))


def web_pages(fetched: DataFrame, min_chars: int = 200, cut: int = 5000, exact: bool = True) -> DataFrame:
    """url, text, chars, domain of fetched pages (url, html), each address once, long enough, cut."""
    once = fetched.filter("url is not null").groupBy("url").agg(F.min("html").alias("html"))
    text = pages.page_text(F.col("html")) if exact else pages.page_text_approx(F.col("html"))
    t = once.select("url", text.alias("text")).filter(F.length("text") >= min_chars)
    return t.select("url", F.substring("text", 1, cut).alias("text"), F.least(F.length("text"), F.lit(cut)).alias("chars"), pages.netloc(F.col("url")).alias("domain"))


def crawl(links: DataFrame, start: str, max_pages: int, per_page: int = 20) -> DataFrame:
    """url, depth, rank: pages reached breadth-first from ``start`` within its host, as ``crawl_hosts`` finds them."""
    return crawl_hosts(links, links.sparkSession.createDataFrame([(start,)], "url string"), max_pages, per_page).drop("host")


def crawl_hosts(links: DataFrame, starts: DataFrame, max_pages: int = 500, per_page: int = 20, log: list[int] | None = None) -> DataFrame:
    """host, url, depth, rank: the first ``max_pages`` pages of each host, breadth-first from its start (the least url of ``starts``).

    Over (from_url, pos, href), absolute addresses, the first ``per_page`` of a page.  All hosts go on by one level at a time; within a level pages stand in the order of their parents
    and of the links on them, so a level's ranks are running sums in two levels.  Visited pages and the frontier are saved tables: nothing is held by the driver,
    and a host ends where it has no new page, however deep.  ``log`` gets the size of each level.
    """
    host = pages.netloc
    usable = saved(links.filter((F.col("pos") < per_page) & (host(F.col("href")) == host(F.col("from_url")))).select("from_url", "pos", "href").distinct())
    level = saved(starts.filter("url is not null").groupBy(host(F.col("url")).alias("host")).agg(F.min("url").alias("url")).select("host", "url", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("rank")))
    visited, depth = level, 0
    while n := level.count():
        if log is not None:
            log.append(n)
        depth += 1
        found = usable.join(level.select(F.col("url").alias("from_url"), "host", "rank"), "from_url").groupBy("host", "href").agg(F.min(F.struct("rank", "pos")).alias("at"))
        new = saved(found.join(visited.select(F.col("url").alias("href")), "href", "left_anti").select("host", "href", F.col("at.rank").alias("parent"), F.col("at.pos").alias("pos"), F.lit(1).alias("one")))
        ahead = level.groupBy("host").agg((F.max("rank") + 1).alias("base"))
        ranked = running_sum(new, "one", "n", ["parent", "pos", "href"], ["host"], exclusive=True).join(ahead, "host")
        level = saved(ranked.select("host", F.col("href").alias("url"), F.lit(depth).alias("depth"), (F.col("base") + F.col("n")).cast("long").alias("rank")).filter(F.col("rank") < max_pages))
        visited = visited.unionByName(level)
        if depth % 8 == 0:  # so that a deep host's plan stays short
            visited = saved(visited)
    return visited


def any_of(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A directory of a source that may be missing: empty then."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def conversations_json(lines: DataFrame, line: str = "line") -> DataFrame:
    """messages: arrays of (role, content) with two messages or more."""
    return lines.withColumn("messages", F.from_json(line, "array<struct<role:string,content:string>>")).filter(F.size("messages") >= 2).drop(line)


def log_lines(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """A metric log; bad lines are left out."""
    return parsed_lines(lines, schema, line).filter("_bad is null").drop("_bad")


def token_file(spark: SparkSession, path: str) -> DataFrame:
    """ids of flat files of unsigned 16-bit tokens."""
    import numpy as np

    @F.pandas_udf("array<int>")
    def ids(content):
        return content.map(lambda b: np.frombuffer(b, "<u2").astype("int32"))

    return spark.read.format("binaryFile").load(path).select("path", ids("content").alias("ids"))


def top_logits(spark: SparkSession, path: str) -> DataFrame:
    """pos, id, p of stored teacher batches: parquet rows (pos, array of (id, p))."""
    return spark.read.parquet(path).select("pos", F.inline("top"))


def ranked_pieces(spark: SparkSession, path: str) -> DataFrame:
    """id, piece of a vocabulary file whose lines are a piece in base64 and its rank."""
    parts = F.split("value", " ")
    return spark.read.text(path).filter("value <> ''").select(parts[1].cast("int").alias("id"), F.unbase64(parts[0]).alias("piece"))
