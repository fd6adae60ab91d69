"""Cases that the tables do not hold, and operators that SQL cannot express, against plain Python."""

import itertools
import math
import json
import random
import re
import time
import unicodedata
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.functions import html, normalize, text
from loomtext.operators import chat, dedup, gates, metrics, mix, parse, recall, seen, tokens, training, vocab
from loomtext.sources import flat, readers, shapes, writers
from loomtext.streaming import ingest, loop


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("column", "given", "expected"),
    [
        (normalize.newline_repair, "a\\nb", "a\\nb"),
        (normalize.newline_repair, "a\\nb\\nc\\td", "a\nb\nc d"),
        (normalize.newline_repair, "a\\nb\\nc\nd\ne", "a\\nb\\nc\nd\ne"),
        (normalize.newline_repair, "a\r\nb\rc", "a\nb\nc"),
        (normalize.wiki_tail_cut, "a\n\nVoir aussi : b\nc", "a"),
        (normalize.wiki_tail_cut, "on peut voir aussi b\nc ", "on peut voir aussi b\nc "),
        (normalize.wiki_tail_cut, "a\n NOTES ET RÉFÉRENCES \nb", "a\n NOTES ET RÉFÉRENCES \nb".split("\n")[0]),
        (normalize.without_templates, "keep1\nkeep2\nx}} y\nz", " y\nz"),
        (normalize.without_templates, "a {{b {{c}} d}} e", "a  e"),
        (normalize.without_tables, "a {| b\n| c |} d", "a  d"),
        (normalize.unwrapped_links, "[[a|b]] [[c]]", "b c"),
        (normalize.plain_headings, "== T ==", "\n\nT\n\n"),
        (normalize.without_tags, "<b>x</b>&nbsp;y&eacute;&#12;", "x y  "),
        (normalize.clean, "[[Catégorie:X]] ﬁn １２", "Catégorie:X fin 12"),
        (normalize.clean, None, ""),
    ],
)
def test_normalise(spark, column, given, expected):
    assert one(spark, column, given) == expected


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("a " + "{{x " * 20 + "}}" * 20 + " b", "a  b"),  # twenty rounds take twenty levels
        ("a " + "{{x " * 21 + "}}" * 21 + " b", "a {{x }} b"),  # the outermost is left, and closed it is no orphan
        ("keep\n{{open\nstill\n", "keep\n"),
    ],
)
def test_deep_templates_fall_to_the_orphan_rules(spark, given, expected):
    assert one(spark, normalize.without_templates, given) == expected


def test_nfkc(spark):
    t = "ﬁ ①é"
    assert one(spark, normalize.nfkc, t) == unicodedata.normalize("NFKC", t)


def test_words_follow_python(spark):
    t = "a b\u001fc 　d "
    assert one(spark, text.words, t) == t.split()


def test_page_text(spark):
    page = "<p>a &amp; b</p><script>x<y</script><nav>n</nav>\n c"
    assert one(spark, html.page_text, page) == "a & b\nc"
    assert one(spark, html.page_text_approx, page) == "a & b\nc"


_WORDS = " ".join(f"mot{i:02d}" for i in range(20))  # 119 characters, twenty distinct words


@pytest.mark.parametrize(
    ("given", "gate"),
    [
        ("x" * 99, "chars"),
        (" ".join(["motlong"] * 19), "words"),
        (" ".join(f"m{i:04d}" for i in range(20)), "alpha"),  # four of each word's five characters are digits
        (_WORDS.replace("0", "o").replace("1", "i"), "kept"),
        (" ".join(["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"] * 4), "unique"),  # 6 of 24
        (" ".join(["abcde", "fghij", "klmno", "pqrst", "uvwxy", "zabcd"] + ["abcde"] * 14), "kept"),  # 6 of 20 is the bound itself
        ("\n".join(f"{x * 4} {x * 4}z {x * 8}" for x in "abcdefghijk"), "lines"),  # eleven lines of 19
        ("\n".join(f"{x * 4} {x * 4}z {x * 9}" for x in "abcdefghijk"), "kept"),  # eleven of 20
        ("\n".join(f"{x * 4} {x * 4}z {x * 8}" for x in "abcdefghij"), "kept"),  # ten of 19
    ],
)
def test_quality_at_its_bounds(spark, given, gate):
    assert one(spark, lambda c: gates.first_failure(gates.quality_rules(c)), given) == gate


def test_contradiction_needs_a_negation_in_the_candidate(spark):
    facts = spark.createDataFrame([(0, "la terre est ronde"), (1, "le fer ne rouille pas du tout")], "pos int, fact string")
    said = ["la terre est ronde et aucun doute", "la terre est ronde", "La Terre est ronde et non plate", "le fer ne rouille", "terre est pas ", None]
    got = {r["fact"]: r["is_contradicted"] for r in recall.contradicted(facts, spark.createDataFrame([(x,) for x in said], "fact string")).collect()}
    assert got == {said[0]: True, said[1]: False, said[2]: False, said[3]: False, said[4]: False, None: False}


def test_context_says_what_there_is(spark):
    facts = spark.createDataFrame([(i, f"fait {i}") for i in range(12)], "pos int, fact string")
    prefs = spark.createDataFrame([("ton", 'dit "bref"'), ("langue", "fr")], "key string, value string")
    say = lambda f, p, q=None: recall.context(f, p, q).first()["context"]
    last = "Faits connus:\n" + "\n".join(f"- fait {i}" for i in range(2, 12))
    assert say(facts, prefs) == 'Préférences: {"langue": "fr", "ton": "dit \\"bref\\""}\n' + last
    assert say(facts, prefs.limit(0)) == last and say(facts.limit(0), prefs.limit(0)) == "(mémoire vide)"
    assert say(facts, prefs.limit(0), "fait 3") == "Faits connus:\n- fait 3\n" + "\n".join(f"- fait {i}" for i in (0, 1, 2, 4, 5, 6, 7, 8, 9))


def test_rendering_trims_and_lowers(spark):
    turns = [[(0, "System", "s"), (1, "USER", " a "), (2, "assistant", " \n"), (3, "Assistant", "b"), (4, None, "c")], [(0, "human", " a"), (1, "user", "b "), (2, "gpt", " ")]]
    df = spark.createDataFrame([(t,) for t in turns], "turns array<struct<turn:int,role:string,text:string>>")
    assert [r[0] for r in df.select(chat.render(F.col("turns"))).collect()] == ["<|user|>\na\n<|assistant|>\nb\n", "<|user|>\nb\n"]
    assert df.select(chat.render_two_sided(F.col("turns"))).collect()[1][0] == "<|user|>\na\n<|assistant|>\nb\n"


def test_known_texts_against_all_pairs(spark):
    rng = random.Random(11)
    made = lambda n: [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(n)]
    cand, known = made(60), made(25)
    near = lambda c, k: len(set(c.split()) & set(k.split())) >= 0.6 * len(set(c.split()))
    got = {r["c"]: r["is_known"] for r in dedup.contained(spark.createDataFrame([(x,) for x in cand], "c string"), spark.createDataFrame([(x,) for x in known], "k string"), "c", "k", 0.6).collect()}
    assert got == {c: len(set(c.split())) >= 3 and any(near(c, k) for k in known) for c in cand}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_memory_takes_facts_as_one_by_one(spark, seed):
    """Short facts over few words, so that kept, refused and again kept ones follow each other in long chains."""
    from test_queries import plain_memory

    rng, log = random.Random(seed), []
    facts = [(i, " ".join(rng.choice("abcdefghijk"[: 7 + seed]) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    got = dedup.learned(spark.createDataFrame(facts, "pos long, fact string"), "fact", "pos", log=log)
    assert {r["pos"] for r in got.collect() if r["is_learned"]} == plain_memory(facts)
    assert 1 < len(log) < 12


def test_registered_sources_mix_at_random(spark, sf_dir, tmp_path):
    """Two sources of the same texts: each prefix once, shares by weight, and no dependence on how files are laid out."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) > 600").select("text")
    distinct = texts.select(F.substring("text", 1, 500)).distinct().count()
    outs = []
    for n in (1, 5):
        texts.repartition(n).write.parquet(f"{tmp_path}/{n}")
        both = shapes.registered({"a": spark.read.parquet(f"{tmp_path}/{n}"), "b": spark.read.parquet(f"{tmp_path}/{n}")})
        rows = mix.mixed_stream(both, {"a": 1.0, "b": 1.0}, quality=False).collect()
        assert len(rows) == distinct
        outs.append(sorted((r["source"], r["doc_id"]) for r in rows))
    assert outs[0] == outs[1]
    assert 0.3 < sum(s == "a" for s, _ in outs[0]) / distinct < 0.7


def test_running_sum_over_a_union_of_single_partitions(spark):
    one = lambda name: spark.range(0, 50, 1, 1).select(F.lit(name).alias("source"), F.col("id").alias("doc_id"), F.lit(1.5).alias("v"))
    got = mix.arrivals(one("a").unionByName(one("b")), {"a": 1.0, "b": 2.0})
    assert got.groupBy("source").agg(F.count("*"), F.max("arrival")).count() == 2


def test_resume_takes_the_general_checkpoints_first(spark):
    at = lambda *names: parse.resume_point(spark.createDataFrame([(n,) for n in names], "name string")).first()
    assert at("distill_s9.pt", "distill_s10.pt", "distill_s11.txt")["name"] == "distill_s10.pt"
    assert at("distill_s9.pt", "distill_final.pt")["name"] == "distill_final.pt"
    assert at("distill_final.pt", "distill_latest.pt")["name"] == "distill_latest.pt" and at("step_9.pt") is None


def test_saved_chats_that_open_alike_stay(spark):
    chat_of = lambda *x: [{"role": "user" if i % 2 == 0 else "assistant", "content": t} for i, t in enumerate(x)]
    rows = [chat_of("Bonjour"), chat_of("Bonjour", "a"), chat_of("Bonjour", "a", "b"), chat_of("Bonjour", "c"), chat_of("Bonjour", "c"), []]
    df = spark.createDataFrame([(r,) for r in rows], "messages array<struct<role:string,content:string>>")
    got = sorted([m["content"] for m in r["messages"]] for r in writers.longest_versions(df).collect())
    assert got == [["Bonjour", "a", "b"], ["Bonjour", "c"]]


def test_sources_in_their_shapes(spark):
    rows = spark.createDataFrame([(" Trie ", "b", " a "), ("Dis", " ", "oui"), ("x", "y", " ")], "instruction string, input string, output string")
    assert [r["text"] for r in shapes.instructions(rows).collect()] == ["<|user|>\nTrie\nb\n<|assistant|>\na\n", "<|user|>\nDis\n<|assistant|>\noui\n"]
    assert [r["text"] for r in shapes.code(rows.limit(1)).collect()] == ["<|user|>\nTrie\n<|assistant|>\n```\na\n```\n"]
    qa = spark.createDataFrame([("q", (["r", "s"],)), ("q", ([],)), ("", (["r"],))], "question string, answers struct<text:array<string>>")
    assert [r["text"] for r in shapes.questions(qa).collect()] == ["<|user|>\nq\n<|assistant|>\nr\n"]
    web = spark.createDataFrame([(i, " " + "w" * n) for i, n in enumerate((200, 201, 9000, 300))], "doc_id long, text string")
    assert [(r["doc_id"], len(r["text"])) for r in shapes.web(web, most=2).orderBy("doc_id").collect()] == [(1, 201), (2, 8000)]
    both = shapes.registered({"code": shapes.code(rows), "web": shapes.web(web)})
    assert Counter(r["source"] for r in both.collect()) == {"code": 2, "web": 3}
    assert mix.mixed_stream(both, {"code": 1.0, "web": 2.0}, quality=False, dedup=False).count() == 3  # the shortest go


def test_log_and_token_files(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"step":1,"loss":2.5}\nbad\n{"step":2}\n')
    log = readers.log_lines(spark.read.text(str(tmp_path / "log.jsonl")).withColumnRenamed("value", "line"), "step int, loss double")
    assert sorted((r["step"], r["loss"]) for r in log.collect()) == [(1, 2.5), (2, None)]
    assert metrics.file_inventory(spark.read.format("binaryFile").load(str(tmp_path / "log.jsonl"))).first()["n_files"] == 1


def test_first_copy_that_fails_shadows_a_later_one(spark):
    bad, good = "1" * 150 + " a" * 50 + "  x" * 40, "1" * 150 + " a" * 50 + " x" * 40
    docs = spark.createDataFrame([(1, bad), (2, good), (3, "short"), (4, None)], "doc_id long, text string")
    gate = {r["doc_id"]: r["gate"] for r in dedup.corpus_gates(docs, min_alpha=0.4).collect()}
    assert gate[2] == "dup" and gate[3] == "short" and gate[4] == "short"


def test_prefix_key_sees_500_characters(spark):
    a = "x" * 500
    docs = spark.createDataFrame([(1, a + "1"), (2, a + "2"), (3, "y" + a[1:])], "doc_id long, text string")
    got = {r["doc_id"]: r["is_first"] for r in dedup.first_wins(docs, dedup.prefix_key(F.col("text")), "doc_id").collect()}
    assert got == {1: True, 2: False, 3: True}


def test_containment_is_of_the_candidate(spark):
    known = spark.createDataFrame([("a b c d e f",)], "k string")
    cand = spark.createDataFrame([("a b x",), ("x y z a",), ("a b",)], "c string")
    got = {r["c"]: r["is_known"] for r in dedup.contained(cand, known, "c", "k", 0.6).collect()}
    assert got == {"a b x": True, "x y z a": False, "a b": False}


def test_mix_keeps_to_weights(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    first = mix.arrivals(docs, {"a": 3.0, "b": 1.0}).orderBy("arrival").limit(1200).groupBy("source").count().collect()
    share = {r["source"]: r["count"] / 1200 for r in first}
    assert abs(share["a"] - 0.75) < 0.05
    assert mix.arrivals(docs, {"a": 0.0}).count() == 0


def test_running_sum_over_ties_and_groups(spark):
    rows = [(i % 3, i // 2, 1) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, o long, v long").withColumn("u", F.monotonically_increasing_id())
    got = mix.running_sum(df, "v", "s", ["o", "u"], ["g"]).groupBy("g").agg(F.max("s").alias("m"), F.countDistinct("s").alias("n")).collect()
    assert all(r["m"] == 200 and r["n"] == 200 for r in got)


def test_chunks_of_books(spark):
    docs = spark.createDataFrame([(1, "x" * 299), (2, "x" * 300), (3, "x" * 4200), (4, "x" * 4201)], "doc_id long, text string")
    got = Counter(r["doc_id"] for r in mix.chunks(docs).collect())
    assert got == {2: 1, 3: 1, 4: 2}


def test_pretokens_drop_what_no_branch_takes(spark):
    assert one(spark, tokens.pretokens, "l'été a_b œ don't ×") == ["l", "'", "été", " a", "b", " ", " don", "'t", " ×"]


def naive_train(counts, n):
    words = [(list(w.encode()), c) for w, c in counts]
    merges = []
    for new in range(264, 264 + n):
        pairs = Counter()
        for ids, c in words:
            for p in zip(ids, ids[1:]):
                pairs[p] += c
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append(best)
        words = [(training.merged(ids, best, new), c) for ids, c in words]
    return merges


def test_training_and_round_trip(spark):
    random.seed(3)
    words = [("".join(random.choice("abé") for _ in range(random.randint(1, 7))), random.randint(1, 9)) for _ in range(60)]
    words = list({w: c for w, c in words}.items()) + [("aaaa", 5)]
    words = list(dict(words).items())
    merges = training.train(spark.createDataFrame(words, "word string, n long"), 264 + 40)
    assert merges == naive_train(words, 40)
    df = spark.createDataFrame([("aaa bé ab, 12",)], "t string")
    ids = df.select(tokens.encoder(merges)(tokens.pretokens(F.col("t"))).alias("ids"))
    assert ids.select(tokens.decoder(merges)(F.col("ids"))).first()[0] == "aaa bé ab, 12"


@pytest.mark.parametrize("seed,width,most", [(1, 1, 100_000), (2, 4, 100_000), (3, 8, 6), (4, 5, 1), (5, 40, 60), (6, 400, 100_000)])
def test_rounds_of_merges_equal_the_sequential_rule(spark, seed, width, most):
    """Many ties, runs of one letter, rising floors; every pair down to the last is merged."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("aab" if seed % 2 else "abcé") for _ in range(rng.randint(1, 9))): rng.choice([1, 1, 2, 3, 9]) for _ in range(40)} | {"aaaaaaa": 4, "": 3}
    expected, log = naive_train(words.items(), 10_000), []
    df = spark.createDataFrame([*words.items(), (None, 7)], "word string, n long").coalesce(1)
    n = 5 if width < 6 else 40
    assert training.train(df, vocab_size=264 + n, width=width, most=most, log=log) == expected[:n]
    assert sum(log) == n and (width < 100 or len(log) == 1)


def test_segments_and_words_are_merged_as_by_the_plain_rule():
    """Places of a merge are changed at once and words go on together: runs of one id, ties, neighbours that merge both, vocabularies that lead back."""
    for seed in range(60):
        rng = random.Random(seed)
        words = [([rng.randint(1, 1 + seed % 3) for _ in range(rng.randint(2, 14))], rng.randint(1, 5)) for _ in range(rng.randint(1, 20))]
        text = [("".join(map(chr, ids)), n) for ids, n in words]
        ids, sizes = np.array(sum((w for w, _ in words), [])), np.array([len(w) for w, _ in words])
        merges = training.sequential(ids, np.cumsum(sizes), np.array([n for _, n in words]), 264, 10_000)
        assert merges == naive_train(text, 10_000)
        some = merges[: seed % 9 + 1]
        keys, rank = np.array([a << 32 | b for a, b in some]), {p: i for i, p in enumerate(some)}
        got = {}
        for at, n, out in training.settled(ids, sizes, np.sort(keys), 264 + np.argsort(keys)):
            got |= dict(zip(at.tolist(), (x.tolist() for x in np.split(out, np.cumsum(n)[:-1])), strict=True))
        assert [got[i] for i in range(len(words))] == [training.folded(w, rank, 264) for w, _ in words]


def test_joint_pieces_that_lead_to_earlier_ones(spark):
    ranks = {bytes([i]): i for i in range(256)} | {b"aba": 256, b"ab": 257, b"bab": 258, b"abab": 259}
    words = ["".join(p) for n in range(1, 9) for p in itertools.product("ab", repeat=n)]
    got = spark.createDataFrame([(words,)], "w array<string>").select(tokens.rank_encoder(ranks)("w")).first()[0]
    assert got == sum((plain_join(w.encode(), ranks) for w in words), [])


def test_prepared_encodes_each_text_once(spark):
    docs = spark.createDataFrame([(i, "ab " * 30) for i in range(8)], "doc_id long, text string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def encode(words):
        calls.add(1)
        return [1] * len(words)

    assert tokens.prepared(docs, encode, 8).count() > 0
    assert calls.value == 8


def test_training_on_documents_takes_few_rounds(spark, sf_dir):
    counts = tokens.word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40))
    log, one = [], []
    wide = training.train(counts, 264 + 900, log=one)
    assert training.train(counts, 264 + 900, width=200, most=5000, log=log) == wide and len(wide) == 900
    assert len(one) <= 2 < len(log) <= 12


@pytest.mark.parametrize("limits", [{}, {"block_edges": 3}, {"block_edges": 3, "broadcast_edges": 4}])
def test_projection_in_blocks(spark, limits):
    rng = random.Random(1)
    edges = [(rng.randrange(8), rng.randrange(6)) for _ in range(20)] + [(2, 1)] * 3 + [(9, 0)]  # no position has id 9
    p = {i: [rng.random() for _ in range(8)] for i in range(5)}
    weights = vocab.edge_weights(spark.createDataFrame(edges, "their_id int, our_id int"))
    got = {r["pos"]: {x["id"]: x["p"] for x in r["p"]} for r in vocab.projected(spark.createDataFrame(list(p.items()), "pos int, p array<double>"), weights, **limits).collect()}
    for pos, row in p.items():
        q = {}
        for t, o in edges:
            q[o] = q.get(o, 0) + (row[t] if t < 8 else 0) / sum(e[0] == t for e in edges)
        assert got[pos] == pytest.approx({o: v / (sum(q.values()) + 1e-10) for o, v in q.items()})


def test_array_algebra_has_no_exchange(spark):
    rows = spark.createDataFrame([(1, [0.0] * 6), (2, [1.0, 3.0, 3.0, 0.0, -1.0, 3.0])], "pos int, x array<double>")
    x = F.col("x")
    out = rows.select("pos", vocab.top_k(vocab.softmax(x), 2).alias("top"), vocab.rebuilt(vocab.top_k(vocab.softmax(x), 2), 6).alias("full"), vocab.rebuilt(vocab.top_k(vocab.softmax(x), 9), 6).alias("all"),
                      vocab.sampling_filter(x, F.array(F.lit(1), F.lit(77), F.lit(1)), k=2).alias("s"), vocab.sampling_filter(x, F.array().cast("array<int>"), k=50, nucleus=2.0).alias("every"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    a, b = out.orderBy("pos").collect()
    assert [t["id"] for t in a["top"]] == [0, 1] and [t["id"] for t in b["top"]] == [1, 2]
    assert a["full"] == pytest.approx([1 / 6] * 6) and sum(b["full"]) == pytest.approx(1) and b["full"][0] == b["full"][3] == pytest.approx((1 - 2 * b["top"][0]["p"]) / 4)
    assert b["all"] == pytest.approx([v / sum(map(math.exp, [1, 3, 3, 0, -1, 3])) for v in map(math.exp, [1, 3, 3, 0, -1, 3])])
    assert [t["id"] for t in a["s"]] == [0, 1, 2, 3, 4, 5]  # all zeros: what equals the second best stays
    assert [t["id"] for t in b["s"]] == [2, 5] and [t["p"] for t in b["s"]] == pytest.approx([0.5, 0.5])  # id 1 was seen
    assert [t["id"] for t in b["every"]] == [1, 2, 5, 0, 3, 4]


@pytest.mark.parametrize("n", [3, 4, 8, 9, 40])
@pytest.mark.parametrize("overlap", [False, True])
def test_packing(spark, n, overlap):
    docs = spark.createDataFrame([(1, list(range(n // 2))), (2, []), (3, list(range(n // 2, n)))], "doc_id long, ids array<int>")
    got = [r["ids"] for r in tokens.packed(docs, 3, overlap).orderBy("seq_id").collect()]
    stream, step = list(range(n)), 3 if overlap else 4
    assert got == [stream[i : i + 4] for i in range(0, n, step) if len(stream[i : i + 4]) == 4]


def test_search_counts_distinct_words(spark):
    facts = spark.createDataFrame([(0, "le chat dort"), (1, "un chat"), (2, "rien")], "pos int, fact string")
    got = [(r["pos"], r["score"]) for r in recall.search(facts, "chat CHAT noir").collect()]
    assert got == [(0, 0.5), (1, 0.5)]


def test_crawl_is_breadth_first(spark):
    h = "http://h/"
    rows = [(h, 0, h + "b"), (h, 1, h + "a"), (h, 2, "http://x/"), (h + "b", 0, h), (h + "b", 1, h + "d"), (h + "a", 0, h + "c"), (h, 25, h + "z")]
    links = spark.createDataFrame(rows, "from_url string, pos int, href string")
    got = [r["url"] for r in readers.crawl(links, h, 10).orderBy("rank").collect()]
    assert got == [h, h + "b", h + "a", h + "d", h + "c"]


def test_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join(json.dumps({"text": "mot " * n, "source": "s"}) for n in (10, 40, 50)) + "\n{bad\n[1]\n")
    (src / "b.txt").write_text("texte " * 30)
    assert readers.jsonl(spark, str(src / "a.jsonl")).filter("_bad is not null").count() == 2
    assert readers.corpus(spark, str(src / "a.jsonl"), str(src / "b.txt")).count() == 3
    docs = spark.range(12).select(F.col("id").alias("doc_id"))
    writers.sharded(docs, str(tmp_path / "out"), 5)
    assert spark.read.json(str(tmp_path / "out")).groupBy("shard_id").count().count() == 3
    at = str(tmp_path / "table")
    writers.json_lines(docs, at)
    writers.replaced(spark, spark.read.json(at).filter("doc_id < 3"), at)
    assert spark.read.json(at).count() == 3 and spark.read.json(at + ".bak").count() == 12
    (tmp_path / "t.bin").write_bytes(bytes([1, 0, 255, 255]))
    assert readers.token_file(spark, str(tmp_path / "t.bin")).first()["ids"] == [1, 65535]
    assert readers.any_of(spark, str(tmp_path / "none"), "a int").count() == 0


def test_dump(spark, tmp_path):
    import bz2

    page = "<page><title>{0}</title><revision><text bytes='1'>{1}</text></revision></page>"
    pages = [("Chat", "x" * 600), ("Talk:Chat", "x" * 600), ("R", "#redirect [[Chat]]" + "x" * 600), ("Court", "x" * 499)]
    xml = "<mediawiki xmlns='http://www.mediawiki.org/xml/export-0.10/'>" + "\n".join(page.format(*p) for p in pages) + "</mediawiki>"
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    assert [r["title"] for r in readers.articles(readers.dump_pages(spark, str(tmp_path / "d.xml.bz2"))).collect()] == ["Chat"]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    docs.write.json(str(tmp_path / "in"))
    stream = ingest.cleaned(ingest.documents(spark, str(tmp_path / "in")))
    ingest.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = dedup.corpus_gates(docs.withColumn("text", normalize.clean(F.col("text")))).filter("gate = 'kept'")
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_notifications_come_once_though_batches_come_twice(spark, tmp_path):
    rows = [(i, ["info", "milestone", "error", "session_end"][i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, event string")
    df.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    at, sinks = str(tmp_path / "out"), {"console": 1, "file": 2, "http": 3}
    ingest.notify(stream, at, str(tmp_path / "ck"), sinks).awaitTermination()
    ingest.delivered(df, 0, at, sinks)  # the batch comes again after all sinks had it
    failed = tmp_path / "out" / "sink=http" / "batch_id=0"
    (failed / "_SUCCESS").unlink()  # and as if the last sink had failed half way
    (failed / "part-half.json").write_text('{"event_id": 2, "event": "error"}\n')
    ingest.delivered(df, 0, at, sinks)
    got = Counter((r["sink"], r["event_id"]) for r in spark.read.json(at).collect())
    least = {"info": 1, "milestone": 2, "error": 3, "session_end": 2}
    assert got == Counter((s, i) for i, e in rows for s, n in sinks.items() if least[e] >= n)
    df.limit(3).write.mode("append").json(str(tmp_path / "in"))
    ingest.notify(stream, at, str(tmp_path / "ck"), sinks).awaitTermination()
    assert spark.read.json(at).filter("sink = 'console'").count() == 43


@pytest.mark.parametrize("parts", [[10], [2, 5, 6], [1, 2, 3, 4, 5, 6, 7, 8, 9]])
def test_loop_does_not_depend_on_batches(spark, tmp_path, parts):
    from test_queries import loop_rows, plain_loop

    long = "x" * 85  # its key is in no later session, as explored topics are known whole
    pages = [
        (600, 1, "a", ["First topic", " first TOPIC ", "tiny", "second topic", long]), (600, 2, "a", ["second topic", "third topic"]), (660, 3, "b", ["First topic"]),
        (700, 4, "a", []), (720, 5, "a", [long, "first topic"]), (900, 6, "b", [""]), (901, 7, "a", ["first topic", "second topic", "third topic", long]), (1000, 8, "a", ["a b c d", "e f g h"]),
        (1000, 9, "a", ["i j k l", "m n o p"]), (5000, 10, None, ["other topic"]),
    ]
    low = 0
    for n, high in enumerate([*parts, 10]):
        rows = [(learner, pos, at, topics) for at, pos, learner, topics in pages if low < pos <= high]
        t = spark.createDataFrame(rows, "learner string, pos bigint, at bigint, topics array<string>").withColumn("at", F.timestamp_seconds("at"))
        t.coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
        steps = loop.learning(spark.readStream.schema(loop.PAGE).parquet(f"{tmp_path}/in/*"), hours=300 / 3600, cap=4)
        loop.started(spark, steps, f"{tmp_path}/out", f"{tmp_path}/checkpoint", 2).awaitTermination()
        low = high
    got = loop_rows(spark.read.schema(loop.STEP).parquet(f"{tmp_path}/out").collect())
    assert got == plain_loop(pages, 300, cap=4)
    assert {r[4] for r in got if r[0] == "page"} >= {"First topic", "second topic", long, None}


@pytest.mark.parametrize("length,split", [(1, 3), (7, 1), (7, 4), (16, 1000), (5000, 2)])
def test_flat_tokens_come_back(spark, tmp_path, length, split):
    spark.dataSource.register(flat.FlatTokens)
    at = str(tmp_path / "ids")
    docs = [[65535, 0, 256], [], None, list(range(2000)), [9], [8, 7]]
    for part, mode in ((docs[:4], "append"), (docs[4:], "append")):
        t = spark.createDataFrame(list(enumerate(part)), "n int, ids array<int>").repartitionByRange(3, "n").sortWithinPartitions("n")
        t.select("ids").write.format("flat_tokens").mode(mode).save(at)
    (tmp_path / "ids/parts/000000-of-a-lost-attempt.bin").write_bytes(b"xxxx")
    whole = [i for d in docs for i in d or []]
    read = lambda **o: [tuple(r) for r in spark.read.format("flat_tokens").options(length=length, split=split, **o).load(at).orderBy("seq_id").collect()]
    expected = [(n, whole[n * length : n * length + length]) for n in range(len(whole) // length)]
    assert read() == expected and read(begin=2, until=5) == expected[2:5]
    spark.createDataFrame([([1, 2],)], "ids array<int>").write.format("flat_tokens").mode("overwrite").save(at)
    assert [i for _, ids in read() for i in ids] == ([1, 2] if length == 1 else [])


@pytest.mark.parametrize("bad", [[-1], [65536], [1, None]])
def test_flat_tokens_refuse_what_16_bits_do_not_hold(spark, tmp_path, bad):
    spark.dataSource.register(flat.FlatTokens)
    good = spark.createDataFrame([([1, 2],)], "ids array<int>")
    good.write.format("flat_tokens").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="65535|null"):
        spark.createDataFrame([(bad,)], "ids array<int>").write.format("flat_tokens").mode("append").save(str(tmp_path))
    assert spark.read.format("flat_tokens").option("length", 2).load(str(tmp_path)).collect()[0]["ids"] == [1, 2]


def test_flat_file_above_two_gigabytes_is_no_single_cell(tmp_path):
    big = tmp_path / "train.bin"
    with open(big, "wb") as f:  # sparse: all zeros but the last sequence
        f.truncate((3 << 30) - 8)
        f.seek(0, 2)
        f.write(bytes([1, 0, 2, 0, 3, 0, 4, 0]))
    reader = flat.Batch({"path": str(big), "length": "4"})
    parts = reader.partitions()
    assert sum(p.high - p.low for p in parts) == (3 << 30) // 8 and max(n for p in parts for _, _, n in p.pieces) <= flat.TASK
    last = list(reader.read(parts[-1]))
    assert last[-1].to_pylist()[-1] == {"seq_id": (3 << 30) // 8 - 1, "ids": [1, 2, 3, 4]} and max(b.nbytes for b in last) < 8 << 20
    assert [p.low for p in flat.Batch({"path": str(tmp_path), "length": "4", "until": "3"}).partitions()] == [0]


def test_flat_tokens_of_an_empty_folder(spark, tmp_path):
    spark.dataSource.register(flat.FlatTokens)
    assert spark.read.format("flat_tokens").load(str(tmp_path)).collect() == []


def plain_runs(runs):
    """(run, n, is_first) of keys that come one after the other."""
    met, out = set(), set()
    for r, keys in enumerate(runs):
        for n, k in enumerate(keys):
            out.add((r, n, k is None or k not in met))
            met.add(k)
    return out


@pytest.mark.parametrize("buckets,pieces", [(1, 1), (16, 2)])
def test_seen_index_over_runs(spark, tmp_path, buckets, pieces):
    random.seed(5)
    runs = [[random.choice(["", None, *map(str, range(r * 40, r * 40 + 120))]) for _ in range(100)] for r in range(3)]
    path = str(tmp_path / "index")

    def taken(r):
        t = spark.createDataFrame(list(enumerate(runs[r])), "n int, k string")
        return {(r, x["n"], x["is_first"]) for x in seen.first_seen(t, seen.SeenIndex(spark, path, buckets, pieces), f"run{r}", F.col("k").cast("binary"), "n").collect()}

    first, second = taken(0), taken(1)
    # a run that failed before its record was written leaves keys that nobody reads
    spark.createDataFrame([(b"150", 0), (b"no run has this", 0)], "key binary, bucket int").write.partitionBy("bucket").parquet(f"{path}/keys/run=run2")
    third = taken(2)
    assert first | second | third == plain_runs(runs)
    assert taken(1) == second and taken(0) == first  # repeated runs give what they gave
    assert seen.SeenIndex(spark, path).runs() == ["run0", "run1", "run2"] and seen.SeenIndex(spark, path).buckets == buckets


def test_seen_index_opens_no_bucket_but_those_touched(spark, tmp_path):
    index = seen.SeenIndex(spark, str(tmp_path / "index"), 64, 1)
    keys = spark.range(2000).select(F.md5(F.col("id").cast("string")).cast("binary").alias("key"))
    index.publish(keys, "a")
    assert index.known(keys.limit(0)).count() == 0 and index.asked == []
    some = spark.createDataFrame([(7,), (8,), (90_000,)], "id bigint").select(F.md5(F.col("id").cast("string")).cast("binary").alias("key"))
    found = index.known(some)
    assert found.count() == 2 and len(index.asked) <= 2
    wanted = {r["bucket"] for r in index._probed(some, "key").limit(2).collect()}
    assert set(index.asked) == wanted
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().toString()
    many = spark.range(5000, 25_000).select(F.md5(F.col("id").cast("string")).cast("binary").alias("key"))
    index.publish(many, "b")
    index.publish(some, "b")  # the name is taken: nothing changes
    assert index.known(some).count() == 2 and index.known(many).count() == 20_000
    with pytest.raises(ValueError):
        index.publish(some, "../b")


def test_cleaning_in_place_keeps_each_content_once_over_all_files(spark, tmp_path):
    body = lambda x: (x + " ") * 150
    folders = [[body("one"), body("two"), "short", body("one")], [body("TWO"), body("three"), body("1 2")], [body("three"), body("four"), body("1 2")]]
    paths = []
    for i, texts in enumerate(folders):
        paths.append(f"{tmp_path}/f{i}")
        (tmp_path / f"f{i}").mkdir()
        (tmp_path / f"f{i}" / "a.json").write_text("".join(json.dumps({"text": t, "source": f"s{i}"}) + "\n" for t in texts) + "{bad\n")
    index = seen.SeenIndex(spark, f"{tmp_path}/index", 8, 1)
    got = lambda p: sorted(r["text"].split()[0] for r in spark.read.schema("text string").json(p).filter("text is not null").collect())
    seen.cleaned_in_place(spark, paths[:2], index)
    assert [got(p) for p in paths] == [["one", "two"], ["three"], ["1", "four", "three"]]
    seen.cleaned_in_place(spark, paths, index)  # made again, with the folder that was left out
    assert [got(p) for p in paths] == [["one", "two"], ["three"], ["four"]] and got(paths[2] + ".bak") == ["1", "four", "three"]


def plain_buffer(messages, more_than=100, cut=2000):
    """Threads as a buffer gives them that sees the messages one by one: {closing id: text}."""
    buffer, out = {}, {}
    for _, i, parent, role, lang, said in sorted(messages, key=lambda m: m[0]):
        said = (said or "").strip()
        if (lang or "").lower() not in ("", "fr", "en") or len(said) < 20:
            continue
        if parent is None:
            buffer[i] = f"<|user|>\n{said}\n"
        elif parent in buffer and role in ("assistant", "prompter"):
            whole = buffer.pop(parent) + f"<|{'assistant' if role == 'assistant' else 'user'}|>\n{said}\n"
            if role == "prompter":
                buffer[i] = whole
            elif len(whole) > more_than:
                out[i] = whole[:cut]
    return out


TREE = "arrival int, message_id string, parent_id string, role string, lang string, text string"


@pytest.mark.parametrize("seed,forks", [(1, 2), (2, 5), (3, 40)])
def test_threads_equal_the_buffer(spark, seed, forks):
    rnd = random.Random(seed)
    arrivals = rnd.sample(range(2000), 150)
    messages = []
    for n in range(150):
        parent = None if n < 3 or rnd.random() < 0.05 else f"m{rnd.randrange(max(0, n - forks), n)}"
        at = n * 10 if rnd.random() < 0.9 else arrivals[n] * 10 + 1  # some come before their parents
        messages.append((at, f"m{n}", parent, rnd.choice(["prompter"] * 6 + ["assistant", "other"]), rnd.choice([None, "fr", "EN", "fr", "fr", "de"]) if n % 9 == 0 else "fr", rnd.choice(["a", None]) if n % 23 == 22 else f" text {n} " + "word " * rnd.randrange(4, 60)))
    got = {r["message_id"]: r["full"] for r in chat.tree_pairs(spark.createDataFrame(messages, TREE)).collect()}
    assert got == plain_buffer(messages)


def test_deep_threads_take_few_rounds(spark):
    depth = 300
    messages = [(n, f"m{n}", f"m{n - 1}" if n else None, "assistant" if n == depth else "prompter", "fr", "word " * 5) for n in range(depth + 1)]
    log = []
    got = {r["message_id"]: r["full"] for r in chat.tree_pairs(spark.createDataFrame(messages, TREE), log=log).collect()}
    assert got == plain_buffer(messages) and len(got[f"m{depth}"]) == 2000 and len(log) == math.ceil(math.log2(depth))
    assert chat.tree_pairs(spark.createDataFrame([], TREE)).collect() == []


def test_crawl_of_many_hosts_and_a_long_chain(spark):
    from test_queries import plain_crawl

    rnd, rows, starts = random.Random(4), [], []
    for h in range(6):
        page = lambda n: f"http://h{h}/{n}"  # noqa: E731, B023
        starts.append((page(0),))
        rows += [(page(n), pos, page(rnd.randrange(40))) for n in range(40) for pos in range(rnd.randrange(4))]
        rows += [(page(n), 9, f"http://h{(h + 1) % 6}/{n}") for n in range(5)]  # other hosts are not entered
    rows += [(f"http://chain/{n}", 0, f"http://chain/{n + 1}") for n in range(12)]
    starts.append(("http://chain/0",))
    links = {}
    for u, _, to in sorted(rows, key=lambda r: r[:2]):
        if to.split("/")[2] == u.split("/")[2]:
            links.setdefault(u, []).append(to)
    log = []
    got = readers.crawl_hosts(spark.createDataFrame(rows, "from_url string, pos int, href string"), spark.createDataFrame(starts, "url string"), 25, log=log).collect()
    assert sorted((r["url"], r["rank"]) for r in got) == sorted((u, n) for (s,) in starts for n, u in enumerate(plain_crawl(links, s, 25)))
    assert max(r["depth"] for r in got if r["host"] == "chain") == 12 and sum(log) == len(got)


def best_of(facts, query, k):
    """The search of one query, over all facts."""
    q, out = query.lower(), []
    for pos, fact in sorted((p, f) for p, f in facts if f is not None):
        text, have = fact.lower(), set(q.split())
        score = 1.0 if q in text else len(have & set(text.split())) / len(have)
        if score > 0:
            out.append((-score, pos))
    return [(n, pos, round(-s, 9)) for n, (s, pos) in enumerate(sorted(out)[:k], 1)]


@pytest.mark.parametrize("k", [1, 3])
def test_search_of_many_queries_is_that_of_each(spark, k):
    from loomtext.operators.lookup import search_all

    rng = random.Random(k)
    some = lambda n: " ".join(rng.choices(["de", "la", "lune", "terre", "mer", "Nuit", "étoile", "vent", "demain", "eau", "bois", "an"], [40, 30, 1, 1, 2, 2, 1, 3, 2, 3, 2, 9], k=n))
    facts = [(i * 7 - 100, some(rng.randrange(1, 9))) for i in range(300)] + [(9000, None), (9001, ""), (9002, "  "), (9003, "étoile " * 500), (9004, "zéro")]
    asked = [some(rng.randrange(1, 7)) for _ in range(60)] + ["main", "e", "a lu", "une de", "ois", "de la mer", "absent", "absent mot zéro", "oile v", " de", "n d", "lune absent", "a mer", "e vent"]
    asked += [f[1:-1] for _, f in facts[:20] if len(f) > 3]
    queries = list(enumerate(asked)) + [(900, None), (901, ""), (902, "  ")]
    f = spark.createDataFrame(facts, "pos int, fact string").withColumn("_pos", F.lit(1)).withColumn("_words", F.lit("x"))
    log = {}
    got = search_all(f, spark.createDataFrame(queries, "query_id int, query string").withColumn("_q", F.lit(0)), k, log=log).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["rank"], r["pos"], round(r["score"], 9)))
    assert found == {i: b for i, q in enumerate(asked) if (b := best_of(facts, q, k))}
    assert log["pairs"] < len(asked) * len(facts)


def test_search_of_many_queries_without_rows(spark):
    from loomtext.operators.lookup import contexts, search_all

    facts, queries = spark.createDataFrame([(1, "a b")], "pos int, fact string"), spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "query_id int, query string")
    assert search_all(facts.limit(0), queries).count() == search_all(facts, queries.limit(0)).count() == 0
    none = spark.createDataFrame([], "key string, value string")
    assert {tuple(r) for r in contexts(facts, queries, none).collect()} == {(1, "Faits connus:\n- a b"), (2, "(mémoire vide)")}


def test_corpus_stops_at_a_cap_that_lines_fill(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"text": c * 120}) + "\n" for c in "abc"))
    (tmp_path / "b.txt").write_text("d" * 130)
    read = lambda n: sorted(r["text"][0] for r in readers.corpus(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.txt"), max_docs=n).collect())
    assert read(2) == ["a", "b"] and read(3) == ["a", "b", "c"] and read(4) == read(None) == read(0) == ["a", "b", "c", "d"]


def test_proportions_and_their_order(spark):
    a = spark.createDataFrame([(i, "x" * 3000) for i in range(30)], "doc_id int, text string")
    b = spark.createDataFrame([(i, f"b{i}") for i in range(3)] + [(None, "no")], "doc_id int, text string")
    mixed = lambda parts: [(r["place"], r["source"], r["doc_id"], len(r["text"])) for r in mix.in_proportion({"a": a.repartition(parts), "b": b.repartition(parts)}, {"a": 0.5, "b": 0.49, "c": 0.01}, 20).orderBy("place").collect()]
    got = mixed(1)
    assert got == mixed(5) and [p for p, *_ in got] == list(range(1, 14))
    assert {(s, d) for _, s, d, _ in got} == {("a", i) for i in range(10)} | {("b", i) for i in range(3)} and {n for _, s, _, n in got if s == "a"} == {2000}
    assert [s for _, s, _, _ in got] != sorted(s for _, s, _, _ in got)
    assert mix.first_rows(a.limit(0), 3).count() == mix.first_rows(a, 0).count() == 0


def test_prepared_sequences_count_long_texts_only(spark):
    @F.pandas_udf("array<int>")
    def lengths(words: pd.Series) -> pd.Series:
        return words.map(lambda w: [len(x) for x in w])

    docs = spark.createDataFrame([(1, "a" * 60), (2, "short"), (3, " b" * 40), (4, "c" * 70), (5, None)], "doc_id int, text string")
    got = tokens.prepared(docs, lengths, 4, max_docs=2).orderBy("seq_id").collect()
    assert [r["ids"] for r in got] == [[60, 2, 2, 2, 2]] + [[2] * 5] * 9
    assert tokens.prepared(docs, lengths, 4, max_docs=0).count() == 0


def rows_by_id(df):
    return {r[0]: tuple(r)[1] if len(r) == 2 else tuple(r)[1:] for r in df.collect()}


def test_streamed_replies(spark):
    lines = {1: ['{"response":" Bon"}', "bad", '{"response":"jour ","done":true}', '{"response":"!"}'], 4: ['{"response":"","thinking":"rien"}'], 5: ["rien"]}
    lines[2] = ['{"response":"a","message":{"content":"b"}}', "[1]", '{"error":"x","response":"y","done":true}', '{"message":{"content":"c"}}']
    lines[3] = ['{"thinking":"je pense"}', '{"thinking":"encore"}', '{"response":" donc"}']
    chunks = spark.createDataFrame([(i, n, x) for i, xs in lines.items() for n, x in enumerate(xs)], "id int, pos int, line string")
    assert rows_by_id(parse.streamed(chunks)) == {1: "Bonjour", 2: "abc", 3: "je pense donc", 4: "", 5: ""}


def test_texts_of_replies(spark):
    x = "x" * 2001
    replies = ['{"response":" a ","thinking":"b"}', '{"response":"","thinking":" b ","message":{"content":"c"}}', '{"message":{"content":" c ","thinking":"d"}}', '{"message":{"content":"","thinking":" d "}}', '{"text":"","output":" e "}']
    replies += ['{"completion":"f"}', '{"error":"g","response":"a"}', "[1]", None, f'{{"thinking":"{x}"}}', f'{{"message":{{"thinking":"{x}"}}}}']
    df = spark.createDataFrame(list(enumerate(replies)), "id int, reply string")
    assert list(rows_by_id(df.select("id", parse.reply_text(F.col("reply")))).values()) == ["a", "b", "c", "d", "e", "f", "", "", "", x[:2000] + "...", x[:2000]]


def test_actions_of_replies(spark):
    calls = ["x <answer> oui </answer>", '<tool> search_web </tool><args>{"query":"a"}</args>', "<tool>t</tool><args>{bad</args>", "rien"]
    a = spark.createDataFrame(list(enumerate(calls)), "id int, reply string").withColumn("a", parse.action(F.col("reply")))
    assert list(rows_by_id(a.select("id", "a.answer", "a.tool", "a.args")).values()) == [("oui", None, {}), (None, "search_web", {"query": "a"}), (None, "t", {}), (None, None, {})]


def test_facts_and_topics_of_replies(spark):
    raw = ["FAITS:\n- la lune tourne autour de la terre [CAT:science]\n- court\n2) deuxieme fait assez long ici\nSUJETS:\n* la formation des lunes\nbavardage", "une reponse sans section mais avec une ligne assez longue pour etre un fait\ncourte", "rien"]
    got = parse.facts_and_topics(spark.createDataFrame(list(enumerate(raw)), "id int, raw string"))
    expected = {(0, "fact", 1, "la lune tourne autour de la terre", "science"), (0, "fact", 2, "deuxieme fait assez long ici", None), (0, "topic", 1, "la formation des lunes", None), (1, "fact", 1, raw[1][:-7], None)}
    assert {tuple(r[c] for c in ("id", "kind", "n", "content", "category")) for r in got.collect()} == expected


def test_small_cases_of_conversations(spark):
    pairs = spark.createDataFrame([(1, "Trie", "b a", "a b"), (2, "Dis", "", "oui"), (3, "Vide", None, " "), (4, None, "x", "y")], "id int, i string, g string, o string")
    assert rows_by_id(pairs.select("id", chat.instruction(F.col("i"), F.col("g"), F.col("o")))) == {1: "<|user|>\nTrie\nb a\n<|assistant|>\na b\n", 2: "<|user|>\nDis\n<|assistant|>\noui\n", 3: None, 4: None}
    t = spark.createDataFrame([(1, [5, 6, 7, 8, 9], [0, 2, 4, 6, 8], 5), (2, [5, 6, 7], [0, 2, 4], 0), (3, [5, 6], [0, 2], 1)], "id int, ids array<int>, starts array<int>, prompt int")
    assert rows_by_id(t.select("id", chat.continuation_targets(F.col("ids"), F.col("starts"), F.col("prompt")))) == {1: [5, -1, -1, 8, 9], 2: [5, 6, 7], 3: [5, 6]}
    queue = spark.createDataFrame(list(enumerate(["alpha", "beta", "gamma ray", "delta", "eps"])), "pos int, topic string")
    assert {r["topic"]: r["new_pos"] for r in recall.prioritised(queue, "Gamma").collect()} == {"alpha": 3, "beta": 4, "gamma ray": 0, "delta": 1, "eps": 2}


def test_continuation_targets_of_a_long_text_take_linear_time(spark):
    t = spark.range(1).select(F.sequence(F.lit(0), F.lit(59_999)).alias("ids")).withColumn("starts", F.transform("ids", lambda i: i * 4))
    began = time.time()
    got = t.select(F.explode(chat.continuation_targets(F.col("ids"), F.col("starts"), F.lit(200_001))).alias("x")).groupBy("x").count().filter("count > 1 or x = 50001").collect()
    assert {tuple(r) for r in got} == {(-1, 50_000), (50_001, 1)} and time.time() - began < 30


def test_loop_asks_its_state_little(spark):
    """Sessions that begin and end within a batch, and topics never explored, cost no call of the state for each topic."""
    calls = Counter()

    class State:
        def __init__(self):
            self.held = {}

        def __getattr__(self, name):
            def call(*a):
                calls[name] += 1
                return {"get": lambda: self.held.get("v"), "exists": lambda: "v" in self.held, "containsKey": lambda k: k in self.held, "updateValue": lambda k, v: self.held.update({k: v}), "appendValue": lambda v: self.held.setdefault("v", []).append(v),
                        "put": lambda v: self.held.update(v=v), "update": lambda v: self.held.update(v=v), "clear": self.held.clear}[name](*a)

            return call

    class Handle:
        getMapState = getListState = getValueState = lambda self, *a: State()

        def registerTimer(self, at):
            calls["timer"] += 1

        deleteTimer = registerTimer

    learner = loop.Learner(1.0, 80, 80, 5)
    learner.init(Handle())
    start = datetime(2020, 1, 1, tzinfo=timezone.utc)
    pages = [{"at": start + timedelta(minutes=20 * i), "pos": i, "topics": [f"topic {i} {n}" for n in range(90)]} for i in range(300)]
    out = [r for half in (pages[:150], pages[150:]) for r in learner.handleInputRows(("a",), iter(half), None)]
    assert sum(r["kind"] == "session" for r in out) == 99 and sum(calls.values()) < 2 * len(pages)


def plain_join(raw, ranks):
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        low = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks)))
        if parts[low] + parts[low + 1] not in ranks:
            break
        parts[low : low + 2] = [parts[low] + parts[low + 1]]
    return [ranks[p] for p in parts]


def test_encoders_of_long_words_and_empty_rows(spark):
    """Long words by a heap, in time that does not grow with the square of their length; rows of no words, null rows, and marks between rows."""
    rng = random.Random(5)
    long = "".join(rng.choice("aabc") for _ in range(700))
    merges = naive_train([(long, 3), ("abcabc", 9), ("aaaaaaa", 2)], 60)
    by_rule = list(long.encode())
    for r, p in enumerate(merges):
        by_rule = training.merged(by_rule, p, 264 + r)
    rank = {p: i for i, p in enumerate(merges)}
    assert tokens.encode_word(long, rank) == by_rule and all(tokens.encode_word("a" * n + "bc", rank) == training._heaped(list(("a" * n + "bc").encode()), rank, 264) for n in range(12))
    ranks = {bytes([i]): i for i in range(256)} | {p: 256 + i for i, p in enumerate(v for i, v in tokens.vocabulary(merges).items() if i >= 264)}
    rows = [([long, "abc"],), ([],), (None,), (["aaaa", "é", long[:90]],)]
    t = spark.createDataFrame(rows, "w array<string>").coalesce(1)
    one = lambda w: tokens.encode_word(w, rank)
    got = [r[0] for r in t.select(tokens.encoder(merges, ends=True)("w")).collect()]
    assert got == [[258, *sum(map(one, w or []), []), 259] for (w,) in rows]
    assert [r[0] for r in t.select(tokens.rank_encoder(ranks)("w")).collect()] == [sum((plain_join(x.encode(), ranks) for x in w or []), []) for (w,) in rows]
    back = t.select(tokens.decoder(merges)(tokens.encoder(merges)("w"))).collect()
    assert [r[0] for r in back] == ["".join(w or []) for (w,) in rows]
    odd = spark.createDataFrame([([97, 99_999, -4, 258, 195],), (None,)], "i array<int>").select(tokens.decoder(merges)("i")).collect()
    assert [r[0] for r in odd] == ["a�", None]
    began, huge = time.time(), "".join(rng.choice("abc") for _ in range(60_000))
    assert len(tokens.encode_word(huge, rank)) < 60_000 and time.time() - began < 10


def test_known_facts_meet_by_numbers(spark):
    """Neither texts nor all words of all texts go through a shuffle before they meet; copies of a text make no fact known."""
    known = spark.createDataFrame([("a b x y",)] * 9 + [("c d e f",), ("g h",)], "text string")
    asked = spark.createDataFrame([(1, "a b q r s"), (2, "c d q"), (3, "a b c d"), (4, "g h"), (5, "a b q r")], "id int, fact string")
    got = dedup.contained(asked, known, "fact", "text")
    assert {r["id"]: r["is_known"] for r in got.collect()} == {1: False, 2: True, 3: True, 4: False, 5: True}
    assert "Aggregate [_id#" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_diversity_counts_parts_of_hashes(spark):
    docs = spark.createDataFrame([("a b c d a b c",), ("A b c",), ("x",), (None,), ("e f g h",)], "text string").repartition(3)
    got = metrics.diversity(docs)
    assert tuple(got.first()) == (6 / 8, 6, 8, 0) and "explode" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(metrics.diversity(docs.limit(0)).first()) == (0.0, 0, 0, 0)


def test_diversity_of_tasks_without_a_trigram(spark):
    docs = spark.createDataFrame([("a b c",), ("x y",), (None,), ("",)], "text string").repartition(8)
    assert tuple(metrics.diversity(docs).first()) == (1.0, 1, 1, 0)
    assert tuple(metrics.diversity(docs.filter("text <> 'a b c'")).first()) == (0.0, 0, 0, 0)
    assert list(metrics._parted(iter([])))[0].num_rows == 0


def test_position_map_equals_a_plain_one(spark):
    rng = random.Random(9)
    rows = [(1, [1] * 40, [rng.randint(0, 5) for _ in range(60)]), (2, [], []), (3, [7, 8, 9], [4, 4, 4, 2]), (4, None, None)]
    data, expected = [], {}
    for doc, ours, theirs in rows:
        low = sorted(rng.randint(0, len(theirs)) for _ in ours) if ours is not None else None
        high = [min(x + rng.randint(0, 3), len(theirs)) for x in low] if ours is not None else None
        data.append((doc, ours, theirs, low, high))
        for i, (a, b) in enumerate(zip(low or [], high or [])):
            weights = {}
            for x in (theirs or [])[a:b]:
                for place, y in enumerate(theirs):
                    if x == y:
                        weights[place] = weights.get(place, 0) + 1 / (b - a)
            if weights:
                expected[doc, i] = [(p, round(w, 9)) for p, w in sorted(weights.items())]
    t = spark.createDataFrame(data, "doc_id int, our_ids array<int>, their_ids array<int>, low array<int>, high array<int>")
    for most in (1, 25, 1 << 20):
        got = vocab.position_map(t, most).collect()
        assert {(r[0], r[1]): [(p, round(w, 9)) for p, w in zip(r[2], r[3])] for r in got} == expected and len(got) == len(expected)


def test_first_rows_of_files_without_one_task(spark, tmp_path):
    at = str(tmp_path / "in")
    spark.range(30, numPartitions=4).select(F.concat(F.lit("w" * 120), F.col("id")).alias("text")).write.json(at)
    rows = sorted((r["file"], r["pos"], r["text"]) for r in readers.corpus(spark, at).collect())
    assert len(rows) == 30 and len({f for f, _, _ in rows}) == 4
    for n in (1, 7, 8, 15, 29, 30, 99):
        got = readers.corpus(spark, at, max_docs=n)
        assert sorted((r["file"], r["pos"], r["text"]) for r in got.collect()) == rows[:n]
        assert "Limit" not in got._jdf.queryExecution().optimizedPlan().toString()
