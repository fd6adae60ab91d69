"""The training-data operators against brute force, and on the cases that their docstrings define."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtext.llm import byte_bpe, components, exact_dedup, line_dedup, lm_scoring, mixing, oracle, preference, quality_mil, quality_rules, queries, sharding, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, hash string, size string, _len int, row int, fingerprint string, copies int, once int"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(5)
    long_text = "\n".join(" ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(rng.randint(1, 30))) for _ in range(2000))
    texts = [None, "", " \n\t ", "un mot", "a" * 5000, long_text, "x y z\nx y z\nx y z", "é œ 中文 \U0001f600", "un mot", "line one here now ok\nother words of this line", "UPPER lower", long_text + " fin"]
    rows = [(i, t, None, [None, "s1", "s2", ""][i % 4], None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[9], (None, "null id", "en", None, 7), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, *(None,) * 8) for r in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def text_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def ranks():
    tok = pytest.importorskip("public_tokenizers")
    return byte_bpe.load_ranks(tok.path("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_sql(name, spark, sf_dir, duck):
    from compare import assert_same

    assert_same(queries.queries()[name](spark, sf_dir), duck, oracle.oracle_sql()[name])


OPERATORS = {
    "lm": lambda d: lm_scoring.scored(d),
    "mil": lambda d: quality_mil.scored(d, d.select("doc_id", F.when(F.length("text") > 10, 1).otherwise(0).alias("quality"))),
    "rules": lambda d: quality_rules.judged(d),
    "lines": lambda d: line_dedup.deduplicated(d),
    "simhash": lambda d: simhash.grouped(d),
    "exact": lambda d: exact_dedup.exact_groups(d, digest=True),
    "shards": lambda d: sharding.shards(d, limit=3000),
    "mix": lambda d: mixing.sampled(d),
    "bpe": lambda d: byte_bpe.encoded(d, {bytes([i]): i for i in range(256)} | {b"un": 256}, r"\p{L}+|\s+|[^\s\p{L}]+"),
}


INTERNAL = ["row", "of", "of_key", "copies", "rows", "copy", "kept", "n", "page", "bits", "text_key", "_mix_id", "_mix_copies", "_gone_id", "_kept", "_copy_key", "removed", "line", "other", "node", "votes", "value", "key", "h", "l", "at", "chosen", "a.b"]
STAGES = {"mixed": mixing.mixed, "lines": lambda d: line_dedup.deduplicated(d).drop("removed_lines"), "copies": simhash.without_copies, "rules": quality_rules.passed}


@pytest.mark.parametrize("name", list(STAGES))
def test_columns_of_any_name_stay(name, spark):
    """A table with a column of every name that the operators use themselves gives the same documents as one without."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["le", "chat", "dort", "ici", "maintenant", "demain", f"mot{i}"]) for _ in range(70)) for i in range(30)]
    rows = [(i, texts[i % 24], "s", "en") for i in range(30)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    full = plain.withColumns({c: F.lit(c) for c in INTERNAL})
    got = STAGES[name](full)
    assert got.columns == full.columns
    assert sorted(map(tuple, got.select(*plain.columns).collect())) == sorted(map(tuple, STAGES[name](plain).collect()))
    assert all(r[c] == c for r in got.select(*[F.col(f"`{c}`") for c in INTERNAL]).collect() for c in INTERNAL)


def test_talks_with_columns_of_any_name(spark):
    talks = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b")]), (2, [("user", "a"), ("assistant", "c")])], "conv_id long, turns array<struct<role: string, text: string>>")
    assert preference.by_first_turn(talks.withColumns({c: F.lit(0) for c in ("chosen", "rejected", "chosen_id", "_n", "_key", "open")})).count() == 1


@pytest.mark.parametrize("name", list(OPERATORS))
def test_edge_rows_all_come_back(name, edge):
    got = OPERATORS[name](edge)
    assert sorted(str(r["doc_id"]) for r in got.select("doc_id").collect()) == sorted(str(r["doc_id"]) for r in edge.select("doc_id").collect())


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(name, edge):
    assert OPERATORS[name](edge.filter("doc_id > 1000")).count() == 0


# 1
def test_lm_base_counts_and_sums(docs, text_of):
    got = {r["doc_id"]: r for r in lm_scoring.scored(docs, block_bytes=1 << 16).collect()}
    words = {i: lower(t).encode().split() + [b""] for i, t in text_of.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in text_of}
    c = collections.Counter(w for i in words if not held[i] for w in words[i])
    n, v = sum(c.values()), len(c)
    for i, w in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(x in c for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_block_size_changes_nothing(docs):
    a, b = ({r["doc_id"]: r["score"] for r in lm_scoring.scored(docs, block_bytes=n).collect()} for n in (1 << 15, 1 << 24))
    assert all(math.isclose(a[i], b[i], rel_tol=1e-9) for i in a)


def plain_weights(c, pairs):
    """fail and share by size class, from the formulas of the module's text, one class at a time."""
    size = lambda n: n.bit_length()
    types, tokens = collections.Counter(map(size, c.values())), collections.Counter()
    for n in c.values():
        tokens[size(n)] += n
    n = sum(c.values())
    once = max(sum(x == 1 for x in c.values()), 0.5)
    whole = n + once
    mass = {k: tokens[k] / whole for k in tokens} | {0: once / whole}
    typical = {k: tokens[k] / types[k] / n for k in tokens} | {0: 0.0}
    context = {k: (tokens[k] / types[k] if k in tokens else 2 ** (k - 0.5)) if k else 0.0 for k in range(64)}
    fresh = {b: {k: mass[k] * math.exp(-context[b] * typical[k]) for k in mass} for b in context}
    chance = {b: sum(fresh[b].values()) for b in fresh}
    expected = sum(tokens[k] * np.interp(max(context[k] - 1, 0), [context[b] for b in range(64)], [chance[b] for b in range(64)]) for k in tokens)
    found = sum(x == 1 for x in pairs.values())
    fail = {b: 1.0 if b == 0 else min(max(chance[b] * found / expected, 1e-4), 1 - 1e-4) for b in chance}
    return fail, {b: {k: fresh[b][k] / chance[b] for k in mass} for b in fresh}, tokens


def test_lm_score_is_a_plain_traversal(docs, text_of):
    words = {i: lower(t).encode().split() + [b""] for i, t in text_of.items()}
    taught = [w for i, w in words.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(x for w in taught for x in w)
    pairs = collections.Counter(x for w in taught for x in zip([b""] + w, w))
    fail, share, tokens = plain_weights(c, pairs)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.scored(docs, block_bytes=1 << 17).collect()}
    for i, w in words.items():
        state, score = b"", 0.0
        for x in w:
            b, k = c[state].bit_length(), c[x].bit_length()
            lower_p = share[b][k] * (c[x] / tokens[k] if k else 1.0)
            if pairs[state, x]:
                score += math.log10((1 - fail[b]) * pairs[state, x] / c[state] + fail[b] * lower_p)
            else:  # the failure arc, then an arc of the state behind it
                score += math.log10(fail[b]) + math.log10(lower_p)
            state = x
        assert math.isclose(got[i], score, rel_tol=1e-6)


def test_lm_states_sum_to_one_and_lanes_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    lengths = np.array([6, 300, 1, 40])
    tokens = rng.integers(1, 30, lengths.sum())
    tokens[np.cumsum(lengths) - 1] = 0
    training = np.array([True, True, False, True])
    block = lm_scoring.Block(tokens, lengths, np.arange(30, dtype=np.uint64), training, 3)
    count, pair = block.word_counts.astype(np.int64), block.pair_counts.astype(np.int64)
    size = lm_scoring.size_class(count)
    types, total = np.bincount(size[count > 0], minlength=64).astype(float), np.bincount(size, count, minlength=64)
    w = lm_scoring.Weights(types, total, int((count == 1).sum()), int((pair == 1).sum()))
    unknown = int(np.flatnonzero(np.append(count, 0) == 0)[0])
    a = lm_scoring.Automaton(w, block.pairs, np.append(count, 0), pair)
    vocabulary = np.append(np.flatnonzero(count), unknown)
    for h in range(31):
        state, weight = a.step(np.full(len(vocabulary), h), vocabulary)
        assert (state == vocabulary).all() and math.isclose((10**weight).sum(), 1, rel_tol=1e-9)
    whole = a.traverse(tokens, lengths)
    monkeypatch.setattr(lm_scoring, "LANE", 7)
    assert np.allclose(a.traverse(tokens, lengths), whole)


# 2
def test_mil_learns_held_out_labels(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    d, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    rows = quality_mil.scored(d, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_mil_encodes_the_whole_text():
    a = quality_mil.encode(b"word " * 640)
    assert len(a) == 10 and np.allclose(a[0, :130], a[-1, :130], atol=0.01)
    b = quality_mil.encode(b"word " * 576 + b"%%% " * 64)
    assert b[-1, ord("%")] > 0.5 and len(b) == 10


def test_mil_gradient():
    rng = np.random.default_rng(0)
    bags, y = [rng.random((n, quality_mil.FEATURES)) for n in (1, 3, 2)], np.array([1, 0, 1])
    a, b = quality_mil.train(bags, y, steps=0), quality_mil.train(bags, y, steps=200)
    loss = lambda w: -np.mean(np.log(np.where(y == 1, quality_mil.score(w, bags), 1 - quality_mil.score(w, bags))))
    assert loss(b) < 0.5 * loss(a)


# 3
def test_bpe_as_the_library(docs, text_of, ranks):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encoded(docs, ranks, public_tokenizers.PATTERN, digests=True)
    for r in byte_bpe.decoded(got, ranks).collect():
        ids = enc.encode_ordinary(text_of[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]).decode() == text_of[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text_of[r["doc_id"]].encode()).hexdigest()


def test_bpe_long_words_and_spaces(ranks):
    import public_tokenizers
    import regex
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    split = regex.compile(byte_bpe.exact_pattern(public_tokenizers.PATTERN)).findall
    for _ in range(200):
        t = "".join(rng.choice("abeiou  \x1c\x85　\n'sé1!") for _ in range(rng.randint(1, 400)))
        assert [i for w in split(t) for i in byte_bpe.merge(w.encode(), ranks)] == enc.encode_ordinary(t)
    for _ in range(50):
        w = "".join(rng.choice("theaniou") for _ in range(rng.randint(1, 500))).encode()
        assert byte_bpe.merge_heap(w, ranks) == byte_bpe.merge_scan(w, ranks)


# 4
def test_preference_prefix(spark):
    turn = "array<struct<turn:bigint,role:string,text:string>>"
    a, b = (0, "user", "q"), (1, "assistant", "yes")
    rows = [(1, [a, b], [a, (1, "assistant", "no")]), (2, [a], [a]), (3, [a, b], [a]), (4, [a], None), (5, [], [a])]
    got = {r["id"]: r for r in preference.formatted(spark.createDataFrame(rows, f"id int, chosen {turn}, rejected {turn}")).collect()}
    assert got[1]["prompt"] == "<|user|>\nq\n" and got[1]["chosen_completion"] == "<|assistant|>\nyes\n" and got[1]["rejected_completion"] == "<|assistant|>\nno\n"
    s = got[1]["chosen_spans"][0]
    assert got[1]["chosen_completion"][s["start"] : s["end"]] == "yes\n"
    assert (got[2]["prompt_turns"], got[2]["chosen_completion"], got[2]["chosen_spans"]) == (1, "", [])
    assert got[3]["rejected_completion"] == "" and got[4]["rejected_completion"] is None and got[5]["prompt"] == ""


def test_preference_pairs_share_the_first_turn(spark):
    rows = [(c, 0, "user", "same") for c in range(5)] + [(c, 1, "assistant", str(c)) for c in range(1, 5)] + [(9, 0, "user", "other"), (9, None, None, None), (9, 0, "user", "other")]
    talks = preference.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["chosen_id"], r["rejected_id"]) for r in preference.by_first_turn(talks).collect()}
    assert got == {(1, 0), (1, 2), (1, 3), (1, 4), (9, None)}
    assert preference.by_first_turn(talks.filter("conv_id < 0")).count() == 0


def test_preference_keeps_null_ids(spark):
    rows = [(c, 0, "user", "same") for c in (None, 1, 2)] + [(c, 1, "assistant", "x") for c in (None, 1)] + [(3, 0, "user", "b"), (4, 0, "user", "c"), (4, 1, "assistant", "y")]
    pairs = lambda x: sorted(str((r["chosen_id"], r["rejected_id"], r["rejected"] is None)) for r in preference.by_first_turn(preference.conversations(spark.createDataFrame(x, "conv_id long, turn long, role string, text string"))).collect())
    assert pairs(rows) == sorted(["(1, None, False)", "(1, 2, False)", "(3, None, True)", "(4, None, True)"])
    assert pairs(rows[:1] + rows[2:4]) == ["(None, 2, False)"]


# 5
def brute_print(t, k=3):
    w = WORD.findall(lower(t or ""))
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, most):
    up = {i: i for i in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in prints}


def test_simhash_against_brute_force(docs, text_of):
    prints = {i: brute_print(t) for i, t in text_of.items()}
    got = {r["doc_id"]: r for r in simhash.grouped(docs).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(prints, 3)


@pytest.mark.parametrize("entry_rows", [3, 1000])
def test_links_lose_no_pair(spark, entry_rows):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {i: rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for i in range(150)}
    df = spark.createDataFrame([(bytearray(p.to_bytes(8, "big")),) for p in set(prints.values())], "fingerprint binary")
    root = {bytes(r["node"]): bytes(r["root"]) for r in components.components(simhash.links(df, 8, 3, entry_rows)).collect()}
    mine = {i: root.get(p.to_bytes(8, "big"), p.to_bytes(8, "big")) for i, p in prints.items()}
    brute = brute_components(prints, 3)
    pairs = lambda m: {tuple(sorted(i for i in m if m[i] == r)) for r in set(m.values())}
    assert pairs(mine) == pairs(brute)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 201), (202, None)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.components(edges.filter("a > 1000")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs_and_stars(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(500, i) for i in range(300, 420)]
    rng.shuffle(edges)
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: up[x] for x in linked}


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Frame:
        class sparkSession:
            sparkContext = Context()
            conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        simhash.settled(Frame())


# 6
def test_rule_counts(docs, text_of):
    got = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    for i, t in text_of.items():
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        inside = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_rules_against_labels(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    d = spark.read.parquet(f"{larger}/documents.parquet")
    rows = quality_rules.judged(d).join(labels, "doc_id").filter("not base_failed").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1) and not any(r["kept"] for r in rows if r["quality"] == 0)
    kept = quality_rules.passed(d)
    assert kept.columns == d.columns and kept.count() == quality_rules.judged(d).filter("kept").count()


def test_expectation_maximisation_finds_kinds_of_bad_documents():
    rng = np.random.default_rng(0)
    kind = rng.choice([-1, 0, 1, 2, 3], 5000, p=[0.8, 0.08, 0.06, 0.04, 0.02])  # -1 is good
    bad = np.where(kind[:, None] == np.arange(4), 0.95, np.where(kind[:, None] < 0, 0.02, 0.15))
    votes = np.where(rng.random((5000, 4)) < 0.1, 0, np.where(rng.random((5000, 4)) < bad, -1, 1))
    patterns, of, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = quality_rules.posteriors(patterns, n.astype(float))[of.ravel()]
    # no verdict can be better on average than the one that knows how the votes were drawn
    share, chance = np.array([0.8, 0.08, 0.06, 0.04, 0.02]), np.where(np.arange(-1, 4)[:, None] == np.arange(4), 0.95, np.where(np.arange(-1, 4)[:, None] < 0, 0.02, 0.15))
    like = share * np.where(votes[:, None] < 0, chance, np.where(votes[:, None] > 0, 1 - chance, 1)).prod(2)
    best = like[:, 0] >= like[:, 1:].sum(1)
    assert ((p >= 0.5) == (kind < 0)).mean() >= (best == (kind < 0)).mean() - 0.01


# 7
def words_in(line):
    return len(WORD.findall(line))


def run_places(text, least=5):
    """(first place, lines after it, lines) of the shortest runs of ``least`` words that begin or end at each line with a word; and the lines' numbers."""
    lines = [(n, x) for n, x in enumerate(text.split("\n")) if words_in(x)]
    found = set()
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            if sum(words_in(x) for _, x in lines[i : j + 1]) >= least:
                found.add((i, j - i))
                break
    for j in range(len(lines)):
        for i in range(j, -1, -1):
            if sum(words_in(x) for _, x in lines[i : j + 1]) >= least:
                found.add((i, j - i))
                break
    return [(i, n, tuple(x for _, x in lines[i : i + n + 1])) for i, n in sorted(found)], [n for n, _ in lines]


def plain_chain(anchors):
    """The longest chain by comparing all pairs; of several the one that ends least, and so on back."""
    best = []
    for i, (_, y) in enumerate(anchors):
        best.append(1 + max((best[j] for j in range(i) if anchors[j][1] < y), default=0))
    out, end, limit = [], max(best, default=0), None
    while end:
        y, i = min((anchors[i][1], i) for i in range(len(anchors)) if best[i] == end and (limit is None or i < limit))
        out, limit, end = [anchors[i], *out], i, end - 1
    return out


def plain_patience(a, b, at=(0, 0)):
    """Aligned places of two sequences: ends, then anchors that are unique in both, then what lies between them."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [at, *plain_patience(a[1:], b[1:], (at[0] + 1, at[1] + 1))]
    if a[-1] == b[-1]:
        return [*plain_patience(a[:-1], b[:-1], at), (at[0] + len(a) - 1, at[1] + len(b) - 1)]
    anchors = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    if not anchors:
        nth = [(i, [j for j, y in enumerate(b) if y == x]) for i, x in enumerate(a)]
        numbered = [(i, js[a[:i].count(a[i])]) for i, js in nth if a[:i].count(a[i]) < len(js)]
        return [(at[0] + i, at[1] + j) for i, j in plain_chain(numbered)]
    out, last = [], (0, 0)
    for i, j in [*plain_chain(anchors), (len(a), len(b))]:
        out += plain_patience(a[last[0] : i], b[last[1] : j], (at[0] + last[0], at[1] + last[1]))
        if i < len(a):
            out.append((at[0] + i, at[1] + j))
        last = (i + 1, j + 1)
    return out


def brute_lines(texts):
    """For each document, the lines of what a patience diff aligns with any document that was the first to have one of its runs."""
    runs, first = {i: run_places(t) for i, t in texts.items()}, {}
    for i in sorted(texts):
        for r in runs[i][0]:
            first.setdefault(r[2], i)
    gone = {}
    for i in texts:
        mine, numbers = runs[i]
        gone[i] = set()
        for other in {first[r[2]] for r in mine} - {i}:
            theirs = runs[other][0]
            common = {r[2] for r in mine} & {r[2] for r in theirs}
            a, b = [r for r in mine if r[2] in common], [r for r in theirs if r[2] in common]
            for x, _ in plain_patience([r[2] for r in a], [r[2] for r in b]):
                gone[i] |= set(numbers[a[x][0] : a[x][0] + a[x][1] + 1])
    return gone


def removed(spark_rows):
    return {r["doc_id"]: {x["line"] for x in r["removed_lines"] or []} for r in spark_rows}


def test_line_dedup_against_brute_force(docs, text_of):
    gone = brute_lines(text_of)
    assert sum(map(len, gone.values())) > 50
    rows = line_dedup.deduplicated(docs).collect()
    assert removed(rows) == gone
    for r in rows:
        lines = text_of[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for i, x in enumerate(lines) if i not in gone[r["doc_id"]])


def short_lines(rng, n, distinct):
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 6]))) for _ in range(60)]
    return {i: "\n".join((rng.sample if distinct else lambda x, k: rng.choices(x, k=k))(sorted(set(lines)) + [""], rng.randint(3, 25))) for i in range(n)}


@pytest.mark.parametrize(("seed", "distinct"), [(7, True), (8, False), (9, False)])
def test_line_dedup_looks_at_all_earlier_documents(spark, seed, distinct):
    texts = short_lines(random.Random(seed), 60, distinct)
    got = removed(line_dedup.deduplicated(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    assert got == brute_lines(texts)


def test_copy_whose_lines_have_other_first_holders(spark):
    lines = ["aa bb", "cc dd", "ee ff", "gg hh"]
    rows = [(1, lines[0]), (2, lines[1]), (5, lines[2]), (6, lines[3]), (3, "\n".join(lines)), (4, "\n".join(lines))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {4: ""}


def test_alignment_equals_a_plain_patience_diff():
    rng = random.Random(4)
    left = 0
    for n in range(400):
        a, b = ([rng.choice("abcdefghijklmnop"[: 3 + n % 13]) for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = line_dedup.aligned(a, b)
        assert sorted(got) == sorted(plain_patience(a, b))
        assert all(a[i] == b[j] for i, j in got) and all(x[1] < y[1] for x, y in zip(sorted(got), sorted(got)[1:]))
        left += len(set(a) & set(b)) - len({a[i] for i, _ in got})
    assert left > 100  # much that both have is out of order


def test_lines_out_of_order_stay(spark):
    one, two, three, four = ("alpha beta gamma delta eins", "un deux trois quatre cinq", "here are five more words", "last line of the lot")
    rows = [(1, "\n".join([one, two, three, four])), (2, "\n".join([two, three, one, four])), (3, "\n".join([one, one, four])), (4, "new words stand here now\n" + two)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: one, 3: one, 4: "new words stand here now"}


def test_passage_goes_from_the_later_document(spark):
    passage = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(3))
    rows = [(1, "own one\n" + passage, "a"), (2, "own two words\n" + passage + "\nmore of my own", "b"), (3, "clean text of its own", "c"), (4, "The end.\nown", "d"), (5, "The end.\nother", "e")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, other string")).collect()}
    assert got == {1: rows[0][1], 2: "own two words\nmore of my own", 3: rows[2][1], 4: rows[3][1], 5: rows[4][1]}


def test_moved_block_and_further_repeat_stay(spark):
    a, b, c = ("\n".join(f"{x} line {i} of this block" for i in range(3)) for x in "abc")
    rows = [(1, f"{a}\n{b}\n{c}"), (2, f"{c}\n\nown words stand here now\n{a}\n{a}\n{b}")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # a and b are in order, so c, which stands before them here and after them there, stays; so does the second a
    assert got == {1: rows[0][1], 2: f"{c}\n\nown words stand here now\n{a}"}


def test_line_dedup_on_edge_rows(spark):
    line = "a line of five words"
    rows = [(1, line, 0), (2, None, 1), (3, "", 2), (4, " \n\t", 3), (None, line, 4), (5, line, 5), (5, line, 6), (5, "another text of this very id", 7), (6, "another text of this very id\n", 8), (7, f"{line}\n" * 3000, 9)]
    out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, line int"))
    assert out.columns == ["doc_id", "text", "line", "removed_lines"]
    got = {r["line"]: r["text"] for r in out.collect()}
    assert got == {0: line, 1: None, 2: "", 3: " \n\t", 4: line, 5: "", 6: "", 7: "another text of this very id", 8: "", 9: f"{line}\n" * 2999}  # once, as often as the earlier one has it


# 8
def test_exact_groups(edge):
    got = exact_dedup.exact_groups(edge).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[3]["keep_id"] == by[8]["keep_id"] == 3 and by[3]["group_size"] == 3
    assert by[2]["kept"] and not by[0]["kept"] and by[0]["keep_id"] == by[1]["keep_id"] == 2
    assert by[5]["group_size"] == by[11]["group_size"] == 1


def test_exact_groups_after_the_prefix(spark):
    rows = [(1, "p" * 400 + "a"), (2, "p" * 400 + "b"), (3, "p" * 400 + " a"), (4, "p" * 401)]
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, False), 2: (2, True), 3: (3, True), 4: (4, True)}


# 9
@pytest.mark.parametrize("limit", [500, 5000, 10**9])
def test_shards_fit_and_split_only_where_needed(docs, limit):
    rows = sharding.shards(docs, limit).collect()
    size = collections.Counter()
    for r in rows:
        size[r["shard"]] += r["bytes"]
    assert all(r["shard_bytes"] == size[r["shard"]] and r["fits"] == (size[r["shard"]] <= limit) for r in rows)
    for s in size:
        assert not any(t != s and t.startswith(s) for t in size)
        assert s == "" or sum(v for t, v in size.items() if t.startswith(s[:-1])) > limit
    single = collections.Counter(r["shard"] for r in rows)
    assert all(r["fits"] or single[r["shard"]] == 1 for r in rows)


def test_equal_hashes_stay_together(spark):
    df = spark.createDataFrame([(1, "x" * 10)] * 3 + [(2, "y")], "doc_id long, text string")
    got = {(r["doc_id"], r["shard_docs"], r["fits"]) for r in sharding.shards(df, 20).collect()}
    assert (1, 3, False) in got


# 10
def fill(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = left / sum(w[s] for s in free)
        over = {s for s in free if share * w[s] > most * sizes[s]}
        if not over:
            return target | {s: share * w[s] for s in free}
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def test_targets(spark):
    rng = random.Random(4)
    for _ in range(6):
        sizes = {rng.choice([None, *"abcdefgh"]): rng.choice([0, 1, 10, 1000]) for _ in range(7)}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()}
        assert all(math.isclose(got[s], t, rel_tol=1e-9, abs_tol=1e-9) for s, t in fill(sizes).items())


def test_mixing_meets_targets_and_reruns_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/documents.parquet")
    rows = mixing.sampled(docs).collect()
    taken = collections.Counter()
    for r in rows:
        taken[r["source"]] += r["copies"] * r["size"]
        assert 0 <= r["copies"] <= 3
    target = {r["source"]: r["target"] for r in rows}
    assert all(abs(taken[s] / target[s] - 1) < 0.1 for s in target)
    assert sorted(map(tuple, mixing.sampled(docs.repartition(5)).collect())) == sorted(map(tuple, rows))


def test_copies_differ_by_one_in_a_source(docs):
    rates = collections.defaultdict(set)
    for r in mixing.sampled(docs).collect():
        rates[r["source"]].add(r["copies"])
    assert all(max(v) - min(v) <= 1 for v in rates.values())


def test_mixed_rows(edge):
    copies = sum(r["copies"] for r in mixing.sampled(edge).collect())
    got = mixing.mixed(edge)
    assert got.columns == edge.columns and got.count() == copies


# the pipeline
def test_pipeline_stages(spark, sf_dir, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = docs.columns
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert docs.count() > 0
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == own
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert pipeline.run(spark, sf_dir).count() == docs.count()


def test_pipeline_stages_on_edge_rows(spark, edge, sf_dir, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in pipeline.STAGES:
        stage(spark, edge, sf_dir).write.parquet(str(tmp_path / name))
        stage(spark, edge.filter("doc_id > 1000"), sf_dir).write.parquet(str(tmp_path / f"{name}-empty"))


def test_near_duplicate_stage_judges_rows(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    t, u = " ".join(f"t{i}" for i in range(80)), " ".join(f"u{i}" for i in range(80))
    rows = [(1, t, 0), (2, t, 1), (2, u, 2), (2, u, 2), (None, t, 3), (None, "own words of a row without id", 4), (5, None, 5), (6, " ", 6)]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, node int"), sf_dir)
    assert sorted(r["node"] for r in got.collect()) == [0, 2, 4, 5]


def test_frequent_shingles_change_no_result(spark):
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join(passage + [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([2, 6, 9, 30, 80]))])) for i in range(150)]
    shingles = {i: {tuple(t.split()[a : a + 5]) for a in range(len(t.split()) - 4)} for i, t in rows}
    least = {i: i for i in shingles}
    links = [(i, j) for i in shingles for j in shingles if i < j and 5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j])]
    assert len(links) > 100
    for _ in least:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(df).collect()} == least


def test_sketches_lose_no_near_pair_and_tell_far_ones():
    rng = np.random.default_rng(7)
    fresh = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    for n in (0, 1, 9, 63, 320, 399, 400, 401, 500, 799, 800, 1000, 5000, 40_000):
        for _ in range(20):
            x = fresh(n)
            others = [np.concatenate([x[n // 9 :], fresh(n // 9)]), x[: -(-4 * n // 5)], np.concatenate([x, fresh(n // 4)]), np.concatenate([x[: n // 20], fresh(n - n // 20)])]
            for y in others:
                sets = [np.unique(x), np.unique(y)]
                table = pa.table({"fingerprint": [simhash.fold_bits(h) for h in sets], "parity": [simhash.parity(h) for h in sets], "n": [len(h) for h in sets]})
                may = bool(simhash.Candidates(table, 64)(0, np.array([1]))[0])
                common, either = len(np.intersect1d(*sets)), len(np.union1d(*sets))
                if 5 * common >= 4 * either:
                    assert may
                elif n > 60 and 2 * common < either:
                    assert not may


def test_near_duplicates_on_the_documents(spark, sf_dir):
    """Recall against exact Jaccard similarity of all pairs that share a shingle, at the stage's threshold."""
    d = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").filter(F.length("text") > 0)
    sets, holders = {}, collections.defaultdict(list)
    for r in d.collect():
        w = lower(r["text"]).encode().split()
        sets[r["doc_id"]] = {hash(tuple(w[a : a + 5])) for a in range(max(len(w) - 4, 1))} if w else set()
    for i in sorted(sets):
        for h in sets[i]:
            holders[h].append(i)
    common = collections.Counter((a, b) for v in holders.values() if 1 < len(v) <= 400 for n, a in enumerate(v) for b in v[n + 1 :])
    links = [(a, b) for (a, b) in common if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    group = {r["doc_id"]: r["component_id"] for r in simhash.similar(d).collect()}
    assert len(links) > 10 and all(group[a] == group[b] for a, b in links)


def test_near_duplicate_stage(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    base = [words(300) for _ in range(40)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        copy = list(b)
        for at in rng.sample(range(300), 3):
            copy[at] = "changed"
        rows.append((100 + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in pipeline.near_duplicates(spark, df, sf_dir).collect()}
    assert left >= set(range(40)) and len(left) <= 42


def test_near_duplicate_stage_is_jaccard_at_the_threshold(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    rows, shingles = [], {}
    for g in range(60):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([6, 9, 60, 200]))]
        for n in range(4):
            text = list(base)
            for _ in range(round(len(base) * 0.05 * n * rng.uniform(0.4, 0.6))):
                text[rng.randrange(len(text))] = f"x{rng.randint(0, 10**6)}"
            rows.append((4 * g + n, " ".join(text + base[: n % 2])))
    rows += [(1000, None), (1001, "")] + [(2000 + i, rows[4 * i][1]) for i in range(10)]
    for i, t in rows:
        w = (t or "").split()
        shingles[i] = {tuple(w[a : a + 5]) for a in range(max(len(w) - 4, 1))} if w else set()
    least = {i: i for i in shingles}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    links = [(i, j) for i in shingles for j in shingles if i < j and jaccard(shingles[i], shingles[j]) >= 0.8]
    assert sum(jaccard(shingles[i], shingles[j]) < 0.85 for i, j in links) > 10
    for _ in range(10):
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in pipeline.near_duplicates(spark, df, sf_dir).collect()} == {i for i in least if least[i] == i}


def test_last_stage_decodes(spark, docs, text_of, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    for r in pipeline.encode(spark, docs, sf_dir).collect():
        assert len(r["ids"]) == r["n_tokens"] and r["decoded_sha256"] == hashlib.sha256(text_of[r["doc_id"]].encode()).hexdigest()


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py", "spark-warehouse"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path / "r", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 60


def test_bpe_fold_in_spark_functions(spark, docs, ranks):
    words = docs.limit(20).select(F.explode(F.split("text", " ")).alias("word")).distinct().unionByName(spark.createDataFrame([(None,), ("",)], "word string"))
    for r in byte_bpe.folded(words, ranks).collect():
        assert r["ids"] == (None if r["word"] is None else byte_bpe.merge(r["word"].encode(), ranks) if r["word"] else [])
