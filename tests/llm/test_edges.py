"""Clashing columns, empty tables, repeated rows and long texts, where the tests of the operators don't have them."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridecl.llm import chat, near_dedup, packing, secrets, substring_dedup, suffix_dedup, topk, toxicity, url_filter
from veridecl.llm import textvec as tv
from veridecl.llm.components import connected_components

KEY = "AKIA" + "Z9" * 9


def test_components_against_a_search(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 240)] + [(7, 7), (7, 8), (7, 8)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        if start not in want and near[start] - {start}:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = start
                    todo += near[x]
    got = connected_components(spark.createDataFrame([*edges, (None, 3), (3, None)], "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted(want.items())
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def thue_morse(bits):
    word = [0]
    for _ in range(bits):
        word += [1 - x for x in word]
    return word


def test_words_that_polynomials_confuse_are_not_linked(spark):
    """Sums of powers modulo 2**64 are equal for a Thue-Morse word and its complement, whatever the base."""
    w = thue_morse(10)
    a, b = ("".join("ab"[x ^ flip] for x in w) for flip in (0, 1))
    c, d = (" ".join(("left", "right")[x ^ flip] for x in thue_morse(11)) for flip in (0, 1))
    rows = [(1, a), (2, b), (3, f"x {a} y"), (4, f"x {b} y"), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, shingle=3, percent=85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    data = np.frombuffer(f"{a} {b} {a[:700]} {b[:700]} {a}".encode(), np.uint8)
    starts, ends, _ = tv.word_spans(data, np.array([0, len(data)]), tv.NOT_SPACE)
    hashes = tv.word_hashes(data, starts, ends)
    assert hashes[0] == hashes[4] and len(set(hashes.tolist())) == 4
    words = np.concatenate([np.frombuffer(np.array([hash_of(x) for x in t.split()], np.uint64).tobytes(), np.uint64) for t in (c, d)])
    one, two = substring_dedup._hash_pair(words, np.array([0, 2048]), np.array([2048, 4096]))
    assert one[0] != one[1] and two[0] != two[1]


def hash_of(word):
    return int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "little")


def test_word_hashes_follow_bytes_only():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    for join in (b" ", b"  \n"):
        data = np.frombuffer(join.join(words), np.uint8)
        starts, ends, _ = tv.word_spans(data, np.array([0, len(data)]), tv.NOT_SPACE)
        hashes = tv.word_hashes(data, starts, ends).tolist()
        assert len(hashes) == 400 and len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))
    assert len(tv.word_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_weak_parts_inside_base_spans_count_once(spark):
    text = f"id {KEY} secret=aB3dE6gH9jK2mN5pQ8sT1vW4yZ7 end"
    rows = [(1, text, "x", "y"), (1, text, "x", "y"), (None, text, "x", "y"), (2, "é" * 300_000 + text, "x", "y"), (3, None, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, kind string")
    got = secrets.scan(docs).collect()
    one = sorted((m.start(), m.end(), k) for k, p in (("access", KEY), ("assign", "secret=[A-Za-z0-9]+")) for m in re.finditer(p, text))
    spell = lambda shift: ",".join(f"{k}:{s + shift}:{e + shift}" for s, e, k in one)
    assert sorted((repr(r.doc_id), r.spans, r.n_linked) for r in got) == sorted([("1", spell(0), 0), ("1", spell(0), 0), ("None", spell(0), 0), ("2", spell(300_000), 0), ("3", "", 0)])
    assert secrets.scan(docs.filter("doc_id > 9")).count() == secrets.redact(docs.filter("doc_id > 9")).count() == 0


def test_columns_of_the_models_names_stay(spark):
    rows = [(i, "word " * 5 + ("vile slur" if i % 3 == 0 else "good day"), 9.0, i, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic double, __words long, row string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    got = toxicity.drop_toxic(docs, labels)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] % 3)
    none = docs.filter("doc_id < 0")
    assert toxicity.toxicity(none, labels).count() == toxicity.drop_toxic(none, labels).count() == 0
    twice = toxicity.toxicity(docs.unionByName(docs), labels).groupBy("doc_id").agg({"p_toxic": "min"}).count()
    assert twice == 60


def test_held_out_labels_don_t_reach_their_own_predictions(spark):
    """Turning the labels of one fold over changes the other folds' predictions, but none of its own."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(360):
        some = rng.sample(words, 12)
        rows.append((i, some + (["vile"] if i % 3 == 0 else ["kind"]) + [f"only{i % 90}"], float(i % 3 == 0 and rng.random() < 0.9), float(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, __w array<string>, y_low_quality double, y_toxic double").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(toxicity.FOLDS))).persist()
    chain = toxicity.Chain.__new__(toxicity.Chain)
    chain.names = ["low_quality", "toxic"]
    turned = docs.withColumn("y_low_quality", F.when(F.col("fold") == 0, 1 - F.col("y_low_quality")).otherwise(F.col("y_low_quality")))
    one, two = ({r.doc_id: (r.fold, r.p_low_quality) for r in chain.out_of_fold(d, "low_quality", []).collect()} for d in (docs, turned))
    assert sorted(one) == sorted(two) == list(range(360))
    for i, (fold, p) in one.items():
        assert (abs(two[i][1] - p) < 1e-9) == (fold == 0)
    # and a fold's predictions are those of a model of the other folds alone
    alone = chain.out_of_fold(docs.filter("fold <> 0 or doc_id % 2 = 0"), "low_quality", [])
    assert all(abs(one[r.doc_id][1] - r.p_low_quality) < 1e-9 for r in alone.filter("fold = 0").collect())
    hits = [p > 0.5 for i, (_, p) in one.items() if i % 3 == 0]
    assert sum(hits) > 0.9 * len(hits)


def test_url_rules_against_counting(spark):
    """Of all token sets that are frequent with the label, those that are sure and beat all their subsets."""
    rng = random.Random(12)
    rows = [(sorted(rng.sample("abcdef", rng.randrange(1, 6))), None) for _ in range(300)]
    rows = [(t, len({"a", "b"} & set(t)) == 2 and rng.random() < 0.9 or "f" in t and rng.random() < 0.7) for t, _ in rows]
    got = {r.rule: (r.confidence, r.support) for r in url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()}
    fits, hits = Counter(), Counter()
    for t, bad in rows:
        for n in range(1, len(t) + 1):
            for some in itertools.combinations(t, n):
                fits[some] += 1
                hits[some] += bad
    least = url_filter.SUPPORT * len(rows)
    sure = {s: hits[s] / fits[s] for s in fits if hits[s] >= least}
    want = {"&".join(s): (pytest.approx(c), pytest.approx(hits[s] / len(rows))) for s, c in sure.items() if c >= url_filter.CONFIDENCE and all(sure.get(q, 0) < c for n in range(1, len(s)) for q in itertools.combinations(s, n))}
    assert got == want
    pages = spark.createDataFrame([(1, "https://a.b/c", "h"), (1, "https://a.b/c", "h"), (None, None, "h")], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.verdict for r in url_filter.filter_urls(pages, labels).collect()] == ["allow"] * 3
    assert url_filter.filter_urls(pages.filter("page_id > 9"), labels).count() == 0


def test_url_tokens_that_go_together_are_mined_as_one(spark):
    """Sixty urls of one template with 30 query names, of which no set of names is mined apart."""
    query = "&".join(f"name{chr(97 + k // 26)}{chr(97 + k % 26)}=1" for k in range(30))
    urls = [f"https://bad.io/x?{query}"] * 60 + [f"https://good.io/{w}" for w in ("x", "x", "y")] * 30 + ["https://bad.io/y", "https://other.io/z?nameab=3"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 60), 0) for i in range(151)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.mined) for r in url_filter.filter_urls(pages, labels).collect()}
    assert {got[i][0] for i in range(60)} == {"block"} and {got[i] for i in range(60, 150)} == {("allow", None)}
    # one name of the class is enough; a host that a good page has too is sure enough
    assert got[151] == ("block", "q:nameab") and got[150] == ("block", "d:bad.io")
    rows = spark.createDataFrame([(["a", "b", "z"], True)] * 3 + [(["z"], True), (["z"], False)], "tokens array<string>, bad boolean")
    assert sorted((r.rule, r.confidence, r.support) for r in url_filter.mine_rules(rows).collect()) == [("a|b", 1.0, 0.6), ("z", 0.8, 0.8)]


def plain_cuts(ends, total):
    """The least cost over the same places, from every place to every one before it."""
    places, full, boundaries = [0], [1024], dict(ends)
    while full or boundaries:
        at = min([*boundaries, *full[:1]])
        if at > total:
            break
        if full and full[0] == at:
            full.pop(0)
        if at in boundaries or at - places[-1] >= packing.NEAR:
            places.append(at)
            full.append(at + 1024)
        boundaries.pop(at, None)
    penalty = dict(ends)
    least = {0: 0}
    for k, j in enumerate(places[1:], 1):
        least[j] = penalty.get(j, packing.TRUNCATED) + min(least[i] + 1024 - j + i for i in places[:k] if i >= j - 1024)
    return least[total]


def test_cuts_by_the_queue_are_least(monkeypatch):
    rng = random.Random(11)
    for case in range(60):
        ends, at = [], 0
        while at < rng.choice([900, 6000, 20_000]):
            at += rng.choice([1, 3, 9, 20, 60, 700, 1024, 5000] if case % 2 else [5, 12, 30])
            ends.append((at, rng.choice([0, 1, 1, 1])))
        ends[-1] = (at, 0)
        cuts, given = packing.WindowCuts(), []
        for k, end in enumerate(ends):
            cuts.add(*end)
            if rng.random() < 0.2:  # whenever it is asked
                given += cuts.settled()
        given += cuts.last()
        penalty = dict(ends)
        assert given[-1] == at and all(0 < b - a <= 1024 for a, b in zip([0, *given], given))
        assert sum(1024 - (b - a) + penalty.get(b, packing.TRUNCATED) for a, b in zip([0, *given], given)) == plain_cuts(ends, at)
        assert len(cuts.place) == 1


def test_sequences_end_at_sentences_and_are_full(spark):
    P = pytest.importorskip("public_tokenizers")
    rng = random.Random(3)
    texts = [" ".join(" ".join(rng.choice(("time", "goes", "on", "and", "still")) for _ in range(rng.randrange(4, 30))) + "." for _ in range(rng.randrange(1, 90))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = str(P.path("byte_bpe_50k.json"))
    for anywhere in (False, True):
        rows = packing.pack(docs, path, anywhere).collect()
        sizes = Counter()
        for r in rows:
            sizes[r.sequence_id] += r.length
        total = sum(sizes.values())
        assert total == sum({r.doc_id: r.doc_tokens for r in rows}.values()) and max(sizes.values()) <= 1024
        if not anywhere:
            assert len(sizes) <= 1.02 * total / 1024 + 1
            from tokenizers import Tokenizer

            tokenizer, cut = Tokenizer.from_file(path), 0
            ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
            for r in rows:
                if r.start + r.length < r.doc_tokens:
                    cut += not tokenizer.decode([ids[r.doc_id][r.start + r.length - 1]]).rstrip().endswith(".")
            assert cut <= 0.1 * len(sizes)


def test_packing_edges(spark):
    P = pytest.importorskip("public_tokenizers")
    path = str(P.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(1, "same text", 5), (1, "same text", 5), (None, None, 5), (2, "", 5), (3, "long text. " * 40_000, 5)], "doc_id long, text string, length long")
    rows = packing.pack(docs, path).collect()
    tokens = Counter()
    for r in rows:
        tokens[r.doc_id] += r.length
    whole = {(r.doc_id, r.doc_tokens) for r in rows}
    n = dict(whole)
    assert len(whole) == 4 and tokens[1] == 2 * n[1] and tokens[None] == n[None] == tokens[2] == n[2] == 1 and tokens[3] == n[3] > 80_000
    assert packing.pack(docs.filter("doc_id > 9"), path).count() == 0


def test_suffix_chat_and_top_k_edges(spark):
    docs = spark.createDataFrame([(1, "é" * 500, "s"), (1, "é" * 500, "s"), (2, None, "s")], "doc_id long, text string, spans string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    none = hashlib.sha256(b"").hexdigest()
    assert got == [(1, 1000, 1000, none), (1, 1000, 1000, none), (2, 0, 0, none)]
    assert suffix_dedup.remove_repeats(docs.filter("doc_id > 9")).count() == 0
    talk = spark.createDataFrame([(1, 0, "user", "hi" * 50_000, "f"), (1, 0, "user", "hi" * 50_000, "f"), (1, None, None, None, "f")], "conv_id long, turn long, role string, text string, formatted string")
    assert [r.n_turns for r in chat.digests(chat.format_conversations(talk)).collect()] == [3]
    assert chat.digests(chat.format_conversations(talk.filter("conv_id > 9"))).count() == 0
    vectors = spark.createDataFrame([(i, [float(i), 1.0], 7, 7.0) for i in range(120)] + [(5, [5.0, 1.0], 7, 7.0)], "vec_id long, embedding array<double>, cell int, score double")
    best = topk.top_k(vectors, vectors.filter("vec_id = 100"), 2).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in best) == [(1, 119, 65536 * (100 * 119 + 1)), (2, 118, 65536 * (100 * 118 + 1))]


def test_suffix_dedup_tells_passages_of_over_50_words(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    some = lambda n: [word() for _ in range(n)]
    a, b, c, d = some(51), some(50), some(60), some(70)
    own = some(55)
    rows = [
        (1, " ".join(some(90) + a + some(30))),  # 51 words of 254 bytes, between other words
        (2, "\n".join(some(7) + a)),  # the same with other white space
        (3, " ".join(some(40) + b)),  # 50 words only
        (4, " ".join(b + some(40))),
        (5, " ".join(own + some(20) + own)),  # within one row only
        (6, " ".join(c)),  # equal rows
        (6, " ".join(c)),
        (7, " ".join(b)),  # equal rows of 50 words
        (7, " ".join(b)),
        (8, " ".join(some(900))),
        (9, None),
        (10, " ".join(d + some(300))),  # 70 words, met twice in one row and once in another
        (11, " ".join(some(100) + d + some(5) + d)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.repeats) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted((i, i in (1, 2, 6, 10, 11)) for i, _ in rows)


def test_join_spread_is_the_plain_join(spark):
    from veridecl.llm.shared import join_spread

    # key 7 holds a third of the rows, null keys meet nothing, repeated rows stay, counts leave some keys out
    rows = spark.createDataFrame([(7, i % 40, f"a{i}") for i in range(500)] + [(i % 97 + 10, i, f"b{i}") for i in range(1000)] + [(None, 1, "c")] + [(8, None, "d")] * 3, "k long, x long, v string")
    few = spark.createDataFrame([(k, f"w{k}") for k in (7, 8, *range(10, 60))], "k long, w string")
    counts = rows.groupBy("k").count().filter("count > 3")
    for how in ("inner", "left"):
        got = join_spread(rows, few, counts, ["k"], "x", how)
        want = rows.join(few, "k", how)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for nothing in (counts.filter("false"), spark.createDataFrame([], counts.schema)):
        assert join_spread(rows, few, nothing, ["k"], "x").count() == rows.join(few, "k").count()
    assert join_spread(rows.filter("false"), few, counts, ["k"], "x").count() == 0
    # the hot key's rows meet theirs in several tasks
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = join_spread(rows, few.hint("merge"), counts, ["k"], "v").filter("k = 7")
        assert met.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
