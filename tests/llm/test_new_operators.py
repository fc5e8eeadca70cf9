"""Sharding, spelling variants and periodic runs against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veridecl.llm import periodic, sharding, variants


def published_jump(key, n):
    """The published function, with 64-bit arithmetic."""
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 16, 500])
def test_jump_as_published(spark, n):
    rng = random.Random(n)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(rng.getrandbits(64) - 2**63 for _ in range(400))]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump(F.col("k"), n).alias("j")).collect()
    assert all((r.j.shard, r.j.grown_shard) == (published_jump(r.k, n), published_jump(r.k, n + 1)) for r in got)


def test_walks_longer_than_usual_go_on(spark, monkeypatch):
    """With a first walk that is too short for most keys, all still get their exact shard."""
    monkeypatch.setattr(sharding.math, "log", lambda x: -1.75)  # one step
    rng = random.Random(3)
    keys = [rng.getrandbits(64) - 2**63 for _ in range(200)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump(F.col("k"), 40).alias("j")).collect()
    assert all(r.j.shard == published_jump(r.k, 40) and r.j.grown_shard == published_jump(r.k, 41) for r in got)


def test_places(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "CHUNK", 3)
    rng = random.Random(4)
    rows = [(i, "é" * rng.randrange(9), "a") for i in range(300)] + [(7, "same", "b")] * 40 + [(None, None, "c")] * 25 + [(8, f"t{i % 5}", "d") for i in range(20)] + [(9, "x" * 300_000, "e"), (10, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.place(docs.repartition(5)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want and {r.law for r in got} == {"key"}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(slots) == 16 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.grown_shard in (r.shard, 16) for r in got) and 5 < sum(r.grown_shard == 16 for r in {r.doc_id: r for r in got}.values()) < 40
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    again = sharding.place(docs.repartition(2, "text")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))  # whatever the partitions
    more = {r.doc_id: r.shard for r in sharding.place(docs, 17).collect()}
    assert all(more[r.doc_id] == r.grown_shard for r in got)
    assert sharding.place(docs.filter("doc_id > 10000")).count() == 0
    plain = docs.drop("shard")
    with pytest.raises(ValueError):
        sharding.with_shard(docs, 4, "doc_id")
    sharding.write_shards(plain, str(tmp_path / "s"), 4, parts=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r.doc_id, r.text, r.shard) for r in back.collect()) == Counter((i, t, s.shard) for (i, t, _), s in zip(rows, sharding.with_shard(plain, 4, "doc_id").collect()))
    assert all(r.shard != 4 for r in sharding.moving(plain, 4).collect()) and sharding.moving(plain, 4).count() == sum(r.grown_shard == 4 for r in sharding.with_shard(plain, 4, "doc_id").collect())


def variant_rows(rows, drop=True):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    counts = Counter()
    for doc_id, text in rows:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(m[0])
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if drop and doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        others = [x for x in words if x != w and near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
        out[w] = (len(others), form[w], words.get(form[w]))
    rows = set()
    for w, (k, f, fn) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, f, root, words[w], k, fn))
    return rows


def wordy(rng):
    base = ["repeated", "repeatted", "wording", "wordings", "aaaaaaa", "aaaaaaaa", "aaabaaa", "éclairer", "Éclairer", "verdicts", "verdict", "x" * 4000]
    typos = []
    for w in base:
        for _ in range(6):
            k, c = rng.randrange(len(w)), rng.choice("abté÷")
            typos += [w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]]
    rows = []
    for i in range(300):
        some = [rng.choice(base) for _ in range(rng.randrange(30))] + [rng.choice(typos) for _ in range(rng.randrange(3))]
        rng.shuffle(some)
        rows.append((i, rng.choice([" ", ", ", "9", "\n"]).join(some)))
    return [*rows, (None, "wordings wordings wordingz wordingz"), (5, None), (6, ""), (7, "short words"), *[(1000, "hotword " * 900 + "hotwords hotwords hotwordy")] * 3, (1001, "hotwords " * 260 + "hotwordsy " * 25 + "hotwordsyy " * 2)]


def test_spelling_variants(spark):
    rows = wordy(random.Random(2))
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(6)
    for drop in (True, False):
        want = variant_rows(rows, drop)
        got = variants.spelling_variants(docs, drop).collect()
        assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
        assert len({r.form for r in got}) > 5 and (drop or any(r.root != (r.form or r.word) for r in got))
    assert variants.spelling_variants(docs.filter("doc_id < 0")).count() == 0
    assert variants.spelling_variants(docs.filter("text = 'short words'")).count() == 0


def test_trie_numbers_over_ranges():
    """Nodes get the same number in every range, and unlike nodes unlike ones, wherever the ranges are cut."""
    rng = random.Random(8)
    for _ in range(200):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(40)})
        cuts = sorted({0, *(rng.randrange(len(words)) for _ in range(rng.randrange(6)))})
        trie, of = variants.TrieNumbers([words[c] for c in cuts]), {}
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(words)])):
            trie.begin(k, (k + 1) << 40)
            for w in words[a:b]:
                for d, node in enumerate(trie.nodes(w)):
                    assert of.setdefault(w[:d], node) == node
        assert len(set(of.values())) == len(of)


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if length >= max(24, 3 * q) and not any(all(w[s + k] == w[s + k + d] for k in range(length - d)) for d in range(1, q)):
                out.append((s, length, q))
    return sorted(out)


def repeating(rng):
    k = rng.choice([1, 2, 3, 12])
    word = lambda: f"w{rng.randrange(k)}" if rng.random() < 0.9 else "é,"
    words = [word() for _ in range(rng.randrange(30))]
    for _ in range(rng.randrange(4)):
        unit = [word() for _ in range(rng.randrange(1, 14))]
        words += (unit * 60)[: rng.randrange(70)] + [word() for _ in range(rng.randrange(3))]
    return words


def test_runs_of_words_against_all_periods():
    rng = random.Random(1)
    found = 0
    for _ in range(1500):
        words = repeating(rng)
        want = brute_runs(words)
        found += len(want)
        assert periodic.three_fold_runs([hash(w) for w in words]) == want
        assert periodic.document_runs([w.encode() for w in words]) == want
    assert found > 500


def test_periodic_runs(spark):
    rng = random.Random(9)
    texts = ["".join(w + rng.choice([" ", "\n", "\t \x0b"]) for w in repeating(rng)) for _ in range(120)]
    texts += [" ".join(f"u{rng.randrange(400)}" for _ in range(300)) for _ in range(40)] + ["a " * 50_000, None, "", " \r\n", "a\xa0b\x1cc " * 30]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(3, texts[3], 1, "x")] * 2 + [(None, texts[5], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, collapsed string")
    got = periodic.periodic_runs(docs, plant=True, collapsed=True).collect()

    def one(doc_id, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = [(0, n, 1)] if n == 50_000 else brute_runs(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return (doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(left), n, n - len(gone), left)

    assert Counter(map(tuple, got)) == Counter(one(i, t) for i, t, *_ in rows)
    assert sum(r.n_runs > 0 for r in got) > 60
    assert periodic.periodic_runs(docs.filter("doc_id < 0")).count() == 0
