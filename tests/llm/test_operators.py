"""Each operator against brute force, on texts with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veridecl.llm import chat, decontaminate, near_dedup, packing, secrets, substring_dedup, suffix_dedup, template, topk, toxicity, url_filter

WORDS = [a + b for a in ("ta", "re", "mi", "so", "é", "ü") for b in ("n", "l", "rk", "sh", "d", "x")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = [prose(rng, 150) for _ in range(6)]
    texts = [None, "", " \n\t ", "one", "two words", "x" * 900, "ab" * 700, "naïve <b>|x|</b> [INST] \\ </s>"]
    for b in base:
        texts += [b, b, b.upper()]
        for k in (1, 4, 12):
            w = b.split(" ")
            for _ in range(k):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
            texts.append(" ".join(w))
        texts.append(prose(rng, 40) + " " + " ".join(b.split(" ")[30:120]) + "\n" + prose(rng, 30))
    texts += [prose(rng, 60) for _ in range(10)] + [prose(rng, 9000)]
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, component_id string, spans string, n_chars long")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_near_duplicates(spark, docs):
    rows = corpus()

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()

    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_duplicates(docs, shingle=3, percent=85).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 4, None, True), (1, 4, 1, True), (1, 4, 1, True), (2, 0, 2, True)], key=repr)
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_dedup(spark, docs):
    rows = [(r[0], (r[1] or "").encode()) for r in corpus()]
    count = Counter(b[p : p + 400] for _, b in rows for p in range(len(b) - 399))
    want = {}
    for i, b in rows:
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                cover[p : p + 400] = True
        left = bytes(np.frombuffer(b, np.uint8)[~cover]) if b else b""
        want[i] = (len(b), int(cover.sum()), int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest())
    for hot in (suffix_dedup.HOT, 1):
        keep, suffix_dedup.HOT = suffix_dedup.HOT, hot
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
        suffix_dedup.HOT = keep
        assert got == want


def test_multikey_sort():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(30))) for _ in range(300)]
    order, common = suffix_dedup.multikey_sort(strings)
    ranked = [strings[i] for i in order]
    assert ranked == sorted(strings)
    for a, b, n in zip(ranked, ranked[1:], common[1:]):
        assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_substring_dedup(spark, docs):
    rows = corpus()
    seen = defaultdict(set)
    for r in rows:
        w = lower(r[1]).split()
        for p in range(len(w) - 50):
            seen[tuple(w[p : p + 51])].add(r[0])
    need = {i for ids in seen.values() if len(ids) > 1 for i in ids}
    got = {r["doc_id"] for r in substring_dedup.repeat_report(docs).collect()}
    fresh = {r[0] for r in rows[-11:]}
    assert need <= got and not got & fresh
    assert substring_dedup.repeat_report(docs.filter("doc_id < 0")).count() == 0


def test_substring_dedup_removes_by_byte(spark):
    """A document that stays as the first of its near copies still loses what an earlier document holds."""
    rng = random.Random(8)
    boiler, own = prose(rng, 80), prose(rng, 400)
    rows = [(1, prose(rng, 60) + " " + boiler + " " + prose(rng, 60)), (2, own + " " + boiler + " " + prose(rng, 300))]
    rows.append((3, rows[1][1] + " last"))
    got = {r["doc_id"]: r for r in substring_dedup.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed_bytes"] == 0
    assert len(boiler.encode()) * 3 // 10 < got[2]["n_removed_bytes"] <= len(boiler.encode())
    assert got[3]["n_removed_bytes"] == got[3]["n_bytes"] > 0.99 * len(rows[2][1].encode())


def test_substring_dedup_compares_each_paragraph_once(spark, monkeypatch):
    rng = random.Random(9)
    line = prose(rng, 40)
    rows = [(i, prose(rng, 30) + "\n" + (line.replace(" ", "  ") if i % 2 else line)) for i in range(8)] + [(8, line + " last")]
    docs, fed = spark.createDataFrame(rows, "doc_id long, text string"), []
    groups = substring_dedup.linked_groups
    monkeypatch.setattr(substring_dedup, "linked_groups", lambda profile, texts_of, **options: fed.append(texts_of(profile.select("doc_id").distinct())) or groups(profile, texts_of, **options))
    got = [r for r in substring_dedup.repeated_passages(docs).filter("kind = 'paragraph'").collect()]
    assert sorted(r["doc_id"] for r in got) == list(range(9)) and {r["keeper"] for r in got} == {0}
    assert fed[0].count() == fed[0].select("doc_id").distinct().count() == 10


def test_decontaminate(spark, docs, monkeypatch):
    texts = {r[0]: r[1] for r in corpus()}
    items = [(1, " ".join(texts[8].split(" ")[10:40])), (2, "two words"), (3, None), (4, "..."), (5, texts[40] or "x"), (5, texts[40] or "x"), (None, "one")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    want = {}
    for i, t in texts.items():
        w, hit, found = words(t), set(), set()
        for key, ids in windows.items():
            for p in range(len(w) - len(key) + 1):
                if tuple(w[p : p + len(key)]) == key:
                    hit |= set(range(p, p + len(key)))
                    found |= {str(x) for x in ids if x is not None}
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bits in (decontaminate.FILTER_BITS, 3):  # a filter that passes nearly all changes nothing
        monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
        got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination(docs, bench).collect()}
        assert got == want
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1)]) for i in range(300)] + [(1000 + i, [0.5] * 8) for i in range(40)]
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 6), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [1e6] * 8), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()))
    whole = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in whole:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.filter("vec_id < 0"), df).count() == 0


def test_secrets(spark):
    key = "AKIA" + "Q" * 16
    texts = [None, "", "password=token=abcdefghijklmnop", "secret=token: abcdefghijklmnop", f"API-key apikey = 'abcdefghijkl' {key} é {key}", "deadbeefdeadbeef0 x", "access_id: short1 and wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY alone", "see https://example.com/x alone"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    patterns = [("assign", secrets.BASE["assign"][0], lambda m: len(m[2]) >= 12), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16)]
    got = {r["doc_id"]: r for r in secrets.scan(rows).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(patterns) for m in re.finditer(p, t or "") if ok(m))
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest()
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(s[1] == k for s in spans) for k in range(3))
    assert got[6]["n_linked"] == 2 and got[7]["n_linked"] == got[8]["n_linked"] == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(rows).collect()}
    assert clean[5] == "[secret]0 x" or "deadbeef" not in clean[5]
    assert key not in clean[4] and clean[0] is None and clean[8] == texts[8]


def test_secrets_links_wherever_the_text_stands(spark):
    """Pairs of parts at many offsets, lengths and gaps against every pair of parts."""

    def place(length):
        return "http://" + "z" * (length - 7)

    rows = []
    for shift in (0, 1, 150, 259, 299, 300, 301, 560):
        for length in (40, 299, 300, 301, 650, 1500):
            for gap in (1, 290, 299, 300, 301, 320):
                ident = "AKIA" + "B" * 14
                rows.append("\n" * shift + place(length) + " " * gap + ident)
                rows.append("\n" * shift + ident + " " * gap + place(length))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    for doc, text in enumerate(rows):
        parts = [(m.start(), m.end(), k) for k, p in (("access", r"AKIA[A-Z0-9]{14,}"), ("key_id", r"\bAKIA[A-Za-z0-9_-]{4,}"), ("endpoint", r"http://z+")) for m in re.finditer(p, text)]
        apart = lambda a, b: max(a[0], b[0]) - min(a[1], b[1])
        linked = [p for p in parts if p[2] == "endpoint" and any(q[2] != "endpoint" and 0 <= apart(p, q) <= 300 for q in parts)]
        linked += [p for p in parts if p[2] == "access"]
        assert got[doc] == ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(linked)), (doc, text.strip()[:10])


def test_url_filter(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/x?q=1", "http://example.net/de/1", "http://net/", "http://net", "http://sub.example.com/de/5#x", "http://x.org/fr/2", "http://x.org?p=/fr/", "https://bad.host.io/spam/12", "https://bad.host.io/spam/13"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(100 + i, f"https://bad.host.io/spam/{i}", "") for i in range(40)] + [(200 + i, f"https://good.io/{i}", "") for i in range(40)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(100 + i, 0, 0) for i in range(40)] + [(200 + i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, labels).collect()}
    assert [got[i] for i in range(11)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/de/1", "net/", "block"), ("net", "/", "net/", "block"), ("net", "", None, "allow"),
        ("sub.example.com", "/de/5", "example.com/de/", "block"), ("x.org", "/fr/2", "org/fr/", "allow"), ("x.org", "", None, "allow"), ("bad.host.io", "/spam/12", None, "block"), ("bad.host.io", "/spam/13", None, "block"),
    ]
    none = url_filter.filter_urls(pages, labels.filter("doc_id < 0"))
    assert none.filter("verdict = 'block' and rule is null").count() == 0


def test_url_filter_keeps_long_rules(spark):
    """Five tokens that block only together: each four of them come with more good pages than bad ones."""
    names = "abcde"
    good = [f"https://h.io/{'/'.join(n for n in names if n != left)}" for left in names for _ in range(30)]
    urls = ["https://h.io/a/b/c/d/e"] * 40 + good
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 40), 0) for i in range(len(urls))], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["verdict"], r["mined"]) for r in url_filter.filter_urls(pages, labels).collect()}
    assert [got[i] for i in range(len(urls))] == [("block", "p:a&p:b&p:c&p:d&p:e")] * 40 + [("allow", None)] * len(good)


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (5, None, None, None), (5, 1, "assistant", "a\\0<|x|>\n</s>"), (5, 1, "assistant", "a\\0<|x|>\n</s>"), (5, 2, "user|>", "é"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    for conv, turns in ((-1, rows[:2]), (5, rows[2:6]), (None, rows[6:])):
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] for r in turns if r[2] == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and got[conv]["n_turns"] == len(turns)
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[conv]["loss_chars"] == len(loss)


def test_template_language():
    render = template.compile_template("{% if 'a' == 'a' %}x{{ 'b' + 'c' }}{% else %}y{% endif %}{% for m in messages %}{{ loop.index }}{% if loop.last %}!{% elif m.role != 'u' %}?{% endif %}{% generation %}{{ m.text|up }}{% endgeneration %}{% endfor %}", {"up": str.upper})
    assert list(render([{"role": "u", "text": "q"}, {"role": "v", "text": "r"}])) == [("xbc", False), ("1", False), ("Q", True), ("2", False), ("!", False), ("R", True)]
    for bad in ("{{ a b }}", "{% for x in %}{% endfor %}", "{% if a %}", "{{ x|nothing }}", "{% import os %}", "{{ a[0] }}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(bad, {})
    assert "".join(t for t, _ in template.compile_template("{{ m.__class__.x }}", {})([])) == ""


def test_packing(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    rows = [(r[0], r[1]) for r in corpus()] + [(900, "a<|endoftext|>b")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), str(P.path("byte_bpe_50k.json"))).toPandas()
    groups = dict(list(out.sort_values("start").groupby("doc_id")))
    for i, t in rows:
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for p in groups[i].itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    sizes = out.groupby("sequence_id")["length"].sum()
    assert sizes.max() <= 1024 and sum(packing.padding(int(n)) for n in sizes) < 0.02 * sizes.sum() + 4 * 1024
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]]


def test_best_cuts_is_least():
    rng = random.Random(2)
    for _ in range(20):
        at, places = 0, []
        while at < 5000:
            at += rng.randrange(1, 700)
            places.append((at, rng.choice([0, 1])))
        total = at
        ends = packing.best_cuts(places, total)
        penalty = dict(places)
        cost = sum(packing.padding(b - a) + (0 if b == total else penalty.get(b, packing.ANYWHERE)) for a, b in zip([0, *ends], ends))
        assert all(0 < b - a <= 1024 for a, b in zip([0, *ends], ends)) and ends[-1] == total
        plain = -(-total // 1024) * 1024 - total + packing.ANYWHERE * (total // 1024)
        assert cost <= plain


def test_best_cuts_against_every_window():
    rng = random.Random(3)
    for widest in (1, 3, 12, 40, 700):
        for total in (1, 2, 700, 1024, 1025, 2600, 4100):
            places, at = [], 0
            while at < total:
                at += rng.randrange(1, widest + 1)
                places.append((at, rng.choice([0, 1, 1, 1])))
            penalty = np.full(total + 1, packing.ANYWHERE)
            for p, extra in places:
                if p < total:
                    penalty[p] = extra
            penalty[total] = 0
            pads = np.array([packing.padding(n) for n in range(1024, 0, -1)])
            least = np.zeros(total + 1, np.int64)
            for j in range(1, total + 1):
                n = min(j, 1024)
                least[j] = penalty[j] + (least[j - n : j] + pads[1024 - n :]).min()
            ends = packing.best_cuts(places, total)
            assert ends[-1] == total and all(0 < b - a <= 1024 for a, b in zip([0, *ends], ends))
            assert sum(packing.padding(b - a) + penalty[b] for a, b in zip([0, *ends], ends)) == least[total]


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad, low = i % 5 == 0, i % 7 == 0
        rows.append((i, prose(rng, 40) + (" vile slur " if bad else "") + (" junk buy " if low else ""), 0.0))
        labels.append((i, int(not low), int(bad)))
    rows += [(1000, None, 0.0), (1001, "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic double").drop("p_toxic")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, known.filter("doc_id < 250")).collect()}
    held = [(got[i], bool(t)) for i, _, t in labels if i >= 250]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and not got[1000] and len(got) == 402
    assert toxicity.toxicity(docs, known.filter("doc_id < 0")).filter("toxic").count() == 0
    assert toxicity.drop_toxic(docs, known).columns == docs.columns
