"""Streams of several batches against brute force: window borders, late and repeated rows, batches that run twice."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veridecl.operators import classify
from veridecl.plans import registry
from veridecl.streaming import keyed, tables

T0 = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
at = lambda seconds: T0 + dt.timedelta(seconds=seconds)


class Feed:
    """A stream of files; each batch of rows is written and run through before the next."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema

    def run(self, batches, build, name):
        """build(stream) to an output table in append mode, or to a started query."""
        out = f"{self.folder}/{name}"
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{out}/in")
            built = build(self.spark.readStream.schema(self.schema).parquet(f"{out}/in"), out)
            if not hasattr(built, "awaitTermination"):
                built = built.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/ck").trigger(availableNow=True).start()
            built.awaitTermination()
        return out


LOGIN = "event_id long, actor_id string, path string, ts timestamp"


def test_login_alerts_over_window_borders_and_late_rows(spark, tmp_path):
    rng = random.Random(3)
    # ten logins over a quarter of an hour's border, then logins at random for three more clients
    rows = [(k, "a", "/api/v1/auth/login", at(600 + 60 * k)) for k in range(10)] + [(50 + k, "edge", "/api/v1/auth/login", at(900 * k // 5)) for k in range(12)]
    rows += [(100 + k, rng.choice("bcd"), rng.choice(["/api/v1/auth/login"] * 3 + ["/health"]), at(rng.randrange(9000))) for k in range(120)]
    rows += [(300 + k, "b", "/api/v1/auth/login", at(5000)) for k in range(7)]  # equal times
    rows.sort(key=lambda r: r[3].timestamp() + rng.randrange(1500))  # up to 25 minutes late
    batches = [rows[i : i + 30] for i in range(0, len(rows), 30)] + [[(900, "z", "/x", at(99_000))], [(901, "a", "/api/v1/auth/login", at(1201)), (902, "z", "/api/v1/auth/login", at(99_001))]]
    out = Feed(spark, tmp_path, LOGIN).run(batches, lambda s, _: keyed.sliding_login_alerts(s, 900, 5, "30 minutes"), "login")
    got = [(r.actor_id, r.event_id, r.ts, r.since) for r in spark.read.parquet(f"{out}/out").select("actor_id", "event_id", F.unix_seconds("ts").alias("ts"), F.unix_seconds("since").alias("since")).collect()]
    want, by = [], {}
    for event, actor, path, ts in rows:
        if path == "/api/v1/auth/login":
            by.setdefault(actor, []).append((int(ts.timestamp()), event))
    for actor, logins in by.items():
        logins.sort()
        want += [(actor, e, t, logins[k - 5][0]) for k, (t, e) in enumerate(logins) if k >= 5 and t - logins[k - 5][0] < 900]
    assert sorted(g[:3] for g in got) == sorted(w[:3] for w in want) and len(want) > 10  # the row behind the watermark (901) brings none
    # since is as known when the alert was given: a login that comes later lies nearer, if at all
    assert all(g[3] <= w[3] and g[2] - g[3] < 900 for g, w in zip(sorted(got), sorted(want)))
    assert [r for r in got if r[0] == "a"][0][2] - int(T0.timestamp()) == 600 + 300


TOKEN = "inspection_id string, seq int, text string, confidence double, n_tokens int, ts timestamp"


def test_labels_are_gathered_over_batches(spark, tmp_path):
    token = lambda i, seq, n, t, text=None: (i, seq, text or f"{i}-{seq}", 0.5, n, at(t))
    batches = [
        [token("a", 2, 3, 0), token("b", 0, None, 5), token("c", 0, 4, 9), token("a", 0, 3, 1), token("e", 1, 2, 3)],
        [token("a", 1, None, 30), token("c", 0, 4, 40, "again"), token("c", 2, 4, 41), token("e", 0, 2, 31), token("e", 0, 2, 31)],
        [token("a", 3, 3, 50), ("d", 0, None, None, 1, at(60))],  # one too many, and one without a text
        [token("x", 0, 1, 5000)],  # moves the watermark on: b and c have waited enough
        [token("c", 3, 4, 42), token("y", 0, 1, 9000)],  # behind the watermark
        [token("c", 9, 1, 9100)],  # heard of again long after: another label
    ]
    out = Feed(spark, tmp_path, TOKEN).run(batches, lambda s, _: keyed.gather_labels(s, wait=600, late="1 minute"), "labels")
    got = Counter(map(tuple, spark.read.parquet(f"{out}/out").collect()))
    whole = lambda i, seqs, complete: [(i, k, f"{i}-{k}", 0.5, complete) for k in seqs]
    want = [*whole("a", (0, 1, 2), True), *whole("e", (0, 1), True), *whole("b", (0,), False), *whole("c", (0, 2), False), ("d", 0, None, None, True), *whole("x", (0,), True), *whole("y", (0,), True), *whole("c", (9,), True)]
    assert got == Counter(want)


def test_labels_share_states(spark, tmp_path):
    # a state, and a call, for each label takes most of the time where labels are many
    n = keyed.GROUPS + 1000
    parts = [spark.range(n).selectExpr("cast(id as string) inspection_id", f"{k} seq", "'x' text", "0.5D confidence", "2 n_tokens", "timestamp '2025-01-01' ts") for k in range(2)]
    for k, rows in enumerate(parts):
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        stream = keyed.gather_labels(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        run.awaitTermination()
        assert 0 < max(o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]) <= keyed.GROUPS
        assert spark.read.parquet(f"{tmp_path}/out").count() == 2 * n * k
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.filter("complete").distinct().count() == 2 * n


UPLOAD = "content_hash string, id long, uploaded_at timestamp"


def test_ledger_knows_contents_for_ever(spark, tmp_path):
    day = 86400
    batches = [
        [("h1", 3, at(10)), ("h1", 2, at(10)), ("h2", 4, at(9)), (None, 5, at(1))],
        [("h2", 6, at(day)), ("h3", 7, at(day + 5)), ("h3", 8, at(day + 4))],
        [("h1", 9, at(40 * day)), ("h4", 10, at(40 * day))],  # long after any watermark
    ]
    out = Feed(spark, tmp_path, UPLOAD).run(batches, lambda s, o: tables.stream_ledger(s, f"{o}/ledger", f"{o}/ck"), "uploads")
    want = [("h1", 2), ("h2", 4), ("h3", 8), ("h4", 10)]
    known = lambda: sorted((r.content_hash, r.id) for r in tables.read_ledger(spark, f"{out}/ledger").filter("content_hash is not null").collect())
    assert known() == want
    # a batch that runs again gives the same
    again = spark.createDataFrame(batches[1], UPLOAD)
    tables.note_new_contents(again, 1, f"{out}/ledger")
    assert known() == want
    assert tables.read_ledger(spark, str(tmp_path / "none")).count() == 0


def test_ledger_query_takes_the_smallest_id(spark, tmp_path):
    # more documents a batch than a day has seconds, equal texts either side of such a border, and texts that are null
    text = F.when(F.col("id").isin(5, 86401 * 2, 86401 * 3 + 1), F.lit(None)).when(F.col("id") % 86400 == 7, "same").otherwise(F.concat(F.lit("t"), F.when(F.col("id").isin(500, 86400 + 3), 0).otherwise(F.col("id"))))
    spark.range(86401 * 4).select(F.col("id").alias("doc_id"), text.cast("string").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["l10_upload_ledger"](spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("id"))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


SEEN = "created_at timestamp, overall_status string"


def test_rollup_over_batches_and_late_rows(spark, tmp_path):
    day = 86400
    rng = random.Random(2)
    batches = [[(at(d * day + rng.randrange(day)), rng.choice("AB")) for _ in range(40)] for d in range(4)]
    batches[2] += [(at(1 * day + 9), "A")] * 3  # late, but the day is still open
    batches.append([(at(5), "A"), (at(9 * day), "B"), (at(2), None)])  # those of the first day come too late
    out = Feed(spark, tmp_path, SEEN).run(batches, lambda s, o: tables.stream_rollup_upserts(s, f"{o}/roll", f"{o}/ck", "1 day"), "seen")
    want = Counter(((t - T0).days, s) for b in batches for t, s in b if t > at(9) or b is batches[0])
    said = lambda rows: Counter({((r.day.replace(tzinfo=dt.timezone.utc) - T0).days, r.overall_status): r.n for r in rows.collect()})
    assert said(tables.read_rollup(spark, f"{out}/roll")) == want
    tables.compact_rollup(spark, f"{out}/roll", f"{out}/small")
    small = tables.read_rollup(spark, f"{out}/small")
    assert said(small) == want and spark.read.parquet(f"{out}/small").count() == len(want)
    parts = [r.batch for r in spark.read.parquet(f"{out}/roll").select("batch").distinct().collect()]
    assert len(parts) > 3


NAMES = {
    "oils": ["Sunflower Refined Oil", "Mustard Oil Pressed", "Groundnut Oil Filtered", "Refined Palm Oil", "Rice Bran Oil", "Olive Oil Virgin", "Sesame Oil Cold Pressed", "Coconut Oil Pure"],
    "soap": ["Neem Soap Bar", "Rose Soap Floral", "Glycerine Soap Clear", "Herbal Soap Bath", "Milk Soap Soft", "Sandal Soap Gold", "Lime Soap Fresh", "Aloe Soap Gentle"],
    "tea": ["Green Tea Leaves", "Assam Tea Strong", "Masala Tea Mix", "Lemon Tea Bags", "Ginger Tea Dust", "Black Tea Premium", "Darjeeling Tea First", "Tulsi Tea Herbal"],
}


def test_classifier_scores_against_a_loop_and_holds_out(spark, tmp_path):
    import math

    rows = [(f"{n} {i % 3}", label) for label, names in NAMES.items() for i, n in enumerate(names)]
    held = [r for i, r in enumerate(rows) if i % 4 == 0]
    train = spark.createDataFrame([r for i, r in enumerate(rows) if i % 4] + [("unlabelled", None), (None, "tea")], "text string, label string")
    model = classify.train_classifier(train, vocabulary=400)
    model.save(spark, str(tmp_path / "m"))
    again = classify.load_model(spark, str(tmp_path / "m"))
    assert again == model and len(model.grams) == 400 and model.labels == ["oils", "soap", "tea"]
    # the model's grams and idf are those of the features
    known = train.filter("label is not null").select(F.monotonically_increasing_id().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    idf = {r.gram: r.idf for r in classify.known_grams(known, classify.gram_counts(known), 400).collect()}
    assert {g: i for g, i, _ in model.grams} == pytest.approx(idf)
    texts = [(i, t, "x", 1.0) for i, (t, _) in enumerate(held)] + [(90, "", "x", 1.0), (91, None, "x", 1.0), (92, "∅∅∅", "x", 1.0), (93, "Tea " * 2000, "x", 1.0)]
    rows = spark.createDataFrame(texts, "id long, text string, gram string, n double")
    got = {r.id: r for r in classify.classify(rows, again).collect()}
    assert classify.classify(rows, again).columns == ["id", "text", "gram", "n", "label", "confidence"]
    table = {g: (i, w) for g, i, w in model.grams}
    for i, text, *_ in texts:
        if not (text or "").strip():
            assert (got[i].label, got[i].confidence) == ("other_uncategorized", 0.0)
            continue
        counts = Counter()
        for word in text.lower().split():
            word = f" {word} "
            for n in (2, 3, 4):
                counts.update({word[:n]: 1} if len(word) <= n else Counter(word[k : k + n] for k in range(len(word) - n + 1)))
                if len(word) <= n:
                    break
        x = {g: (1 + math.log(c)) * table[g][0] for g, c in counts.items() if g in table}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
        z = [sum(v * table[g][1][k] for g, v in x.items()) / norm + b for k, b in enumerate(model.intercepts)]
        p = [math.exp(v - max(z)) for v in z]
        assert got[i].label == model.labels[z.index(max(z))] and got[i].confidence == pytest.approx(max(p) / sum(p))
    right = sum(got[i].label == label for i, (_, label) in enumerate(held))
    assert right >= 5  # of six that it was not trained on
    one = classify.train_classifier(train.filter("label = 'tea'"))
    assert {r.label for r in classify.classify(rows.filter("id < 5"), one).collect()} == {"tea"}
    none = classify.train_classifier(train.filter("label = 'no'"))
    assert classify.classify(rows, none).filter("confidence > 0").count() == 0
