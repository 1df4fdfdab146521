"""Language, quality, mixing, sharding and secrets against plain versions and odd rows."""

import hashlib
import itertools
import math
import random
import struct
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, ngrams, quality, secret_scan, sharding
from tessera.llm.common import materialize

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- language


def spoken(draw, syllables, n):
    return " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 3))) for _ in range(n))


TONGUES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["schl", "ung", "keit", "ver"], "cc": ["ção", "ñe", "ll", "qui"]}


def test_language_held_out_accuracy_and_rejection(spark):
    draw = random.Random(1)
    rows = [(i, spoken(draw, TONGUES[lang], draw.randint(3, 60)), lang) for i, lang in enumerate(itertools.islice(itertools.cycle(TONGUES), 450))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == sorted(TONGUES)
    out = langid.predict(docs.withColumn("held", langid.held_out(docs["doc_id"])), model).collect()
    held = [r for r in out if r["held"]]
    assert len(held) > 40 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert sum(r["rejected"] for r in out) <= 4
    strange = spark.createDataFrame([(1, "Привет мир, как дела сегодня у вас"), (2, "12 345 --"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(strange, model).collect()}
    assert all(r["rejected"] for r in got.values())
    assert [got[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and got[2]["score"] == 0


def test_language_over_odd_rows(spark, edge, edge_rows, empty):
    model = langid.fit(edge)
    out = langid.predict(edge, model)
    assert out.count() == len(edge_rows) and set(edge.columns) - {"score"} <= set(out.columns)
    assert langid.accepted(edge, model).columns == edge.columns
    nothing = langid.fit(empty)
    assert nothing.languages == [] and langid.predict(empty, nothing).count() == 0
    assert {r["lang_pred"] for r in langid.predict(edge, nothing).collect()} == {"und"}


def test_language_score_does_not_depend_on_neighbours():
    draw = random.Random(2)
    texts = [spoken(draw, TONGUES[x], 20) for x in ("aa", "bb", "cc") * 20]
    model = langid.train(texts, ["aa", "bb", "cc"] * 20)
    together, _ = model.scores(*langid._framed(texts))
    alone = np.concatenate([model.scores(*langid._framed([t]))[0] for t in texts])
    assert (together == alone).all()


def test_language_scores_are_those_of_a_plain_forward_pass():
    draw = random.Random(9)
    tongues = {f"l{i:02}": ["".join(draw.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(4)] for i in range(20)}
    for names in (sorted(tongues)[:3], sorted(tongues)):  # a table of languages, and one of dimensions
        langs = [draw.choice(names) for _ in range(40)] + names * 2
        texts = [spoken(draw, tongues[x], draw.randint(0, 12)) for x in langs]
        model = langid.train(texts, langs)
        assert (model.layer is None) == (len(names) <= langid.DIM)
        got, known = model.scores(*langid._framed(texts))
        for i, text in enumerate(texts):
            data = bytes(c | 32 if 65 <= c <= 90 else c for c in f" {text} ".encode())
            data = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in data)
            buckets = []
            for n in langid.GRAMS:
                for k in range(len(data) - n + 1):
                    value = int.from_bytes(data[k : k + n], "big") * int(ngrams._FACTORS[n]) % 2**32
                    value = (value ^ value >> 15) * int(ngrams._FACTORS[0]) % 2**32
                    buckets.append(value >> 32 - langid.BITS)
            mean = [math.fsum(float(row[b]) for b in buckets) / max(1, len(buckets)) for row in model.table]
            logits = mean if model.layer is None else [math.fsum(m * w for m, w in zip(mean, column)) for column in model.layer.T]
            raised = [math.exp((x + y) / model.temperature) for x, y in zip(logits, model.bias)]
            assert got[i] == pytest.approx([x / sum(raised) for x in raised], rel=2e-4)
            assert known[i] == pytest.approx(sum(model.known[b] for b in buckets) / max(1, len(buckets)), rel=1e-4)


# --- quality


def labelled(n=200):
    draw = random.Random(10)
    texts = [spoken(draw, ["the", "an", "er", "ing", "ou"], draw.randint(1, 80)) for _ in range(n)]
    texts = [t.upper() if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts[5], texts[8] = texts[2], texts[2]  # equal vectors with different labels
    return texts, [int(i % 3 > 0) for i in range(n)]


def test_quality_scores_are_those_of_a_plain_vote():
    texts, labels = labelled()
    model = quality.train(texts, labels, 0.6)
    raw = [t.encode() for t in [*texts, "", "one", texts[2]]]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    got = model.scores(np.frombuffer(b"".join(raw), np.uint8), offsets)
    vectors = [[int(x) for x in v] for v in model.vectors]
    for i, text in enumerate(raw):
        mine = [int(x) for x in model.project(*quality.terms(np.frombuffer(text, np.uint8), np.array([0, len(text)])))[0]]
        near = sorted((-sum(x * y for x, y in zip(mine, v)), k) for k, v in enumerate(vectors))[: quality.NEIGHBOURS]
        votes = [(max(0, -d) / quality._STEPS**2) ** quality.SHARPNESS for d, _ in near]
        want = sum(w * labels[k] for w, (_, k) in zip(votes, near)) / sum(votes) if sum(votes) > 1e-9 else 0.6
        assert got[i] == pytest.approx(want, rel=1e-12), i
    assert got[-1] == got[2]


def test_quality_score_does_not_depend_on_neighbours():
    texts, labels = labelled()
    model = quality.train(texts, labels, 0.6)
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    together = model.scores(np.frombuffer(b"".join(raw), np.uint8), offsets)
    alone = [model.scores(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in raw]
    assert (together == np.array(alone)).all()


def test_of_equally_near_the_first_votes():
    similar = np.array([[1.0, 3, 2, 2, 2, 0], [5, 5, 5, 5, 5, 5], [0, 1, 2, 3, 4, 5]])
    assert quality.nearest(similar, 3).tolist() == [[1, 2, 3], [0, 1, 2], [3, 4, 5]]
    draw = random.Random(4)
    rows = np.array([[float(draw.randrange(6)) for _ in range(40)] for _ in range(60)])
    for k in (1, 7, 40):
        assert quality.nearest(rows, k).tolist() == [sorted(sorted(range(40), key=lambda i: (-r[i], i))[:k]) for r in rows]


def test_quality_held_out_accuracy(spark):
    draw = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        text = spoken(draw, ["the", "an", "er", "ing", "ou", "st", "re"], draw.randint(10, 200))
        bad = i % 4 == 0
        if bad:
            text = draw.choice([text.upper().replace(" ", "!! "), " | ".join(text.split()), " ".join(w for w in text.split()[:9] for _ in range(12))])
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample, prior = quality.training_rows(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert 0.7 < prior < 0.8 and not {zlib.crc32(str(i).encode()) % 5 for i, t in rows if (t, labels[i][1]) in set(sample)} - {1, 2, 3, 4}
    model = quality.train([t for t, _ in sample], [y for _, y in sample], prior)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_quality_over_odd_rows(spark, edge, edge_rows, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (9, None), (None, 1), (1, 1)], "doc_id long, quality int")
    sample, prior = quality.training_rows(edge, labels)
    model = quality.train([t for t, _ in sample], [y for _, y in sample], prior)
    out = quality.score(edge, model).collect()
    assert len(out) == len(edge_rows) and all(r["score"] == prior for r in out if not r["text"])
    none, half = quality.training_rows(empty, labels.limit(0))
    assert none == [] and half == 0.5
    assert quality.score(empty, quality.train([], [], half)).count() == 0
    assert {r["score"] for r in quality.score(edge, quality.train([], [], half)).collect()} == {0.5}


# --- mixing


def highest_quotients(votes, seats, caps):
    got = [0] * len(votes)
    while seats and any(g < c for g, c in zip(got, caps)):
        best = max((i for i in range(len(votes)) if got[i] < caps[i]), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[best] += 1
        seats -= 1
    return got


def test_sainte_lague_gives_the_highest_quotients():
    draw = random.Random(4)
    for _ in range(200):
        votes = [draw.choice([draw.random() * 100, float(draw.randint(1, 5)), 50.0]) for _ in range(draw.randint(1, 7))]
        caps = [draw.randint(0, 40) for _ in votes]
        seats = draw.randint(0, 120)
        assert list(mixing.sainte_lague(np.array(votes), seats, np.array(caps))) == highest_quotients(votes, min(seats, sum(caps)), caps)
    assert list(mixing.sainte_lague(np.zeros(0), 5, np.zeros(0))) == []
    assert list(mixing.sainte_lague(np.array([0.0, 1.0]), 5, np.array([9, 9]))) == [0, 5]


def test_targets_stop_at_twice_the_size_and_reshare_the_excess():
    assert mixing.capped_targets([10, 1000, 1000], [5, 2, 1]) == pytest.approx([20, 1996.6666667, 998.3333333])
    assert mixing.capped_targets([0, 0], [5, 2]) == [0, 0] and mixing.capped_targets([], []) == []


def test_mix_comes_near_its_targets_and_documents_match_the_plan(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 40)
    draw = random.Random(5)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(draw.choice([1, 30, 90]))), f"s{i % 4}" if i % 7 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r["doc_id"]: r for r in mixing.mix_plan(docs, mixing.contract_weight).collect()}
    by = Counter()
    for r in plan.values():
        by[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for r in plan.values():
        assert abs(by[r["source"]] - r["target"]) <= max(0.02 * r["target"], 3 * mixing.BLOCK)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(docs.repartition(3), mixing.contract_weight).collect()}
    assert again == {i: r["taken"] for i, r in plan.items()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = Counter()
    source = dict((i, t.split()) for i, t, _ in rows)
    for r in out.collect():
        words = r["text"].split()
        taken[r["doc_id"]] += len(words)
        assert set(words) <= set(source[r["doc_id"]])
    assert taken == {i: r["taken"] for i, r in plan.items() if r["taken"]}


def spark_hash(seed, *values):
    """The engine's 64-bit hash of longs, strings and a leading int, as a signed number."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=42)
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=h)
    return h - 2**64 if h >= 2**63 else h


def plain_mix(rows, shard_rows, share=1.5, words=False):
    """What the mix takes of each row (id, text, source), one word after the other; ``words``: of each
    of its words."""
    sizes = [len(WORDS.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    totals = [sum(n for n, r in zip(sizes, rows) if r[2] == s) for s in names]
    targets = mixing.capped_targets(totals, [(5, 2, 1)[i % 3] for i in range(len(names))], share)
    block = max(1, min([16, *(int(t // 50) for t in targets if t > 0)]))
    blocks = [-(-n // block) for n in totals]
    quotas = highest_quotients(targets, min(round(sum(targets) / block), 2 * sum(b for b, t in zip(blocks, targets) if t > 0)), [2 * b if t > 0 else 0 for b, t in zip(blocks, targets)])
    taken = [[0] * n for n in sizes]
    for no, name in enumerate(names):
        mine = [k for k, r in enumerate(rows) if r[2] == name]
        shards = -(-len(mine) // shard_rows)
        streams = {}
        for k in mine:
            doc, text, _ = rows[k]
            digest = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)
            digest = digest - 2**64 if digest >= 2**63 else digest
            streams.setdefault(spark_hash(mixing.SEED, doc, sizes[k], digest) % shards, []).append((spark_hash(mixing.SEED + 1, doc, sizes[k], digest), k))
        order = sorted(streams)
        tokens = [[(k, x) for _, k in sorted(streams[s]) for x in range(sizes[k])] for s in order]
        counts = [-(-len(w) // block) for w in tokens]
        for shard, stream, n, quota in zip(order, tokens, counts, highest_quotients(counts, min(quotas[no], 2 * sum(counts)), [2 * n for n in counts])):
            start = min(int(np.random.default_rng([mixing.SEED, shard, no]).random() * n), max(n - 1, 0)) * block
            for step in range(min(quota * block, 2 * len(stream))):
                k, x = stream[(start + step) % len(stream)]
                taken[k][x] += 1
    return taken if words else list(map(sum, taken)), dict(zip(names, targets))


@pytest.mark.parametrize("seed", [1, 2])
def test_taken_words_are_those_of_a_plain_mix(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 25)
    draw = random.Random(seed)
    rows = [(i, " ".join(f"w{k}" for k in range(draw.choice([0, 1, 7, 60, 200]))), draw.choice(["a", "a", "a", "b", "c", None])) for i in range(150)]
    rows += [(1000, None, "a"), (1001, "x y z", "tiny"), (1002, "  ", "blank")]
    want, targets = plain_mix(rows, 25)
    got = {r["doc_id"]: r for r in mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.contract_weight).collect()}
    assert [got[r[0]]["taken"] for r in rows] == want
    assert {s: got[next(r[0] for r in rows if r[2] == s)]["target"] for s in targets} == pytest.approx(targets)


def test_small_sources_come_near_their_targets(spark):
    rows = [(1, "a b c", "s0"), (2, "a b c d e", "s1")] + [(10 + i, " ".join("x" * 100), "s2") for i in range(100)]
    got = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.contract_weight).collect()
    by = Counter()
    for r in got:
        by[r["source"]] += r["taken"]
    for source, target in {(r["source"], r["target"]) for r in got}:
        assert abs(by[source] - target) <= max(1, 0.02 * target)
    assert by["s0"] == 6 and by["s1"] == 10
    many = spark.range(5).selectExpr("id AS doc_id", "'a' AS text", "cast(id AS string) AS source")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mixing, "MOST_SOURCES", 4)
        with pytest.raises(ValueError):
            mixing.mix_plan(many, mixing.contract_weight)


def test_mix_over_odd_rows(spark, edge, edge_rows, empty):
    plan = mixing.mix_plan(edge, mixing.contract_weight).collect()
    assert len(plan) == len(edge_rows)
    assert sum(r["size"] for r in plan) == sum(len(WORDS.findall(row[1] or "")) for row in edge_rows)
    assert all(r["taken"] == 0 for r in plan if r["doc_id"] in (4, 5, 6))
    out = mixing.mixed_documents(edge)
    assert out.columns == edge.columns and all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert mixing.mix_plan(empty, mixing.contract_weight).count() == 0 and mixing.mixed_documents(empty).count() == 0


# --- sharding


def test_rendezvous_moves_rows_only_into_the_new_shard(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    rows = sharding.rendezvous_shards(df, "doc_id", [1.0] * 8 + [2.0], [1.0] * 8 + [2.0, 1.0]).collect()
    count = Counter(r["shard"] for r in rows)
    assert set(count) == set(range(9)) and 300 < count[0] < 500 and 680 < count[8] < 920
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert 280 < len(moved) < 450 and all(r["grown_shard"] == 9 for r in moved)
    assert all(r["shard"] == 1 for r in sharding.rendezvous_shards(df.limit(20), "doc_id", [0.0, 3.0]).collect())
    with pytest.raises(ValueError):
        sharding.shard_of(df["doc_id"], df["doc_id"], [0.0])


def test_slots_are_gapless(spark, monkeypatch, edge, empty):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 100)
    df = sharding.rendezvous_shards(spark.range(2000).selectExpr("id % 1500 AS doc_id"), "doc_id", [1.0] * 5)
    out = sharding.with_slots(df, sharding.key_halves(F.col("doc_id"))[0], ["doc_id"]).collect()
    for shard in range(5):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    odd = sharding.rendezvous_shards(edge, "doc_id", [1.0] * 4, [1.0] * 5)
    rows = odd.collect()
    assert len(rows) == edge.count() and len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert sharding.with_slots(sharding.rendezvous_shards(empty, "doc_id", [1.0]), sharding.key_halves(F.col("doc_id"))[0], ["doc_id"]).count() == 0


# --- secrets


def spans(text):
    found = []
    for number, rule in enumerate(secret_scan.BASE):
        for m in re.compile(rule.pattern).finditer(text or ""):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), number, rule.kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def test_secrets_incrementally(spark, edge, edge_rows, empty, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    draw = random.Random(6)
    bits = ["token", "SECRET", " = ", ":", "'", "api_key", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "é", " ", "\n", "passwd", "x", "\U0001f600"]
    rows = [(100 + i, "".join(draw.choice(bits) for _ in range(draw.randint(0, 30)))) for i in range(120)]
    first = edge.select("doc_id", "text")
    got = secret_scan.scan_history(first, ledger, path="doc_id")
    want = sorted(repr((row[0], spans(row[1]))) for row in edge_rows)
    assert sorted(repr(tuple(r)) for r in got.select("path", secret_scan.span_text("spans")).collect()) == want
    scanned = secret_scan.read_ledger(spark, ledger).count()
    assert scanned == len({row[1] or "" for row in edge_rows})
    more = first.unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    got = secret_scan.scan_history(more, ledger, path="doc_id").select("path", secret_scan.span_text("spans")).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted([*want, *(repr((i, spans(t))) for i, t in rows)])
    blobs = {row[1] or "" for row in edge_rows} | {t for _, t in rows}
    assert secret_scan.read_ledger(spark, ledger).count() == len(blobs)  # nothing was scanned twice
    newer = (*secret_scan.BASE[:2], secret_scan.Rule("hex", r"[0-9a-f]{16,}", 0, 16, version=2))
    got = secret_scan.scan_history(first, ledger, newer, path="doc_id").filter("path = 10").first()
    assert got["n_hex"] == 1 and got["n_access"] == 1
    last = secret_scan.read_ledger(spark, ledger).filter("array_contains(rules, 'hex@2')").collect()
    assert {tuple(r["rules"]) for r in last} == {("hex@2",)}  # only the new rule ran on the old blobs
    assert secret_scan.scan_history(empty, f"file://{tmp_path}/none", path="doc_id").count() == 0


def test_secret_of_short_value_uses_up_its_text(spark, tmp_path):
    text = "secret=token : abcdefgh and token='q1w2e3r4'"
    got = secret_scan.scan_history(spark.createDataFrame([(1, text)], "path int, text string"), f"file://{tmp_path}/l").first()
    assert [(s["kind"], s["start"], s["stop"]) for s in got["spans"]] == [("assign", 28, 43)]
    assert hashlib.sha256(text.encode()).hexdigest() == got["sha"]


# --- pipeline


def test_pipeline_stages_over_odd_rows(spark, edge, empty):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "source_mix", "byte_bpe"]
    for start, rows in ((edge, True), (empty, False)):
        docs = start.select("doc_id", "text", "lang", "source", "n_chars")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, ""), "stage")
            assert docs.columns == columns, name
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0) == rows
