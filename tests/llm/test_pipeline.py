"""The whole pipeline against plain versions of its stages, one document after the other."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from test_pairs import reach, shared_words, shingles
from test_scores_and_shares import TONGUES, WORDS, plain_mix, spoken
from test_tokens_and_media import PATTERN, library  # noqa: F401

from tessera.llm import langid, line_dedup, mixing


def corpus():
    """Texts of three tongues, some of none; copies, near copies, and passages of whole lines."""
    draw = random.Random(17)
    rows, passages = [], [" ".join(f"{spoken(draw, TONGUES['aa'], 1)}{k}{chr(97 + j)}" for j in range(45)) for k in range(5)]
    for i in range(170):
        tongue = draw.choice(sorted(TONGUES))
        lines = [" ".join(f"{w}{chr(97 + draw.randrange(26))}{chr(97 + draw.randrange(26))}" for w in spoken(draw, TONGUES[tongue], draw.randint(8, 30)).split()) for _ in range(draw.randint(1, 4))]
        if i % 6 == 0:
            lines.insert(1, draw.choice(passages))
        rows.append((i, "\n".join(lines), tongue, f"s{i % 5}" if i % 9 else None))
    rows += [(200 + i, rows[3 * i][1], rows[3 * i][2], "s1") for i in range(12)]
    for i in range(12):  # one word in about forty is another
        words = rows[5 * i + 1][1].split(" ")
        for k in range(0, len(words), 37):
            words[k] += "x"
        rows.append((300 + i, " ".join(words), rows[5 * i + 1][2], "s2"))
    return rows + [(400, "Привет мир как дела", None, "s0"), (401, None, None, "s0"), (402, "1 2 3", "aa", "s0"), (403, "", "bb", "s3")]


def kept_by_language(rows, model):
    out = []
    for row in rows:
        text = row[1] or ""
        if not any(map(str.isalpha, text)):
            continue
        scores, known = model.scores(*langid._framed([text]))
        if scores[0].max() >= model.bar and known[0] >= model.known_bar:
            out.append(row)
    return out


def without_shared_words(rows):
    out = []
    for row, gone in zip(rows, shared_words([r[1] for r in rows])):
        lines, at = [], 0
        for line in row[1].split("\n"):
            mine = set(range(at, at + len(WORDS.findall(line))))
            at += len(mine)
            if mine and mine <= gone:
                continue
            if mine & gone:
                words = [w for k, w in zip(sorted(mine), WORDS.findall(line)) if k not in gone]
                line = " ".join(words)
            lines.append(line)
        text = "\n".join(lines)
        if WORDS.findall(text) or not gone:
            out.append((row[0], text, *row[2:]))
    return out


def one_of_each_group(rows):
    sets = [shingles(r[1], 5) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    least = reach(range(len(rows)), links)
    return [r for i, r in enumerate(rows) if least[i] == i]


def mixed(rows):
    taken, _ = plain_mix([(i, t, s) for i, t, _, s in rows], mixing.SHARD_ROWS, words=True)
    out = []
    for row, counts in zip(rows, taken):
        words = WORDS.findall(row[1])
        if not words:
            continue
        passes = min(counts)
        out += [(row[0], row[1])] * passes
        if extra := [w for w, n in zip(words, counts) if n > passes]:
            out.append((row[0], " ".join(extra)))
    return out


def test_run_gives_what_plain_stages_give(spark, tmp_path, library, monkeypatch):  # noqa: F811
    import corpus_pipeline

    monkeypatch.setattr(mixing, "SHARD_ROWS", 25)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", 7) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, n_tokens int")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    after = kept_by_language(rows, langid.fit(docs))
    assert {400, 401, 402, 403} & {r[0] for r in after} == set() and len(after) > 180
    lines = without_shared_words(after)
    assert len(lines) < len(after)
    groups = one_of_each_group(lines)
    assert len(groups) < len(lines)
    want = Counter()
    for i, text in mixed(groups):
        ids = library.encode_ordinary(text)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = Counter(tuple(r)[:4] for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect())
    assert got == want


def test_stages_keep_columns_whose_names_clash(spark):
    import corpus_pipeline

    names = ["rid", "row_", "keys", "text_hash", "place", "Score", "lang_pred", "size", "target", "taken", "n", "comp", "kept", "passes", "whole", "n_removed", "spot", "told", "copy"]
    rows = [(i, f"ka to mi {i}\n" + " ".join(f"w{k % 7}{i % 3}{k}" for k in range(50)), "aa", "s", 9, *[f"{x}{i}" for x in names]) for i in range(8)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[x] for x in names] == [f"{x}{r['doc_id']}" for x in names], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 8


def test_blocks_of_just_under_the_least_words_stay(spark):
    for n in (line_dedup.LEAST_WORDS - 1, line_dedup.LEAST_WORDS):
        passage = " ".join(f"p{k}" for k in range(n))
        rows = [(1, f"a b\n{passage}\nc"), (2, f"d\n{passage}\ne f")]
        got = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == (n == line_dedup.LEAST_WORDS)


def test_a_stage_begins_without_the_heap_of_the_one_before(spark):
    """A heap once grown would count beside the Python workers of all later stages."""
    import corpus_pipeline

    committed = lambda: spark._jvm.java.lang.Runtime.getRuntime().totalMemory() >> 20
    docs = spark.createDataFrame([(1, "a text", "en", "s")], "doc_id long, text string, lang string, source string")
    name, stage = corpus_pipeline.STAGES[-1]
    assert name == "byte_bpe"
    spark.range(1 << 30, (1 << 30) + 1, 1, 1).selectExpr("octet_length(repeat('x', cast(id as int)))").collect()
    grown = committed()
    assert grown > 1000
    stage(spark, docs, "")
    assert committed() < grown - 500, (grown, committed())
