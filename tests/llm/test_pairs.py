"""Near-duplicates of texts and vectors, and line dedup, against plain comparison of all pairs."""

import math
import random
import re
import time

import numpy as np
import pytest

from tessera.llm import components, embedding_dedup, line_dedup, minhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def reach(nodes, links):
    least = {n: n for n in nodes}
    while True:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
        if not changed:
            return least


def test_components_of_chains_stars_and_loops(spark):
    draw = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7), (3, 9), (9, 3), (2, 9)]
    links += [(draw.randrange(1000, 1100), draw.randrange(1000, 1100)) for _ in range(70)]
    nodes = {x for link in links for x in link}
    want = {n: low for n, low in reach(nodes, links).items() if n != low}
    got = components.components(spark.createDataFrame(links, "u long, v long"))
    assert dict(map(tuple, got.collect())) == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text, n):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near_texts():
    """Families of edited copies, some in chains whose ends are far apart."""
    draw = random.Random(8)
    texts = []
    for _ in range(6):
        words = [f"x{draw.randrange(400)}" for _ in range(draw.choice([5, 40, 160]))]
        texts.append(" ".join(words))
        for _ in range(7):
            base = list(words)
            for _ in range(draw.choice([0, 1, 2, 5])):
                base[draw.randrange(len(base))] = f"y{draw.randrange(1000)}"
            texts.append(" ".join(base).upper() if draw.random() < 0.3 else "\t".join(base))
            words = base if draw.random() < 0.5 else words
    return texts


@pytest.mark.parametrize(("words", "part", "block"), [(3, 85, 2), (5, 80, 256)])
def test_near_duplicates_lose_no_link(spark, monkeypatch, words, part, block):
    monkeypatch.setattr(minhash, "BLOCK", block)  # small: many components have blocks of their own
    texts = near_texts()
    sets = [shingles(t, words) for t in texts]
    links = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j])
    ]
    least = reach(range(len(sets)), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, words, part).collect()}
    assert got == {i: (len(s), least[i], least[i] == i) for i, s in enumerate(sets)}


def test_near_duplicates_over_odd_rows(spark, edge, edge_rows, empty):
    got = minhash.near_duplicates(edge).collect()
    assert len(got) == len(edge_rows)
    by = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"]), r["component_id"], r["kept"]) for r in got)
    first = len(shingles(edge_rows[0][1], 5))
    assert ((False, 1, first), 1, True) in by and by.count(((False, 3, first), 1, False)) == 2
    assert ((True, 0, first), 1, False) in by  # a null id follows its component
    assert {x[0][1] for x in by if x[0][2] == 0} == {4, 5, 6} and all(x[2] for x in by if x[0][2] == 0)
    assert ((False, 12, 1), 11, False) in by and ((False, 8, len(shingles(edge_rows[11][1], 5))), 7, False) in by
    kept = minhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(map(repr, [1, 2, 3, None, 4, 5, 6, 7, 9, 10, 11]))
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0


def test_texts_meet_their_class_once(spark, monkeypatch):
    """Ids that are null or repeat over many texts do not multiply the texts that are read again."""
    seen, plain = [], minhash.full_sets
    monkeypatch.setattr(minhash, "full_sets", lambda docs, words: seen.append(docs.count()) or plain(docs, words))
    common = " ".join(f"c{i}" for i in range(60))
    texts = [f"{common} u{k} v{k}" for k in range(40)]
    rows = [(None if k % 2 else 5, t) for k, t in enumerate(texts)]
    sets = [shingles(t, 3) for t in texts]
    links = [(i, j) for i in range(40) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert seen == [40] and len(links) == 780 and all(r["component_id"] == 5 for r in got) and len(got) == 40


def test_sketches_tell_near_from_far():
    plan = minhash.Plan(3, 85)
    assert (1 - 0.85**plan.rows) ** minhash.BANDS < minhash.MISS
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**63, 2000).astype(np.uint64)
    for share, allowed in ((0.9, True), (0.86, True), (0.3, False), (0.0, False)):
        common = int(2000 * 2 * share / (1 + share))
        other = np.concatenate([base[:common], draw.integers(0, 2**63, 2000 - common).astype(np.uint64)])
        odd = minhash.odd_sketches(minhash.min_hashes([np.unique(base), np.unique(other)], plan.samples))
        assert (int(np.bitwise_count(odd[0] ^ odd[1]).sum()) <= plan.most_flipped) == allowed


def test_full_sets_move_only_for_pairs_that_parities_allow(spark, monkeypatch):
    """Pairs below the threshold that sketches let pass are told by parities; pairs at it all stay."""
    plan, plain, met = minhash.Plan(3, 85), minhash.materialize, {}

    def materialize(df, name):
        out = plain(df, name)
        met[name] = {(r["u"], r["v"]) for r in out.collect()} if name == "nd-hopeful" else None
        return out

    monkeypatch.setattr(minhash, "materialize", materialize)
    draw, sets, near = np.random.default_rng(3), [], set()
    for n, share in [(n, share) for n in (1, 7, 40, 400, 3000) for share in (0.6, 0.7, 0.75, 0.85, 0.9, 1.0)]:
        common = int(np.ceil(2 * n * share / (1 + share)))
        every = draw.integers(0, 2**63, 2 * n - common).astype(np.uint64)
        sets += [np.unique(every[:n]), np.unique(every[n - common :])]
        if 100 * common >= 85 * (2 * n - common):
            near.add((len(sets) - 2, len(sets) - 1))
    table = spark.createDataFrame([(i, len(s), minhash.parities(s).tolist(), s.view(np.int64).tolist()) for i, s in enumerate(sets)], "cid long, n_shingles long, odd array<long>, shingles array<long>")
    pairs = plain(spark.createDataFrame([(i, i + 1) for i in range(0, len(sets), 2)], "u long, v long"), "pairs")
    assert {(r["u"], r["v"]) for r in minhash.confirmed(pairs, table, plan).collect()} == near
    assert near <= met["nd-hopeful"] and len(met["nd-hopeful"]) <= len(near) + 3 < len(sets) // 2


def test_crowded_bucket_is_searched_in_blocks(spark, monkeypatch):
    """All texts share half of their words, so buckets hold many that are not near."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    draw = random.Random(4)
    common = [f"c{i}" for i in range(60)]
    texts = [" ".join(common + [f"u{k}-{i}" for i in range(12)]) for k in range(20)]
    texts += [t + " more" for t in texts[:10]]
    draw.shuffle(texts)
    sets = [shingles(t, 3) for t in texts]
    links = [(i, j) for i in range(30) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    least = reach(range(30), links)
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == least


def test_vectors_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    draw = np.random.default_rng(6)
    vectors = []
    for _ in range(12):
        centre = draw.standard_normal(24)
        vectors += [centre + draw.standard_normal(24) * s for s in draw.choice([0.0, 0.1, 0.2, 0.35], 25)]
    vectors = [[float(np.float32(x)) for x in v] for v in vectors]
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    least = reach(range(len(vectors)), list(zip(*map(list, np.nonzero(near)))))
    odd = [None, [], [0.0] * 24, [math.nan] * 24, [math.inf] * 24, [1.0, None], [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, None) for i, v in enumerate(vectors)] + [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(None, [3.0, 6.0], 2)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")).collect()
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == len(rows)
    assert {i: by[i] for i in range(len(vectors))} == {i: (int(near[i].sum()), least[i], least[i] == i) for i in range(len(vectors))}
    assert all(by[1000 + i] == (0, 1000 + i, True) for i in range(6))
    assert by[1006] == (2, 1006, True) and by[1007] == (2, 1006, False) and by[None] == (2, 1006, False)
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_columns_of_vectors_that_clash_are_not_read(spark):
    names = ["key", "links", "own", "n", "h0", "h1", "ok", "component_id", "kept", "_part"]
    rows = [(i, [1.0, float(i % 2)], *["x"] * len(names)) for i in range(6)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, ["vec_id", "embedding", *names])).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got} == {(i, 2, i % 2, i < 2) for i in range(6)}


def test_tables_follow_the_number_of_vectors():
    for n in (1, 100, 10_000, 10**6, 10**9):
        bits, tables = embedding_dedup.tables_for(n, 0.95)
        agree = (1 - math.acos(0.95) / math.pi) ** bits
        assert (1 - agree) ** tables <= embedding_dedup.MISS and n / 2**bits <= embedding_dedup.BUCKET


def test_patience_aligns_moved_and_repeated_lines():
    a, b = list(map(ord, "abcXdefY")), list(map(ord, "QabcdefYabc"))
    pairs = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs, key=lambda p: p[1])
    assert line_dedup.common_blocks(a, b, [1] * len(b), 3) == [(1, 4), (4, 8), (8, 11)]
    assert line_dedup.common_blocks([], [], [], 1) == [] and line_dedup.patience(list("aa"), list("aa")) == [(0, 0), (1, 1)]


def line_corpus():
    draw = random.Random(12)
    pool = [" ".join(f"p{k}w{i}" for i in range(draw.choice([3, 15, 45]))) for k in range(30)]
    texts = []
    for d in range(60):
        lines = [f"own {d} {i} " + " ".join(f"o{d}-{i}-{w}" for w in range(6)) for i in range(draw.randint(0, 5))]
        at, n = draw.randrange(len(pool)), draw.randint(1, 5)
        where = draw.randint(0, len(lines))
        texts.append("\n".join([*lines[:where], *pool[at : at + n], "", *lines[where:]]))
    return texts + texts[:5]


def test_line_dedup_deletes_every_long_common_block_and_nothing_else(spark):
    texts = line_corpus()
    lines = [[" ".join(WORDS.findall(x)) for x in t.split("\n")] for t in texts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    for i, mine in enumerate(lines):
        want = set()
        for other in lines[:i]:
            for a in range(len(mine)):
                for b in range(len(other)):
                    k = 0
                    while a + k < len(mine) and b + k < len(other) and mine[a + k] == other[b + k]:
                        k += 1
                    if sum(len(x.split()) for x in mine[a : a + k]) >= line_dedup.LEAST_WORDS:
                        want |= set(range(a, a + k))
        gone = {x for part in got[i]["removed"].split(",") if part for x in range(*map(int, part.split("-")))}
        solid = {x for x in gone if mine[x]}
        assert solid == {x for x in want if mine[x]}, i
        assert got[i]["row"]["text"] == "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone)
        assert got[i]["n_removed"] == len(gone) and all(d < i for d in got[i]["donors"]) and bool(got[i]["donors"]) == bool(gone)


def test_line_dedup_of_passages_that_repeat_inside_documents(spark):
    lines = [" ".join(f"q{i}-{k}" for k in range(8)) for i in range(10)]
    x, y = " ".join(f"x{k}" for k in range(9)), " ".join(f"y{k}" for k in range(7))
    texts = [["a0", *lines, "a1"], ["b0", *lines, "b1", *lines, "b2"], ["c0", *lines, "c1"], ["d0", *lines, "d1", *lines, "d2"], ["e0", *[x, y] * 6, "e1"], ["f0", *[x, y] * 4, "f1", *[y, x] * 4, "f2"]]
    draw = random.Random(2)
    short = [" ".join(f"s{i}w{k}" for k in range(draw.choice([2, 6, 11]))) for i in range(4)]
    texts += [[f"g{d} own", *[draw.choice([*short, *short, f"own {d} {k}"]) for k in range(draw.randint(5, 40))]] for d in range(25)]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[0]["n_removed"] == 0
    assert [got[i]["row"]["text"].split("\n") for i in (1, 2, 3)] == [["b0", "b1", "b2"], ["c0", "c1"], ["d0", "d1", "d2"]]
    assert got[4]["n_removed"] == 0 and got[5]["row"]["text"].split("\n") == ["f0", "f1", "f2"]
    for i, gone in enumerate(shared_words(["\n".join(t) for t in texts])):
        left = WORDS.findall(got[i]["row"]["text"])
        want = [w for k, w in enumerate(WORDS.findall("\n".join(texts[i]))) if k not in gone]
        assert len(want) <= len(left) and len(left) - len(want) <= 3 * 40, i
        assert not (set(range(len(want) + len(gone))) <= gone) or not left


def test_blocks_in_reverse_order_take_time_that_follows_the_lines():
    blocks = [list(range(8 * k, 8 * k + 8)) for k in range(800)]
    a, b = [x for block in blocks for x in block], [x for block in reversed(blocks) for x in block]
    began = time.perf_counter()
    found = line_dedup.common_blocks(a, b, [6] * len(b), 40)
    assert time.perf_counter() - began < 2 and covered(found) == set(range(len(b)))


def test_line_dedup_over_odd_rows(spark, edge, edge_rows, empty):
    rows = line_dedup.dedup_lines(edge).collect()
    assert len(rows) == len(edge_rows)
    first = [r for r in rows if r["row"]["doc_id"] == 1]
    assert first[0]["n_removed"] == 0
    assert [r["removed"] for r in rows if r["row"]["doc_id"] == 2] == ["1-2"]
    twice = [r for r in rows if r["row"]["doc_id"] == 3 and r["row"]["lang"]]
    assert [r["row"]["text"] for r in twice] == ["", ""] and all(r["donors"] == [1] for r in twice)
    assert [r["row"]["text"] for r in rows if r["row"]["doc_id"] == 4] == [None]
    out = line_dedup.deduplicated(edge)
    assert out.columns == edge.columns
    left = sorted(repr(r["doc_id"]) for r in out.collect())
    assert left == sorted(map(repr, [1, 2, 3, None, 4, 5, 6, 7, 8, 9, 10, 11, 12]))
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.deduplicated(empty).count() == 0


def shared_words(texts, least=40):
    """By document, which words are in a run of ``least`` words that an earlier document holds."""
    held, out = set(), []
    for text in texts:
        words = WORDS.findall(text)
        runs = [tuple(words[k : k + least]) for k in range(len(words) - least + 1)]
        out.append({k + x for k, run in enumerate(runs) if run in held for x in range(least)})
        held |= set(runs)
    return out


def test_line_dedup_cuts_passages_that_start_and_end_inside_lines(spark):
    draw = random.Random(21)
    pool = [f"p{k}" for k in range(300)]
    texts = []
    for d in range(40):
        own = iter(f"o{d}-{k}" for k in range(10**6))
        words = [next(own) for _ in range(9)]
        for _ in range(draw.randint(1, 3)):
            at = draw.randrange(200)
            words += [*pool[at : at + draw.choice([39, 40, 41, 59, 90])], *(next(own) for _ in range(draw.randint(1, 12)))]
        texts.append("".join(w + draw.choice([" ", " ", " ", "\t ", "\n"]) for w in words))
    whole = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["row"]["doc_id"]: r for r in whole}
    want = shared_words(texts)
    assert sum(bool(x) for x in want) > 20
    for i, text in enumerate(texts):
        starts = np.cumsum([0, *(len(WORDS.findall(x)) for x in text.split("\n"))]).tolist()
        gone = {x for part in got[i]["removed"].split(",") if part for low, high in [part.split("-")] for x in range(starts[int(low)], starts[int(high)])}
        for part in got[i]["cut"].split(",") if got[i]["cut"] else []:
            line, low, high = map(int, re.split("[:-]", part))
            gone |= set(range(starts[line] + low, starts[line] + high))
        assert WORDS.findall(got[i]["row"]["text"]) == [w for k, w in enumerate(WORDS.findall(text)) if k not in gone], i
        kept = sorted(want[i] - gone)
        pieces = sum(k - 1 not in kept for k in kept)
        assert gone <= want[i] and len(kept) <= (line_dedup.LEAST_PIECE - 1) * pieces and pieces <= 6, i
        assert bool(got[i]["donors"]) == bool(want[i]) and all(d < i for d in got[i]["donors"])
    rows = [(1, "a b c\n" + PASSAGE_59), (2, "x y  " + PASSAGE_59.replace("\n", " ") + "  z\n\nend")]
    out = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[2]["row"]["text"] == "x y  z\n\nend" and (out[2]["removed"], out[2]["cut"], out[2]["donors"]) == ("", "0:2-61", [1])


PASSAGE_59 = "\n".join(" ".join(f"s{i}" for i in range(low, high)) for low, high in ((0, 20), (20, 24), (24, 45), (45, 59)))


def covered(blocks):
    return {x for low, high in blocks for x in range(low, high)}


def test_common_blocks_leave_no_repeated_or_crossed_passage():
    blocks = lambda a, b, words: line_dedup.common_blocks(a, b, words, 40)
    assert covered(blocks([1, 9, 2, 9, 3], [4, 9, 5], [6, 45, 6])) == {1}  # twice in the earlier one
    assert covered(blocks([1, 9, 2], [4, 9, 5, 9, 6], [6, 45, 6, 45, 6])) == {1, 3}  # twice in the later one
    assert covered(blocks([1, 2, 3, 9], [9, 1, 2, 3], [45, 3, 3, 3])) == {0}  # crossed by short lines
    draw = random.Random(31)
    size = [0, 3, 12, 25, 45, 20]
    for _ in range(2000):
        a, b = ([draw.randrange(6) for _ in range(draw.randint(0, 9))] for _ in range(2))
        want = set()
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                if sum(size[x] for x in b[j : j + k]) >= 40:
                    want |= set(range(j, j + k))
        words = [size[x] for x in b]
        got = covered(blocks(a, b, words))
        assert {x for x in got if words[x]} == {x for x in want if words[x]}, (a, b)
