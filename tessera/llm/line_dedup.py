"""Line dedup by pairwise alignment.

Lines are hashed by their words; a line too short to matter is joined with the lines after it, and
once more with those before it, until the run holds ``least_words`` words. Such runs are rare where
lines are not: a common heading or closing line alone names no partner, a shared passage does. Every
block of at least ``least_words`` words that two documents share consists of runs that both have.
Each run names, for every document that holds it, the earliest document that does: at most one partner
per run, however many hold it, so partners grow with the lines and not with their pairs, and no run
is too frequent to be looked at. A pair is aligned with patience diff over line hashes, and aligned
blocks with at least ``least_words`` words go from the later document; an exact lookup of the runs
that no alignment reached (repeated in either document, or crossed by lines that align) follows.

Passages that start or end inside a line are then found by words (``passages``) in what alignment
leaves: every run of ``least_words`` words that an earlier document holds goes, wherever lines break,
and lines at its ends lose those words only. A run that holds enough words without a piece of under
``LEAST_PIECE`` words beyond a line break leaves that piece, since texts often go on with the same word
by chance. What goes from a document always stays in an earlier one, and the earliest holder keeps it.
Shared passages of under ``least_words`` words stay everywhere.

Documents with nothing to share are told by a sieve of fixed size and are not shuffled; documents
that hold one frequent run, and followers of one frequent document, are spread over tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import passages
from .common import WORD, bounded_batches, discard, materialize, mix64, sieve, sieved, spread_join, tidied

#: Words of the shortest shared passage that goes; shorter ones are left alone everywhere.
LEAST_WORDS = 40
LEAST_PIECE = 4
#: Later documents that are aligned with one copy of an earlier one's lines.
FOLLOWERS = 1000
#: A word with the white space before it, and after it at the end of a line.
_SPACED = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+\Z)?")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, given by rising first member, whose second members rise too."""
    piles: list[int] = []
    tops: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(piles, j)
        if at == len(piles):
            piles.append(j)
            tops.append(k)
        else:
            piles[at] = j
            tops[at] = k
        back[k] = tops[at - 1] if at else -1
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences: common heads and tails, then lines that are unique in
    both, longest rising order first, then the stretches between those in the same way."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict[int, int] = {}
        for i in range(a0, a1):
            once[a[i]] = -1 if a[i] in once else i
        seen: dict[int, int] = {}
        for j in range(b0, b1):
            if once.get(b[j], -1) >= 0:
                seen[b[j]] = -1 if b[j] in seen else j
        anchors = _longest_rising(sorted((once[x], j) for x, j in seen.items() if j >= 0))
        for (i, j), (i1, j1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            if anchors and i + 1 < i1 and j + 1 < j1:
                todo.append((i + 1, i1, j + 1, j1))
        out += anchors
    return sorted(out)


def _held(marks: list[int], words: list[int], least_words: int) -> dict[int, tuple[int, int]]:
    """A place of each run of lines by its hash."""
    low, high, _, keys = _runs(np.array(marks, np.int64), np.array(words, np.int64), np.array([0, len(marks)], np.int64), least_words)
    return dict(zip(keys.tolist(), zip(low.tolist(), high.tolist())))


def common_blocks(a: list[int], b: list[int], words: list[int], least_words: int, held: dict[int, tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Ranges of ``b``, whose lines hold ``words``, that ``a`` has too and that hold at least
    ``least_words`` words: first blocks of lines that patience diff aligns, then, wherever they stand and
    however often, the runs of lines that no such block holds, joined where they overlap. No common
    block of so many words is left. ``held`` has the runs of ``a`` if they are known. The time
    follows the lines, but for the nesting of anchors."""
    out: list[tuple[int, int]] = []
    pairs, start = patience(a, b), 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k] != (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1):
            low, high = pairs[start][1], pairs[k - 1][1] + 1
            if sum(words[low:high]) >= least_words:
                out.append((low, high))
            start = k
    if held is None:
        of = dict(zip(b, words))
        held = _held(a, [of.get(x, 0) for x in a], least_words)  # a line that b lacks is in no common run
    low, high, _, keys = _runs(np.array(b, np.int64), np.array(words, np.int64), np.array([0, len(b)], np.int64), least_words)
    todo, reach = out[::-1], 0  # the furthest end of an aligned block that starts at a line or before it
    more: list[tuple[int, int]] = []
    for j, end, key in sorted(zip(low.tolist(), high.tolist(), keys.tolist())):
        while todo and todo[-1][0] <= j:
            reach = max(reach, todo.pop()[1])
        if end <= reach or key not in held:
            continue
        i, stop = held[key]
        if a[i:stop] == b[j:end]:
            if more and j < more[-1][1]:
                more[-1] = (more[-1][0], max(end, more[-1][1]))
            else:
                more.append((j, end))
    return sorted(out + more)


def _aligned(least_words: int):
    """Blocks of later documents; rows of one earlier document come together, its own first."""

    def run(batches):
        mine, first, held = None, [], {}
        for batch in batches:
            rid, lead, ranges = [], [], []
            for of, part, kind, r, marks, words in zip(*(batch.column(i).to_pylist() for i in range(6))):
                marks, words = np.frombuffer(marks, np.int64).tolist(), np.frombuffer(words, np.int32).tolist()
                if not kind:
                    mine, first, held = (of, part), marks, _held(marks, words, least_words)
                    continue
                if mine != (of, part):
                    raise ValueError(f"the lines of {of} are missing")
                blocks = common_blocks(first, marks, words, least_words, held)
                if blocks:
                    rid.append(r)
                    lead.append(of)
                    ranges.append([x for block in blocks for x in block])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid, pa.int64()), pa.array(lead, pa.int64()), pa.array(ranges, pa.list_(pa.int32()))], ["rid", "lead", "ranges"]
            )

    return run


def _edges(gone: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of a mask that are true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def cut_words(words: np.ndarray, gone: np.ndarray, runs: list[int], least_words: int) -> np.ndarray:
    """Which words go, of a document whose lines hold ``words`` and lose the lines ``gone``, when runs
    of ``least_words`` words start at ``runs``; ``gone`` gains the lines that lose all their words,
    and blank lines inside a run."""
    ends = np.cumsum(words)
    starts = ends - words
    change = np.zeros(int(ends[-1]) + 1, np.int32)
    np.add.at(change, np.asarray(runs, np.int64), 1)
    np.add.at(change, np.asarray(runs, np.int64) + least_words, -1)
    cut = np.zeros(len(change) - 1, bool)
    for low, high in _edges((np.cumsum(change)[:-1] > 0) | np.repeat(gone, words)):
        first, last = np.searchsorted(ends, [low, high - 1], side="right")
        if starts[first] < low and ends[first] - low < LEAST_PIECE and high - ends[first] >= least_words:
            low = int(ends[first])
        if high < ends[last] and high - starts[last] < LEAST_PIECE and starts[last] - low >= least_words:
            high = int(starts[last])
        cut[low:high] = True
        gone[(words == 0) & (starts > low) & (starts < high)] = True
    cut |= np.repeat(gone, words)
    left = np.concatenate([[0], np.cumsum(~cut)])
    gone |= (words > 0) & (left[ends] == left[starts])
    return cut


def _runs(marks: np.ndarray, words: np.ndarray, offsets: np.ndarray, least_words: int) -> tuple[np.ndarray, ...]:
    """Start, end, row and hash of each shortest run of lines that holds ``least_words`` words, from every line
    with words onward and from every such line back; rows are stretches of ``marks`` by ``offsets``."""
    n = len(marks)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    total = np.concatenate([[0], np.cumsum(words)])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(words > 0)
    ends = np.searchsorted(total, total[at] + least_words)  # first end with enough words
    onward = np.stack([at, ends, row[at]])[:, ends <= offsets[row[at] + 1]]
    starts = np.searchsorted(total, total[at + 1] - least_words, side="right") - 1
    back = np.stack([starts, at + 1, row[at]])[:, starts >= offsets[row[at]]]
    low, high, rows = np.concatenate([onward, back], 1)
    powers = lambda base: np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, base, np.uint64))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(marks.view(np.uint64)) * powers(_BASE)[:n], dtype=np.uint64)])
    keys = mix64((sums[high] - sums[low]) * powers(_INVERSE)[low] + (high - low).astype(np.uint64))
    return low, high, rows, keys.view(np.int64)


def cut_text(text: str, ranges: list[int], runs: list[int], least_words: int) -> tuple[str, int, str, str]:
    """What is left of a text, how many lines go, their ranges, and the ranges of words that go from
    lines that stay."""
    lines = text.split("\n")
    words = np.array([len(x.split()) for x in text.encode().split(b"\n")], np.int64)  # bytes split at ASCII white space
    gone = np.zeros(len(lines), bool)
    for low, high in zip(ranges[::2], ranges[1::2]):
        gone[low:high] = True
    cut = cut_words(words, gone, runs, least_words)
    ends = np.cumsum(words)
    cuts = []
    for line in np.unique(np.searchsorted(ends, np.flatnonzero(cut), side="right")):
        if not gone[line]:
            mine = cut[ends[line] - words[line] : ends[line]]
            lines[line] = "".join(x for x, away in zip(_SPACED.findall(lines[line]), mine) if not away)
            cuts += [f"{line}:{low}-{high}" for low, high in _edges(mine)]
    left = "\n".join(x for x, away in zip(lines, gone) if not away)
    return left, int(gone.sum()), ",".join(f"{low}-{high}" for low, high in _edges(gone)), ",".join(cuts)


def _cut(least_words: int) -> Column:
    @F.pandas_udf("text string, n_removed long, removed string, cut string")
    def cut(text: pd.Series, ranges: pd.Series, runs: pd.Series) -> pd.DataFrame:
        empty = lambda x: [] if x is None else x
        rows = [("", 0, "", "") if t is None else cut_text(t, empty(a), empty(b), least_words) for t, a, b in zip(text, ranges, runs)]
        return pd.DataFrame(rows, columns=["text", "n_removed", "removed", "cut"])

    return cut.asNondeterministic()  # a filter on what is left must not cut once more


def _digest(text: Column) -> Column:
    return F.xxhash64(text)


def line_blocks(shared: DataFrame, lines: DataFrame, least_words: int) -> DataFrame:
    """``rid, lead, ranges``: the lines of later documents that align with those of the earliest holder
    of a run. ``shared`` (``rid, keys``) has the shared keys, ``lines`` (``rid, marks, sizes``) the
    lines of each document."""
    runs = shared.select("rid", F.explode(F.filter("keys", lambda k: k.bitwiseAND(F.lit(1)) == 1)).alias("key"))
    leads = runs.groupBy("key").agg(F.min("rid").alias("lead"), F.max("rid").alias("last"), F.count("*").alias("n")).filter("lead < last").drop("last")
    leads = materialize(leads, "ld-leads")
    pairs = spread_join(runs, leads, ["key"], F.xxhash64("rid")).filter("rid <> lead").select("rid", "lead").distinct()
    pairs = materialize(pairs, "ld-pairs")
    many = materialize(pairs.groupBy("lead").agg(F.count("*").alias("n"), F.count("*").alias("followers")), "ld-followers")
    parts = F.ceil(F.col("followers") / F.lit(float(FOLLOWERS)))
    pairs = spread_join(pairs, many, ["lead"], F.xxhash64("rid")).withColumn("part", F.pmod(F.xxhash64("rid"), parts).cast("int"))
    pairs = materialize(pairs.select("rid", "lead", "part"), "ld-parts")
    later = pairs.withColumn("kind", F.lit(1))
    earlier = pairs.select(F.col("lead").alias("rid"), "lead", "part").distinct().withColumn("kind", F.lit(0))
    both = earlier.unionByName(later).join(lines, "rid").select("lead", "part", "kind", "rid", "marks", "sizes")
    both = both.repartition("lead", "part").sortWithinPartitions("lead", "part", "kind")
    found = materialize(both.mapInArrow(tidied(_aligned(least_words)), "rid long, lead long, ranges array<int>"), "ld-blocks")
    discard(leads, pairs, many)
    return found


def word_runs(said: DataFrame, least_words: int) -> DataFrame:
    """``rid, runs, leads``: starts of the runs of words that go from each document, and the documents
    that hold them first, of ``rid, hashes, sizes, keys, ranges``."""
    runs = materialize(said.mapInArrow(tidied(passages.windows(least_words)), "key long, rid long, at int"), "ld-windows")
    leads = runs.groupBy("key").agg(F.min("rid").alias("lead"), F.max("rid").alias("last"), F.count("*").alias("n")).filter("lead < last").drop("last")
    leads = materialize(leads, "ld-holders")
    found = spread_join(runs, leads, ["key"], F.xxhash64("rid", "at")).filter("rid <> lead")
    found = materialize(found.groupBy("rid").agg(F.collect_set("at").alias("runs"), F.collect_set("lead").alias("leads")), "ld-runs")
    discard(runs, leads)
    return found


def deletions(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``place, digest, n, whole, ranges, runs, donors`` of each document (``id, text``) that loses lines
    or words: hashes of its id and text, and how many rows repeat both. A written table."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["id"].dataType
    docs = docs.select("id", _digest(F.col("text")).alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("octets"), "text")
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    fields = [*docs.schema.fields[:-1], T.StructField("words", T.LongType()), *[T.StructField(x, T.BinaryType()) for x in ("hashes", "sizes", "marks")], T.StructField("keys", longs)]
    said = docs.mapInArrow(tidied(passages.described(least_words, _runs)), T.StructType(fields)).withColumn("row", F.monotonically_increasing_id())
    said = materialize(said, "ld-said")

    # ids in document order, so the earliest of many is a plain minimum
    rows = said.groupBy("id", "digest", "octets").agg(F.min("row").alias("row"), F.max("words").alias("words"), F.count("*").alias("n"))
    order = materialize(rows.orderBy(F.col("id").asc_nulls_last(), "digest", "octets").withColumn("rid", F.monotonically_increasing_id()), "ld-order")
    # a repeated text is looked at once, at its first document
    first = order.groupBy("digest", "octets").agg(F.min("rid").alias("rid"), F.min_by("row", "rid").alias("row"), F.count("*").alias("n"))
    first = materialize(first, "ld-first")

    keys = said.select("digest", "row", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("*").alias("n")).filter("low < high").select("key", "n")
    shared = materialize(shared, "ld-shared")
    mine = spread_join(keys, shared, ["key"], F.col("row")).groupBy("row").agg(F.collect_list("key").alias("keys"))
    mine = materialize(mine.join(first.select("row", "rid"), "row"), "ld-keys")
    meet = sieve(mine, "row")
    some = sieved(said, "row", meet, "meets").filter("meets")
    lines = materialize(some.select("row", "marks", "sizes").join(mine.select("row", "rid"), "row").drop("row"), "ld-lines")
    blocks = line_blocks(mine, lines, least_words)
    per = materialize(blocks.groupBy("rid").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.collect_set("lead").alias("leads")), "ld-ranges")
    inside = some.select("row", "hashes", "sizes").join(mine, "row").join(per.select("rid", "ranges"), "rid", "left")
    inside = word_runs(inside.select("rid", "hashes", "sizes", "keys", "ranges"), least_words)

    # copies of a text lose all lines; like its first document they owe them to that one's donors, and to it
    firsts = per.withColumnRenamed("leads", "of_lines").join(inside, "rid", "full").select(
        "rid", "ranges", "runs", F.array_union(F.coalesce("of_lines", F.array().cast(longs)), F.coalesce("leads", F.array().cast(longs))).alias("leads"), F.lit(False).alias("whole")
    )
    firsts = materialize(firsts, "ld-firsts")
    copied = first.filter("n > 1").select("digest", "octets", "n", F.col("rid").alias("of")).join(firsts.select(F.col("rid").alias("of"), "leads"), "of", "left")
    copied = materialize(copied.select("digest", "octets", "n", "of", F.array_union(F.array("of"), F.coalesce("leads", F.array().cast(longs))).alias("leads")), "ld-copied")
    copies = spread_join(order.filter(F.col("words") >= least_words).select("rid", "digest", "octets"), copied, ["digest", "octets"], F.col("rid")).filter("rid <> of")
    copies = copies.select("rid", F.lit(None).cast(ints).alias("ranges"), F.lit(None).cast(ints).alias("runs"), "leads", F.lit(True).alias("whole"))
    gone = materialize(firsts.unionByName(copies), "ld-gone")
    owed = gone.select("rid", F.explode("leads").alias("lead"))
    names = owed.groupBy("lead").agg(F.count("*").alias("n")).join(order.select(F.col("rid").alias("lead"), F.struct("id").alias("donor")), "lead")
    names = materialize(names, "ld-names")
    donors = spread_join(owed, names, ["lead"], F.col("rid")).groupBy("rid").agg(F.sort_array(F.collect_set("donor")).alias("donors"))
    out = gone.drop("leads").join(order.select("rid", "id", "digest", "n"), "rid").join(donors, "rid")
    out = out.select(F.xxhash64("id").alias("place"), "digest", "n", "whole", "ranges", "runs", F.col("donors.id").cast(T.ArrayType(kind)).alias("donors"))
    out = materialize(out, "ld-deletions")
    discard(said, order, first, shared, mine, lines, blocks, per, inside, firsts, copied, gone, names)
    return out


def dedup_lines(docs: DataFrame, key: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """``row`` (the row of ``docs`` with what is left of its ``text``), ``n_lines``, ``n_removed``,
    ``removed`` (ranges of line numbers from 0, end exclusive), ``cut`` (line and range of words of
    lines that go in part; ``n_removed`` counts whole lines) and ``donors`` (keys of the earlier
    documents that keep what is removed).

    Documents are ordered by key, null keys last; rows that repeat both key and text are one
    document and are treated alike, rows that repeat a key only are ordered by a hash of their text.
    Documents that repeat an earlier text of ``least_words`` words or more lose all of it. Lines
    compare by hashes of their words, so white space does not matter; blank lines align but start no
    run. Null texts stay null and have no lines. A text whose lines all go becomes empty.
    Extra columns pass through. An empty table gives no rows.
    """
    gone = deletions(docs.select(F.col(key).alias("id"), "text"), least_words)
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(key).alias("place"), _digest(F.col("text")).alias("digest"))
    rows = sieved(rows, "digest", sieve(gone, "digest"), "loses")
    met = spread_join(rows.filter("loses"), gone, ["place", "digest"], F.rand(1), "left")
    before, none = F.col("row.text"), F.array().cast(T.ArrayType(docs.schema[key].dataType))
    loses, whole = F.col("whole").isNotNull(), F.coalesce("whole", F.lit(False))
    lines = F.coalesce(F.octet_length(before) - F.octet_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    left = _cut(least_words)(F.when(loses & ~whole, before), "ranges", "runs")
    text = F.when(whole, F.lit("")).when(loses, F.col("left.text")).otherwise(before)
    met = met.withColumn("n_lines", lines).withColumn("left", left).select(
        "row", "n_lines", text.alias("text"), F.when(whole, F.col("n_lines")).otherwise(F.col("left.n_removed")).alias("n_removed"),
        F.when(whole, F.concat(F.lit("0-"), F.col("n_lines").cast("string"))).otherwise(F.col("left.removed")).alias("removed"), "left.cut", F.coalesce("donors", none).alias("donors"),
    )
    apart = rows.filter("not loses").select(
        "row", lines.alias("n_lines"), before.alias("text"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("removed"), F.lit("").alias("cut"), none.alias("donors")
    )
    out = met.unionByName(apart)
    return out.select(F.col("row").withField("text", F.col("text")).alias("row"), "n_lines", "n_removed", "removed", "cut", "donors")


def deduplicated(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents themselves, with the columns of ``docs``: shared lines and words deleted, ``n_chars`` (if there)
    following, and documents that deletion left without a word left out."""
    out = dedup_lines(docs, key)
    row = F.col("row")
    changed = (F.col("n_removed") > 0) | (F.col("cut") != "")
    if "n_chars" in docs.columns:
        row = F.when(changed, row.withField("n_chars", F.length(row["text"]).cast(docs.schema["n_chars"].dataType))).otherwise(row)
    emptied = changed & ~F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))
    return out.filter(~emptied).select(row.alias("row")).select("row.*")


def op1(spark, sf_dir: str) -> DataFrame:
    """All documents with the lines and words that an earlier one keeps deleted."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "removed", "cut", "donors",
        F.length(text).cast("long").alias("n_chars_left"), F.sha2(text.cast("binary"), 256).alias("text_sha256"),
    )
