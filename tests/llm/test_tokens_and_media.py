"""BPE against a public library, MPEG streams against damage, both against odd rows."""

import base64
import gc
import hashlib
import random
import subprocess
import sys
import weakref
import zlib
from pathlib import Path

import public_tokenizers
import pytest
import regex
import tiktoken

from tessera.llm import bpe, mpeg_audio

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer(bpe.load_ranks(PATH), PATTERN)


def test_perfect_hash_is_minimal_and_rejects_others(tokenizer):
    table, ranks = tokenizer.table, tokenizer.ranks
    assert len(table.keys) == len(ranks) and None not in table.keys
    assert all(table.get(key) == i for key, i in list(ranks.items())[::97])
    assert table.get(b"surely no token of the vocabulary") == -1
    assert bpe.PerfectHash({}).get(b"x") == -1


def test_same_ids_as_the_library(tokenizer, library):
    draw = random.Random(5)
    texts = ["".join(draw.choice("ab cAB'\n\r\t 12!?é \u0085\u001c中\U0001f642ßs") for _ in range(draw.randint(0, 80))) for _ in range(400)]
    texts += ["x" * 5000, "ab" * 3000, " " * 3000, "<|endoftext|>"]
    for text in texts:
        ids = tokenizer.encode(text)
        assert ids == library.encode_ordinary(text)
        assert tokenizer.decode(ids) == text.encode()


def test_bpe_over_odd_rows(spark, edge, edge_rows, empty, library):
    got = bpe.round_trip(edge, PATH, PATTERN, with_ids=True).collect()
    want = []
    for row in edge_rows:
        text = row[1] or ""
        ids = library.encode_ordinary(text)
        want.append((row[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.round_trip(empty, PATH, PATTERN).count() == 0
    coded = bpe.decode(bpe.encode(edge, PATH, PATTERN, out="size"), PATH, PATTERN, ids="size", out="row").select("text", "row").collect()
    assert all(bytes(r["row"]) == (r["text"] or "").encode() for r in coded)


def test_media_round_trip_over_odd_rows(spark, edge, edge_rows, empty):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in mpeg_audio.read_back(mpeg_audio.stored(edge)).collect()}
    for row in edge_rows:
        raw = (row[1] or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        r = got[row[0], hashlib.sha256(padded).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(padded), zlib.crc32(padded[-16:]))
        assert f"frames={len(padded) // 192};" in r["feature"] and "skipped=0" in r["feature"]
        n = len(padded) // 192
        assert (r["duration"], r["samples"]) == (n * 1152 / 48000, n * 1152)
        assert r["seek"] == [r["media_bytes"] - 240 * (n - k) for k in range(n)]
    assert mpeg_audio.read_back(mpeg_audio.stored(empty)).count() == 0
    rows = mpeg_audio.probe(spark.createDataFrame([(None, 1), (b"", 2), (b"no audio", 3)], "media binary, frames int")).collect()
    assert all(r["frames"] == 0 and r["duration"] == 0 for r in rows)


def test_stream_is_walked_through_damage():
    raw = bytes(random.Random(2).choice(b"abcdefgh \xff\xfb") for _ in range(192 * 40))
    data = mpeg_audio.encode(raw)
    whole = mpeg_audio.parse(data)
    assert mpeg_audio.payload(data, whole) == raw and whole.samples == 40 * 1152 and whole.duration == 40 * 1152 / 48000
    assert whole.crc_ok == 40 and whole.crc_bad == 0 and whole.table["frames"] == 40
    assert list(whole.offsets[1:] - whole.offsets[:-1]) == [240] * 39
    hurt = bytearray(data)
    at = int(whole.offsets[10])
    hurt[at : at + 4] = b"\0\0\0\0"
    assert len(mpeg_audio.parse(bytes(hurt)).offsets) == 39
    hurt = bytearray(data)
    hurt[int(whole.offsets[5]) + 8] ^= 1  # side information: the checksum tells
    assert mpeg_audio.parse(bytes(hurt)).crc_bad == 1
    cut = mpeg_audio.parse(data[: int(whole.offsets[20]) + 100])
    assert len(cut.offsets) == 20 and cut.skipped == 100
    framed = mpeg_audio.parse(b"noise" * 7 + data + b"TAG" + bytes(125))
    assert len(framed.offsets) == 40 and framed.skipped == 35 and ("id3v1", 128) in framed.tags


def test_headers_of_all_layers():
    assert mpeg_audio.header(0xFFFB9064).length == 417  # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz
    assert mpeg_audio.header(0xFFFB9264).length == 418  # padded
    assert mpeg_audio.header(0xFFFDA404).length == 576  # Layer II, 192 kbit/s, 48 kHz
    assert mpeg_audio.header(0xFFF38064).samples == 576  # MPEG-2 Layer III
    for bad in (0xFFFBF064, 0xFFFB9C64, 0xFFEB9064, 0x00000000, 0xFFF99064):
        assert mpeg_audio.header(bad) is None or bad == 0xFFF99064


def test_any_bytes_parse():
    draw = random.Random(9)
    for _ in range(300):
        data = bytes(draw.choice([0xFF, 0xFB, 0x90, 0x64, 0, 0x49, 0x44, 0x33, draw.randrange(256)]) for _ in range(draw.randint(0, 900)))
        stream = mpeg_audio.parse(data)
        assert len(stream.offsets) == len(stream.lengths) and stream.skipped <= len(data)


def test_payload_that_looks_like_a_closing_tag():
    for raw in (b"x" * 89 + b"TAG", b"y" * 192 * 3 + b"x" * 89 + b"TAG and more"):
        raw = mpeg_audio.pad(raw)
        data = mpeg_audio.encode(raw)
        assert data[-128:-125] == b"TAG"
        stream = mpeg_audio.parse(data)
        assert mpeg_audio.payload(data, stream) == raw and stream.skipped == 0 and [name for name, _ in stream.tags] == ["id3v2"]
        tagged = data + b"TAG" + bytes(125)
        stream = mpeg_audio.parse(tagged)
        assert mpeg_audio.payload(tagged, stream) == raw and ("id3v1", 128) in stream.tags
        short = mpeg_audio.parse(data[:-50] + b"TAG" + bytes(125))  # the last frame is cut off by a real tag
        assert len(short.offsets) == len(raw) // 192 - 1 and ("id3v1", 128) in short.tags


def written(fields):
    """Bits of (width, value) fields, most significant first."""
    return "".join(format(value, f"0{width}b") for width, value in fields)


def checksum(bits):
    """CRC-16 one bit after the other, by polynomial division."""
    crc = 0xFFFF
    for bit in bits:
        top = crc >> 15 & 1
        crc = crc << 1 & 0xFFFF
        if top ^ int(bit):
            crc ^= 0x8005
    return crc


def frame(layer, rate_no, kbps_no, mode, mode_extension, body, covered, length, version=3, wrong=0):
    """A protected frame: header, checksum over the header's last bits and ``covered``, then ``body``."""
    head = written([(11, 0x7FF), (2, version), (2, 4 - layer), (1, 0), (4, kbps_no), (2, rate_no), (1, 0), (1, 0), (2, mode), (2, mode_extension), (1, 0), (1, 0), (2, 0)])
    bits = head + written([(16, checksum(head[16:] + covered) ^ wrong)]) + body
    return int(bits.ljust(8 * length, "1"), 2).to_bytes(length, "big")


def test_checksums_of_layers_1_and_2_in_streams_made_by_hand():
    draw = random.Random(3)

    def layer_2(widths, channels, bound, rate_no, kbps_no, mode, extension, length, wrong=0, version=3):
        allocation, selected = [], 0
        for band, width in enumerate(widths):
            for _ in range(channels if band < bound else 1):
                value = draw.choice([0, 0, draw.randrange(1 << width)])
                allocation.append((width, value))
                selected += (value > 0) * (channels if band >= bound else 1)
        covered = written([*allocation, *[(2, draw.randrange(4)) for _ in range(selected)]])
        return frame(2, rate_no, kbps_no, mode, extension, covered, covered, length, version, wrong)

    long, short = [4] * 11 + [3] * 12 + [2] * 7, [4] * 2 + [3] * 6
    cases = [
        (lambda wrong: layer_2(long, 2, 30, 0, 10, 0, 0, 144 * 192000 // 44100, wrong), 1152, 44100),  # 192 kbit/s, stereo
        (lambda wrong: layer_2(long, 2, 8, 0, 11, 1, 1, 144 * 224000 // 44100, wrong), 1152, 44100),  # 224, joint
        (lambda wrong: layer_2(long[:27], 1, 27, 1, 4, 3, 0, 144 * 64000 // 48000, wrong), 1152, 48000),  # 64, one channel
        (lambda wrong: layer_2(short, 1, 8, 1, 1, 3, 0, 144 * 32000 // 48000, wrong), 1152, 48000),  # 32, one channel
        (lambda wrong: layer_2([4] * 2 + [3] * 10, 1, 12, 2, 2, 3, 0, 144 * 48000 // 32000, wrong), 1152, 32000),  # 48 at 32 kHz
        (lambda wrong: layer_2([4] * 4 + [3] * 7 + [2] * 19, 2, 30, 1, 8, 0, 0, 144 * 64000 // 24000, wrong, 2), 1152, 24000),  # half rate
    ]

    def layer_1(wrong, channels, bound, kbps_no, mode, extension, length):
        covered = written([(4, draw.randrange(15)) for band in range(32) for _ in range(channels if band < bound else 1)])
        return frame(1, 2, kbps_no, mode, extension, covered + "01" * 40, covered, length, 3, wrong)

    cases += [
        (lambda wrong: layer_1(wrong, 2, 8, 4, 1, 1, 12 * 128000 // 32000 * 4), 384, 32000),
        (lambda wrong: layer_1(wrong, 1, 32, 2, 3, 0, 12 * 64000 // 32000 * 4), 384, 32000),
    ]
    for make, samples, rate in cases:
        frames = [make(0x10 if k == 4 else 0) for k in range(9)]
        data = b"ID3\x04\0\0\0\0\0\x05hello" + b"".join(frames[:6]) + b"\0lost\0" + b"".join(frames[6:]) + b"TAG" + bytes(125)
        stream = mpeg_audio.parse(data)
        starts = [15 + sum(map(len, frames[:k])) + (6 if k >= 6 else 0) for k in range(9)]
        assert list(stream.offsets) == starts and list(stream.lengths) == [len(f) for f in frames]
        assert (stream.crc_ok, stream.crc_bad, stream.skipped) == (8, 1, 6)
        assert (stream.samples, stream.duration) == (9 * samples, 9 * samples / rate)
        assert [name for name, _ in stream.tags] == ["id3v1", "id3v2"]


def test_tables_in_streams_made_by_hand():
    plain = bytes.fromhex("fffb9064") + bytes(413)
    xing = bytearray(plain)
    xing[36:120] = (b"Xing" + (7).to_bytes(4, "big") + (5).to_bytes(4, "big") + (417 * 6).to_bytes(4, "big") + bytes(range(100)))[:84]
    vbri = bytearray(plain)
    vbri[36:54] = b"VBRI" + bytes(6) + (417 * 6).to_bytes(4, "big") + (5).to_bytes(4, "big")
    for first, kind in ((bytes(xing), "Xing"), (bytes(vbri), "VBRI")):
        ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (32).to_bytes(4, "little") + bytes(16)
        stream = mpeg_audio.parse(first + plain * 5 + ape)
        assert (stream.table["kind"], stream.table["frames"], stream.table["bytes"]) == (kind, 5, 417 * 6)
        assert list(stream.offsets) == [417 * k for k in range(1, 6)] and stream.duration == 5 * 1152 / 44100 and stream.tags == (("ape", 32),)
    free = bytes.fromhex("fffb0064") + bytes(413)
    assert mpeg_audio.parse(free * 4).skipped == 4 * 417 and not len(mpeg_audio.parse(free * 4).offsets)


def test_memo_is_bounded_by_bytes(tokenizer, library, monkeypatch):
    """Long pre-tokens of many ids fill a generation before their number does."""
    monkeypatch.setattr(bpe, "MEMO_BYTES", 1 << 20, raising=False)
    own = bpe.Tokenizer(tokenizer.ranks, PATTERN, tokenizer.table)
    draw, held = random.Random(9), lambda memo: sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in memo.items())
    for _ in range(30):
        text = " ".join("".join(draw.choice("qxzjkvw中é") for _ in range(60)) for _ in range(200))
        assert own.encode(text) == library.encode_ordinary(text)
        assert held(own.memo) + held(own.memo.older) < (2 << 20) + 10_000
    assert len(own.memo) and len(own.memo.older)


def test_a_task_gives_back_what_it_freed():
    """Many small buffers, freed below one that stays, would remain with the worker."""
    code = """
import numpy as np
from tessera.llm.common import tidied
size = lambda: next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon")) >> 10
stay = []
def run(batches):
    for batch in batches:
        many = [np.ones(60_000, np.uint8) for _ in range(4000)]
        stay.append(np.ones(60_000, np.uint8))
        yield len(many)
        del many
before = size()
assert list(tidied(run)(iter([0, 1]))) == [4000, 4000]
assert size() < before + 60, (before, size())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=Path(__file__).parents[2])


def test_a_tokenizer_goes_without_a_search_for_cycles(tokenizer):
    """Else a worker keeps the tables and the memo of a stage that is over."""
    own = bpe.Tokenizer(tokenizer.ranks, PATTERN, tokenizer.table)
    own.encode("some text, and unheardofwords")
    there, on = weakref.ref(own.memo), gc.isenabled()
    gc.disable()
    try:
        del own
        assert there() is None
    finally:
        if on:
            gc.enable()


def test_remembered_pre_tokens_take_few_bytes(tokenizer, library):
    """Each pre-token that has to be worked out again costs more than all that is done with the others."""
    own = bpe.Tokenizer(tokenizer.ranks, PATTERN, tokenizer.table)
    draw = random.Random(3)
    text = " ".join("".join(draw.choice(["th", "er", "an", "in", "on", "sh"]) for _ in range(4)) for _ in range(2000))
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text)
    assert len(own.memo) > 500
    assert all(sys.getsizeof(own.memo[t]) <= 33 + 2 * len(library.encode_ordinary(t)) for t in list(own.memo))


def test_merges_by_a_plain_loop():
    """Vocabularies whose merges skip ranks, lack bytes or hold tokens that no merge reaches."""

    def plain(piece, ranks):
        parts = [bytes((a,)) for a in piece]
        while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts] if all(p in ranks for p in parts) else None

    def own(piece, pairs):
        try:
            return bpe.merge_bytes(piece, pairs)
        except KeyError:
            return None

    draw = random.Random(8)
    for _ in range(300):
        tokens = {bytes((a,)) for a in draw.sample(b"abc", draw.randint(1, 3))}
        tokens |= {bytes(draw.choice(b"abc") for _ in range(draw.randint(2, 5))) for _ in range(draw.randint(0, 14))}
        ranks = dict(zip(draw.sample(sorted(tokens), len(tokens)), sorted(draw.sample(range(40), len(tokens)))))
        pairs = bpe.Pairs(ranks)
        for n in range(15):
            piece = bytes(draw.choice(b"abc") for _ in range(n))
            assert own(piece, pairs) == plain(piece, ranks), (piece, ranks)


def test_large_and_empty_vocabularies():
    ranks = {bytes((a,)): a for a in range(256)} | {b"ab": 70_000, b" a": 300, b" ab": 99_999}
    own = bpe.Tokenizer(ranks, PATTERN)
    ids = own.array("ab ab b")
    assert ids.tolist() == own.encode("ab ab b") == [70_000, 99_999, 32, 98] and own.written(ids) == b"70000 99999 32 98"
    assert own.decode(ids.tolist()) == b"ab ab b"
    with pytest.raises(KeyError):
        own.decode([100_000])
    none = bpe.Tokenizer({}, PATTERN)
    assert none.encode("") == none.encode(None) == [] and none.written(none.array("")) == b""
    with pytest.raises(KeyError):
        none.encode("a")
    assert bpe.Tokenizer(ranks, "x").encode("no match") == []


def test_ascii_texts_are_split_alike(tokenizer):
    draw = random.Random(4)
    texts = ["".join(chr(draw.randrange(128)) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(draw.choice(" \t\n\x0b\x1c\x1f\r'sdltverAZ09_.-") for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    assert tokenizer.split_ascii is not tokenizer.split
    assert all(tokenizer.split_ascii(t) == tokenizer.split(t) for t in texts)
    for same in (r"[^\s\p{L}']+|\S", r"(?:ab|a)++ ?|\s+(?!\S)|\p{N}"):
        there = regex.compile(same.replace(r"\s", r"\t-\r " if "[" in same else r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]")).findall
        assert all(bpe.ascii_splitter(same)(t) == there(t) for t in texts)
    for other in (r"\w+", r"[a-z]+", r"\p{Lu}", r"(?i)a", r"[[a]]", r"a{2}", r"[\S]", r"(?<=a)b", r".", r"\P{L}"):
        assert bpe.ascii_splitter(other) is None
