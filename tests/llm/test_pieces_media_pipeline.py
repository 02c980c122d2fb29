import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cogspark.llm import pieces, transport_stream

from .fixtures import documents, frame

needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="the vocabulary file is not here")


def brute_viterbi(v, text):
    score, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - v.longest), end):
            hit = v.pieces.get(text[start:end])
            if hit is not None:
                s, ids = score[start] + hit[1], (hit[0],)
            elif end - start == 1:
                s, ids = score[start] + v.floor, pieces._fallback(v, text[start])
            else:
                continue
            if s > score[end]:
                score[end], back[end] = s, (start, ids)
    out, at = [], len(text)
    while at:
        out = [*back[at][1], *out]
        at = back[at][0]
    return out


@needs_model
def test_pieces_match_full_viterbi():
    v = pieces.Vocabulary(open(pieces.MODEL, "rb").read())
    rng = random.Random(1)
    texts = [d[1] for d in documents() if d[1]] + ["  two  marks ", "日本語😀\x00\n\t", "a" * 700, "   ", "▁x"]
    texts += ["".join(rng.choice("theingsr aé.\n") for _ in range(200)) for _ in range(20)]
    for t in texts:
        t = t[:4000]
        marked = pieces.MARK + t.replace(" ", pieces.MARK)
        want = brute_viterbi(v, marked)
        assert pieces.encode_text(v, t) == want
        assert pieces.encode_text(v, t, window=3 * v.longest) == want
        assert pieces.decode_ids(v, want) == t.replace("▁", " ")
    together, at = pieces.encode_texts(v, [None, *texts, ""])
    assert [together[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [[], *(pieces.encode_text(v, t) for t in texts), []]
    assert pieces.encode_text(v, "") == [] and pieces.decode_ids(v, [-5, 10**6]) == ""


@needs_model
def test_streaming_commits_early():
    v = pieces.Vocabulary(open(pieces.MODEL, "rb").read())
    points = np.array([ord(x) for x in (pieces.MARK + "window") * 5000])
    stream = pieces.viterbi(v, v.numbers(points), window=100)
    end, ids = next(stream)  # long before the end of the text
    assert 0 < len(ids) <= 100 and end[-1] <= 100 and len(ids) + sum(len(x) for _, x in stream) > 4999
    # paths over an even and an odd number of letters never meet: the window is widened up to the end
    ends = [e for e, _ in pieces.viterbi(v, v.numbers(np.full(1000, ord("a"))), window=20)]
    assert len(ends) == 1 and ends[0][-1] == 1000


@needs_model
def test_encode_and_decode_columns(spark):
    df = frame(spark).withColumn("ids", F.lit("clash"))
    out = pieces.decode(pieces.encode(df))
    assert [c for c in out.columns if c not in ("ids", "decoded")] == [c for c in df.columns if c != "ids"]
    for r in out.collect():
        assert r["decoded"] == r["text"] and (r["ids"] is None) == (r["text"] is None)
    digest = pieces.piece_digest(df).collect()
    assert len(digest) == df.count() and all(r["round_trip"] for r in digest)
    assert pieces.encode(df.limit(0)).count() == 0


def test_media_digest(spark):
    rows = [(d[0], d[1]) for d in documents()] + [(500, "q" * 20000), (501, "x" * 576), (502, "y" * (576 * 16)), (503, "z" * (576 * 16 * 5 + 1))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, feature string")
    got = sorted(map(tuple, transport_stream.media_digest(df).collect()), key=str)
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        media = transport_stream.write_stream(p)
        s = transport_stream.read_stream(media)
        assert not s.error and s.payload == p and s.lost == s.repeated == 0 and len(media) % 188 == 0
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), transport_stream.feature_text(s)))
    assert got == sorted(want, key=str)
    assert transport_stream.media_digest(df.limit(0)).count() == 0


def plain_reader(media):
    """A packet reader of its own, field by field from the standard: payload, time stamps, clocks, random-access units, programs."""
    bits = lambda data, lo, n: int.from_bytes(data, "big") >> (8 * len(data) - lo - n) & ((1 << n) - 1)

    def crc(data):
        x = 0xFFFFFFFF
        for b in data:
            for k in range(7, -1, -1):
                top = (x >> 31) ^ (b >> k & 1)
                x = (x << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
        return x

    assert len(media) % 188 == 0
    counters, programs, streams, units, flags, clocks = {}, {}, {}, [], [], []
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        assert bits(p, 0, 8) == 0x47 and bits(p, 8, 1) == 0 and bits(p, 24, 2) == 0
        begins, pid, field, has, count = bits(p, 9, 1), bits(p, 11, 13), bits(p, 26, 1), bits(p, 27, 1), bits(p, 28, 4)
        assert has and count == counters.get(pid, count)
        counters[pid] = (count + 1) % 16
        start, random = 4, 0
        if field:
            size = p[4]
            start = 5 + size
            if size:
                random = bits(p, 41, 1)
                if bits(p, 43, 1):
                    clocks.append(bits(p, 48, 33))
        body = p[start:]
        if pid == 0 or pid in programs.values():
            table = body[1 + body[0] :]
            size = bits(table, 12, 12)
            table = table[: 3 + size]
            assert crc(table) == 0
            if pid == 0:
                programs[bits(table, 64, 16)] = bits(table, 83, 13)
            else:
                skip = bits(table, 84, 12)
                streams[bits(table, 96 + 8 * skip + 11, 13)] = table[12 + skip]
        else:
            assert pid in streams
            if begins:
                units.append(b"")
                flags.append(random)
            units[-1] += body
    payload, stamps = b"", []
    for u in units:
        assert u[:3] == b"\x00\x00\x01" and bits(u, 48, 2) == 2 and bits(u, 56, 2) == 2
        n = int.from_bytes(u[4:6], "big")
        assert n in (0, len(u) - 6)
        stamps.append(bits(u, 76, 3) << 30 | bits(u, 80, 15) << 15 | bits(u, 96, 15))
        payload += u[9 + u[8] :]
    return payload, stamps, clocks, flags, programs, streams


def test_streams_are_read_alike_by_a_plain_reader():
    ts = transport_stream
    for raw in (b"", b"abc", bytes(range(256)) * 9, b"q" * 20000, b"z" * (576 * 16 * 9 + 1)):
        p = ts.padded(raw)
        payload, stamps, clocks, flags, programs, streams = plain_reader(ts.write_stream(p))
        s = ts.read_stream(ts.write_stream(p))
        assert payload == p == s.payload and stamps == clocks == s.stamps == [k * ts.TICKS for k in range(-(-len(p) // ts.UNIT))]
        assert [k for k, f in enumerate(flags) if f] == s.random_access == list(range(0, len(stamps), ts.RANDOM_ACCESS))
        assert programs == s.programs and streams == s.streams


def test_media_columns(spark):
    df = frame(spark).select("doc_id", "text", F.lit(1).alias("media"))
    out = transport_stream.parse_media(transport_stream.store_media(df, "text"))
    for r in out.collect():
        raw = (r["text"] or "").encode()
        assert r["ts_error"] == "" and bytes(r["ts_payload"]) == transport_stream.padded(raw)
        assert r["ts_stamps"] == [i * transport_stream.TICKS for i in range(len(r["ts_stamps"]))]
        assert r["ts_random_access"] == list(range(0, len(r["ts_stamps"]), transport_stream.RANDOM_ACCESS))


def test_damaged_streams():
    p = transport_stream.padded(b"abc" * 9000)
    media = transport_stream.write_stream(p)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    lost = transport_stream.read_stream(b"".join(packets[:20] + packets[21:]))
    assert lost.lost == 1 and lost.repeated == 0
    twice = transport_stream.read_stream(b"".join(packets[:20] + [packets[19]] + packets[20:]))
    assert twice.lost == 0 and twice.repeated == 1 and twice.payload == p
    assert transport_stream.read_stream(None).error and transport_stream.read_stream(b"x" * 188).error and transport_stream.read_stream(b"x").error
    assert transport_stream.read_stream(b"".join(packets[2:])).error
    broken = bytearray(media)
    broken[20] ^= 1  # in the first table
    assert transport_stream.read_stream(bytes(broken)).error


@needs_model
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    docs = documents(n=90)
    rows = [(d[0], d[1], d[2], d[3], d[4]) for d in docs] + [(700 + i, " ".join(rng.choice(["awful", "plain", "word", "other"]) + str(rng.randint(0, 50)) for _ in range(40)), "en", "s1", 9) for i in range(40)]
    rows = [(i, (t + " awfulness here" if i is not None and i >= 700 and i % 2 else t), a, b, c) for i, t, a, b, c in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 700 and i % 2 == 1)) for i in [*range(0, 90), *range(700, 740)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = at
        if name != "sentencepiece":
            assert at.columns == df.columns
    toxic = {i for i in range(700, 740) if i % 2}
    left = {r["doc_id"] for r in kept["toxicity"].collect()}
    assert len(toxic & left) <= 2 and set(range(90)) <= left
    near = [r["doc_id"] for r in kept["ngram_jaccard_join"].collect()]
    assert near.count(3) == 1 and not {200, 201, 101, 102, 103, 104, 105} & set(near) and {0, 1, 2, 100, 300, 301, 302, 303} <= set(near)
    assert kept["suffix_array_dedup"].count() == len(near)
    before, after = ({r["doc_id"]: len(r["text"] or "") for r in kept[k].collect()} for k in ("ngram_jaccard_join", "suffix_array_dedup"))
    assert all(after[i] <= before[i] for i in after) and sum(after.values()) < sum(before.values())
    assert kept["sentencepiece"].count() == kept["source_mixing"].count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept["sentencepiece"].count()
