"""WARC, MPEG audio and decontamination: exact round trips and brute force."""

import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm.decontam import FmIndex, Scanner, Windows, contaminated, find_contamination, op6_decontamination, suffix_order
from lexmill.llm.mpeg_audio import RATE, Header, Stream, crc16, encode, op8_mpeg_audio, padded
from lexmill.llm.warc import op3_warc, read_archives, read_records, record, resolve_revisits, write_archives

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def brute_hits(texts, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    out = []
    for t in texts:
        w, found = words(t), set()
        hit = [0] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    found |= own
                    hit[k : k + n] = [1] * n
        out.append((len(w), sum(hit), sorted(found)))
    return out


def scan(texts, items):
    got = Scanner(Windows(items)).batch(pa.array(texts, pa.string()))
    return [(n, h, sorted(i)) for n, h, i in zip(got["n_words"], got["n_hit"], got["items"], strict=True)]


def test_scan_against_brute_force():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(80)] + [None, "", "A-b,C"]
    items = [(k, " ".join(rng.choice("abcdefg") for _ in range(n))) for k, n in enumerate([1, 2, 3, 5, 13, 14, 20, 6])] + [(50, None), (51, "--"), (52, "a b"), (53, "A b")]
    copies = texts[:20]
    texts += [f"{t} {items[6][1]} {t}" for t in copies] * 3
    assert scan(texts, items) == brute_hits(texts, items)
    assert scan(texts, []) == [(n, 0, []) for n, _, _ in brute_hits(texts, [])]


def test_suffix_order_and_search():
    rng = np.random.default_rng(2)
    parts = [rng.integers(1, 4, n) for n in (50, 7, 50, 1, 400)]
    parts[2] = parts[0]
    text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.int32)
    tail = [tuple(int(x) for x in text[i : i + int(np.flatnonzero(text[i:] == 0)[0]) + 1]) for i in range(len(text))]
    assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: (tail[i], i))
    index = FmIndex(text)

    class Own:
        lengths = np.array([3, 2, 5])
        symbols = np.array([[1, 2, 3, 0, 0], [3, 3, 0, 0, 0], [1, 1, 1, 2, 9]])

    which, low, high = index.search(Own)
    ranges, position = index.locate(low, high)
    got = sorted((int(which[r]), int(p)) for r, p in zip(ranges, position, strict=True))
    want = sorted((k, i) for k, p in enumerate(([1, 2, 3], [3, 3], [1, 1, 1, 2, 9])) for i in range(len(text)) if text[i : i + len(p)].tolist() == p)
    assert got == want


def test_decontamination_whole_table(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = dict(zip(docs, brute_hits(list(docs.values()), items), strict=True))
    for r in op6_decontamination(spark, small).collect():
        n, h, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, h, len(found), h > 0 and 20 * h >= n)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_decontamination_in_parts(spark, docs, monkeypatch):
    import lexmill.llm.decontam as d

    rng = random.Random(1)
    items = [(k, " ".join(rng.choice("abcd") for _ in range(15))) for k in range(20)]
    rows = docs([(1, None), (2, ""), (3, f"x {items[0][1]} y"), (4, items[3][1] + " " + items[4][1]), (5, items[3][1]), (5, items[3][1])])
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, find_contamination(rows, bench).select("doc_id", "hits.n_words", "hits.n_hit").collect()))
    monkeypatch.setattr(d, "PART_BYTES", 300)
    parts = find_contamination(rows, bench)
    assert sorted(map(str, parts.select("doc_id", "hits.n_words", "hits.n_hit").collect())) == whole
    assert set(rows.columns) < set(parts.columns)
    assert find_contamination(docs([]), bench).count() == 0
    assert find_contamination(rows, bench.limit(0)).filter(contaminated(__import__("pyspark").sql.functions.col("hits"))).count() == 0


def test_decontamination_parts_overlap(spark, docs, monkeypatch):
    import lexmill.llm.decontam as d

    w = [f"w{k}" for k in range(60)]
    items = [(1, " ".join(w[:20])), (2, " ".join(w[10:30])), (3, " ".join(w[30:44])), (4, " ".join(w[44:60])), (4, " ".join(w[40:55]))]
    rows = docs([(1, " ".join(w[:35])), (2, "x " + " ".join(w)), (3, " ".join(w[:20] + ["y"] + w[10:30])), (4, None), (5, "z " * 40 + " ".join(w[5:30]))])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((r.doc_id, r.hits.n_words, r.hits.n_hit, sorted(r.hits.items), r.hits.spans) for r in find_contamination(rows, bench).collect())
    whole = found()
    assert [r[2] for r in whole] == [30, 60, 40, 0, 25] and whole[1][3] == ["1", "2", "3", "4"]
    for size in (50, 250, 400):
        monkeypatch.setattr(d, "PART_BYTES", size)
        assert found() == whole


def test_decontamination_repeated_and_null_items(spark, docs, monkeypatch, tmp_path):
    """The SQL's rows for items of one id, without an id, of equal texts, and null; in one part and in many."""
    import duckdb

    import lexmill.llm.decontam as d

    w = [f"w{k}" for k in range(60)]
    items = [("a", " ".join(w[:20])), ("a", " ".join(w[10:30])), ("a", " ".join(w[:20])), (None, " ".join(w[40:55])), (None, " ".join(w[30:45])), ("b", " ".join(w[:20])), ("c", None), ("10", "solo"), ("9", "solo")]
    rows = [(1, " ".join(w)), (1, " ".join(w)), (2, " ".join(w[38:56])), (3, "Solo, z"), (4, None), (5, "z"), (None, " ".join(w[:13]))]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(d.OP6_SQL).fetchall(), key=str)
    for size in (1 << 20, 1000, 60):
        monkeypatch.setattr(d, "PART_BYTES", size)
        got = op6_decontamination(spark, str(tmp_path)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        got = sorted(map(tuple, got.collect()), key=str)
        assert got[:-1] == want[:-1] and got[-1][:4] == (None, 13, 13, 2)  # the SQL joins by doc_id


@pytest.mark.parametrize("bits", [3, 21])
def test_long_stretches_in_pieces(monkeypatch, bits):
    import lexmill.llm.decontam as d

    monkeypatch.setattr(d, "PIECE", 40)
    monkeypatch.setattr(d, "SHARD_SYMBOLS", 150)
    monkeypatch.setattr(d, "TABLE_BITS", bits)
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice("abcdefghijklmnop") for _ in range(n))) for k, n in enumerate([2, 13, 30, 60])]
    texts = [" ".join([rng.choice("abcdefghijklmnop") for _ in range(n)] + items[2 + n % 2][1].split() * 3) for n in (0, 1, 39, 40, 41, 500)]
    assert scan(texts, items) == brute_hits(texts, items)


def test_long_text(spark):
    items = [(1, " ".join(f"w{k}" for k in range(13)))]
    text = "z " * 600_000 + items[0][1] + " z" * 10
    assert scan([text], items) == [(600_023, 13, ["1"])]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 121, 122, 1417, 1418, 5000, 100_000])
def test_audio_round_trip(n):
    data = random.Random(n).randbytes(n)
    s = Stream(encode(padded(data)))
    assert s.payload == padded(data) and len(s.payload) % 64 == 0 < len(s.payload)
    assert (s.bad, s.skipped, s.table["frames"], s.samples) == (0, 0, len(s.seek), 1152 * len(s.seek))
    assert s.duration_us == s.samples * 1_000_000 // RATE


def test_audio_resynchronises():
    media = encode(padded(random.Random(1).randbytes(9000)))
    clean = Stream(media)
    at = clean.seek[3]
    damaged = Stream(media[:at] + b"\xff\xfa\x00zz\xff\xe0abc" + media[at:])
    assert (damaged.payload, damaged.skipped, damaged.bad) == (clean.payload, 10, 0)
    broken = Stream(media[: at + 8] + b"\x01" + media[at + 9 :])
    assert (broken.bad, len(broken.seek)) == (1, len(clean.seek))
    assert Stream(b"").seek == [] and Stream(b"\xff" * 5000).seek == []


def test_audio_headers():
    h = Header(bytes([0xFF, 0xFB, 0x90, 0x64]))
    assert (h.rate, h.kbits, h.length, h.samples, h.side, h.protected) == (44100, 128, 417, 1152, 32, False)
    for bad in (b"\xff\xe9\x90\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", b"\x00\xfb\x90\x00"):
        with pytest.raises(ValueError):
            Header(bad)
    assert crc16(b"123456789") == 0xAEE7


def test_audio_query(spark, small):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    seen = {}
    for r in op8_mpeg_audio(spark, small).collect():
        p = padded((text[r.doc_id] or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert seen.setdefault(text[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
        assert r.media_sha256 == hashlib.sha256(encode(p)).hexdigest()


def test_warc_query(spark, small):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    owner = {}
    for i, p in pages.items():
        owner[p] = max(i, owner.get(p, i))
    got = op3_warc(spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        p = pages[r.page_id]
        to = owner[p] if len(p) >= 1000 and owner[p] != r.page_id else None
        assert (r.payload_bytes, r.payload_digest, r.refers_to, r.record_type, r.error) == (len(p), hashlib.sha1(p).hexdigest(), to, "revisit" if to is not None else "response", None)


def test_warc_edge_cases(spark, tmp_path):
    big = "ñ" * 700
    rows = [(1, "u", big), (2, None, big), (3, "u\r\nX: y", None), (4, "", ""), (None, "u", big), (5, "u", "a" * 3_000_000), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    out = resolve_revisits(read_archives(write_archives(pages, folder), folder)).collect()
    got = sorted((r.id or "", r.type, r.refers_to or "", r.payload_bytes, r.error) for r in out)
    assert got == sorted([("1", "revisit", "2", 1400, None), ("2", "response", "", 1400, None), ("2", "response", "", 1400, None), ("3", "response", "", 0, None), ("4", "response", "", 0, None), ("null", "revisit", "2", 1400, None), ("5", "response", "", 3_000_000, None)])
    assert {r.url for r in out if r.id == "3"} == {"u%0D%0AX:%20y"}
    empty = str(tmp_path / "none")
    assert read_archives(write_archives(pages.limit(0), empty), empty).count() == 0


def test_warc_damage():
    a, b = (gzip.compress(record(str(k), "u", b"payload %d" % k, None, "d")) for k in (1, 2))
    read = lambda data: [(r.ident("warc-record-id"), r.payload, r.error) for r in read_records(io.BytesIO(data))]
    assert read(a + b) == [("1", b"payload 1", None), ("2", b"payload 2", None)]
    assert [e for *_, e in read(a + b[:-20])] == [None, "the archive ends within a member"]
    wrong = gzip.compress(record("1", "u", b"payload", None, "d").replace(b"payload\r\n", b"paYload\r\n"))
    assert [e for *_, e in read(wrong + b)] == ["block digest", None]
    assert [e for *_, e in read(gzip.compress(b"hello") + b)] == ["no record header", None]
    short = gzip.compress(record("1", "u", b"payload", None, "d")[:-8])
    assert [e for *_, e in read(short + b)] == ["content length", None]
    assert read(b"") == []


def test_warc_damage_within_a_member(monkeypatch):
    """One changed byte anywhere, a cut, or bytes between members: the records of all other members are read."""
    from lexmill.llm import warc

    rng = random.Random(4)
    members = [gzip.compress(record(str(k), "u", rng.randbytes(rng.choice([0, 40, 3000])), None, "d")) for k in range(5)]
    idents = lambda data: [r.ident("warc-record-id") for r in read_records(io.BytesIO(data)) if r.error is None]
    for chunk in (64, 1 << 16):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        for _ in range(150):
            k = rng.randrange(5)
            damaged = bytearray(members[k])
            damaged[rng.randrange(len(damaged))] ^= rng.randint(1, 255)
            data = b"".join([*members[:k], bytes(damaged), *members[k + 1 :]])
            assert [i for i in idents(data) if i != str(k)] == [str(j) for j in range(5) if j != k]
            cut = members[k][: rng.randrange(len(members[k]))]
            assert set(idents(b"".join([*members[:k], cut, *members[k + 1 :]]))) >= {str(j) for j in range(5) if j != k}
        assert idents(members[0] + b"\x1f\x8b\x08 no member " * 3 + members[1]) == ["0", "1"]
        assert [r.error is None for r in read_records(io.BytesIO(b"junk" * 50))] == [False]


def walk(media):
    """Frame offsets by the format's own formulas: MPEG-1 layer III after the ID3v2 tag, up to the ID3v1 tag; the first one is the table."""
    at = 10
    for b, shift in zip(media[6:10], (21, 14, 7, 0), strict=True):
        at += b << shift
    out, kbits = [], [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    while media[at] == 0xFF and media[at + 1] & 0xE0 == 0xE0:
        out.append(at)
        rate = [44100, 48000, 32000][media[at + 2] >> 2 & 3]
        at += 144 * kbits[media[at + 2] >> 4] * 1000 // rate + (media[at + 2] >> 1 & 1)
    assert media[at : at + 3] == b"TAG" and len(media) == at + 128
    return out[1:]


@pytest.mark.parametrize("n", [0, 100, 1500, 9000])
def test_audio_feature_against_the_format(n):
    media = encode(padded(random.Random(n).randbytes(n)))
    seek = walk(media)
    samples = 1152 * len(seek)
    crc = zlib.crc32(np.array(seek, "<i8").tobytes())
    assert Stream(media).feature() == f"frames={len(seek)};samples={samples};rate=32000;duration_us={samples * 1_000_000 // 32000};table_frames={len(seek)};bad=0;skipped=0;seek_crc32={crc}"
    assert Stream(media).seek == seek


def test_audio_edge_cases(spark, docs):
    """Nulls, repeated rows, long texts, columns of the results' names, and an empty table."""
    from pyspark.sql import functions as F

    from lexmill.llm.mpeg_audio import describe_audio, store_audio

    rows = docs([(1, None), (1, None), (2, ""), (3, "ñ" * 300_000)]).withColumn("media", F.lit("old")).withColumn("audio", F.lit(1))
    got = describe_audio(store_audio(rows)).collect()
    assert len(got) == 4 and {r.doc for r in got} == {"y"}
    for r in got:
        p = padded((r.text or "").encode())
        assert (r.audio.payload_bytes, r.audio.payload_sha256, r.audio.media_bytes) == (len(p), hashlib.sha256(p).hexdigest(), len(r.media))
    assert len({r.audio.media_sha256 for r in got if r.doc_id != 3}) == 1
    assert describe_audio(store_audio(docs([]))).count() == 0


def test_warc_tables_with_other_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "u", "a" * 1200), (2, "u", "a" * 1200)], "page_id long, url string, html string")
    odd = pages.withColumns({x: F.lit("x") for x in ("id", "payload", "digest", "owner", "n")})
    odd.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in op3_warc(spark, str(tmp_path)).collect())
    assert got == [(1, "revisit", 2), (2, "response", None)]
    (tmp_path / "none").mkdir()
    odd.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert op3_warc(spark, f"{tmp_path}/none").count() == 0
