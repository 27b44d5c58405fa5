"""URL filter, sharding, packing, mixing, media and token files: brute force, round trips and edge cases."""

import collections
import io
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandmap.llm import media, mixing, packing, sharding, tokens, urlfilter
from strandmap.llm.shared import word_count

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

# --- URL filter ---


def judged(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x?y#z", "http://anet/", "http://www.example.net/en/a", "http://example.net/en", "http://www.example.net:80/en/",
    "http://example.com/de/a?b://c/", "http://x.org/fr/", "http://x.org/FR/", "http://ÉÄ.net/é", "http://a..net/", "x://y://net/", "http://example.net?/en/", "http://.net/", "http://user@example.net/en/",
]


@pytest.mark.parametrize("ranges", [0, 1, 3])
def test_url_filter(spark, ranges):
    def judge(df, rules, **options):
        if not ranges:
            return urlfilter.judge(df, rules, **options)
        return urlfilter.judge_table(df, spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=ranges, **options)

    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(df, RULES).collect()}
    assert got == {i: judged(u) for i, u in enumerate(URLS + URLS)}
    assert judge(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in judge(df, [], default="block").collect()} == {"block"}
    long = spark.createDataFrame([(1, "http://" + "a." * 300_000 + "net/" + "x" * 300_000)], "page_id long, url string")
    assert [(len(r["host"]), len(r["path"]), r["rule"]) for r in judge(long, RULES).collect()] == [(600_003, 300_001, "net/")]


def test_digest_array(tmp_path, monkeypatch):
    many = [(f"h{i}.org", f"/{i % 7}", "block" if i % 2 else "allow") for i in range(500)]
    a = urlfilter.DigestArray(*urlfilter.build(many, str(tmp_path), "r"))
    assert all(a.stored(i) == (v, h + p) for (h, p, v), i in zip(many, a.find([h + p for h, p, _ in many]), strict=True)) and a.find(["none", ""]) == [-1, -1]
    # All strings share one digest: the stored strings decide.
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda b: 7)
    b = urlfilter.DigestArray(*urlfilter.build(many[:20], str(tmp_path), "c"))
    assert [b.stored(i)[1] for i in b.find([h + p for h, p, _ in many[:20]])] == [h + p for h, p, _ in many[:20]] and b.find(["x"]) == [-1]


# --- sharding ---


def sharded(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    return sharding.shard(df, **options).toPandas()


def check_slots(out):
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_sharding(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "x" * int(n), "c") for i, n in enumerate(rng.integers(0, 400, 3000))] + [(5000 + i, "same text " * 20, "c") for i in range(1500)] + [(None, None, None), (8000, "é" * 100, None)]
    out = sharded(spark, rows, shards=7)
    assert len(out) == len(rows) and (out["size"].sum()) == sum(len((t or "").encode()) + 16 for _, t, _ in rows)
    share = out["size"].sum() / 7
    assert (abs(out.groupby("shard")["size"].sum() - share) <= 0.021 * share + 416).all() and set(out["shard"]) == set(range(7))
    check_slots(out)
    # A group that fits lies in one shard, the large one in neighbours.
    n = out[out.text.notna()].groupby("text").shard.agg(["nunique", "min", "max", "size"])
    assert ((n["nunique"] == 1) | (n["size"] > 1000)).all() and (n["max"] - n["min"] + 1 == n["nunique"]).all()
    again = sharded(spark, rows[::-1], shards=7)
    key = ["doc_id", "shard", "slot"]
    assert out[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_sharding_edges(spark):
    assert len(sharded(spark, [], shards=3)) == 0
    out = sharded(spark, [(1, "a", "c")], shards=40)
    assert len(out) == 1 and out.slot[0] == 0 and 0 <= out.shard[0] < 40
    same = sharded(spark, [(1, "a", "c")] * 50, shards=4)
    assert len(same) == 50
    check_slots(same)
    one = sharded(spark, [(i, "b", "c") for i in range(4000)], shards=4, ranges=2)
    check_slots(one)
    assert one.groupby("shard").size().between(980, 1020).all()


# --- packing ---


def brute_padding(lengths, buckets):
    """Least padding of sorted lengths in at most so many buckets."""
    values = sorted(set(lengths))
    count = collections.Counter(lengths)
    best = {0: 0}
    for _ in range(buckets):
        now = dict(best)
        for i, base in best.items():
            for j in range(i + 1, len(values) + 1):
                cost = base + sum((values[j - 1] - v) * count[v] for v in values[i:j])
                now[j] = min(now.get(j, 1 << 60), cost)
        best = now
    return best[len(values)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=30), st.integers(1, 5))
def test_borders_are_optimal(lengths, buckets):
    values = sorted(set(lengths))
    n = np.array([lengths.count(v) for v in values], float)
    ends = packing.borders(n, n * values, np.array(values, float), buckets)
    assert ends[-1] == len(values) - 1 and len(ends) <= buckets
    upper = {v: values[next(e for e in ends if e >= i)] for i, v in enumerate(values)}
    assert sum(upper[v] - v for v in lengths) == brute_padding(lengths, buckets)


def test_packing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(n), "c") for i, n in enumerate([*rng.geometric(0.01, 3000), *[77] * 2000, 100_000, 0])] + [(None, None, None), (3, 3, "c"), (3, 3, "c")]
    df = spark.createDataFrame(rows, "doc_id long, n long, batch string")
    out = packing.pack(df, "n", budget=4096, buckets=6).toPandas()
    assert len(out) == len(rows)
    for _, g in out.groupby(["bucket", "batch"]):
        assert sorted(g.place) == list(range(len(g))) and (len(g) == 1 or len(g) * g.padded.iloc[0] <= 4096) and (g.padded >= g.length).all()
    for _, g in out.groupby("bucket"):
        assert g.padded.nunique() == 1 and g.padded.iloc[0] == g.length.max() and sorted(g.batch.unique()) == list(range(g.batch.nunique()))
        full = g.groupby("batch").size().sort_index()
        assert (full.iloc[:-1] == full.iloc[0]).all()
    assert packing.pack(df.limit(0), "n").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\rab\x01\xa0é", max_size=30)), min_size=1, max_size=20))
def test_word_count(spark, texts):
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(word_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


# --- mixing ---


def test_targets():
    t = mixing.targets({"b": 100, "a": 1000, None: 50}, (3, 1, 2), 1.5, 2.0)
    assert t["b"] == 200 and t[None] == 100 and t["a"] == pytest.approx(1.5 * 1150 - 300)
    assert mixing.targets({"a": 0}, (3,), 1.5, 2.0) == {"a": 0.0} and mixing.targets({}, (3,), 1.5, 2.0) == {}
    even = mixing.targets({"a": 100, "b": 100}, (3, 1), 0.4, 2.0)
    assert even == {"a": 60.0, "b": 20.0}


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(3)
    size, part = rng.integers(1, 50, 12).astype(float), np.full(12, 0.3)
    total = np.zeros(12)
    for _ in range(4000):
        out, closed, at, p = mixing.pivot(size, part, rng.random(12), 0.0, 0.0)
        value = out.copy()
        if at is not None:
            assert at >= 0 and np.isnan(out[at]) and 0 < p < 1
            value[at] = p
        assert closed is None and np.isfinite(value).all() and (value * size).sum() == pytest.approx((part * size).sum())
        total += value
    assert np.abs(total / 4000 - 0.3).max() < 0.05


def mixed(spark, rows, batch="1000"):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "doc_id long, source string, n long, copies string")
        return mixing.mix(df, F.col("n")).toPandas().sort_values(["doc_id", "size"]).reset_index(drop=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_mixing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, ["a", "b", None, "hot"][min(int(x), 3)], int(n), "c") for i, (x, n) in enumerate(zip(rng.integers(0, 9, 6000), rng.integers(0, 90, 6000), strict=True))]
    out = mixed(spark, rows)
    assert len(out) == 6000 and out.copies.between(0, 2).all()
    sizes = collections.Counter()
    for _, s, n, _ in rows:
        sizes[s] += n
    goal = mixing.targets(dict(sizes), (3, 1, 2), 1.5, 2.0)
    for s, g in out.groupby(out.source.where(out.source.notna(), None), dropna=False):
        s = None if s != s else s
        assert abs((g.copies * g["size"]).sum() - goal[s]) <= 90 and np.allclose(g.target, goal[s]) and (g.source_size == sizes[s]).all()
    assert out.equals(mixed(spark, rows[::-1], "7"))


def test_mixing_edges(spark):
    assert len(mixed(spark, [])) == 0
    out = mixed(spark, [(1, "a", None, "c"), (2, None, 0, "c"), (None, "", 5, "c"), (3, "b", 4, "c"), (3, "b", 4, "c")])
    assert len(out) == 5 and (out.copies * out["size"]).sum() >= 0


# --- media ---


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400), st.integers(0, 255))
def test_container_round_trip(units, fill):
    payload = bytes((fill + i) % 256 for i in range(units * media.UNIT))
    stored = media.mux(payload)
    (t,) = media.parse(stored)
    assert media.samples(stored, t) == payload and t.codec == "raw" and t.kind == "soun" and t.duration == len(payload) and t.count() == units
    keys = media.key_ranges(t)
    assert len(keys) == -(-units // media.KEY_EVERY) and all(stored[a : a + n] == payload[i * media.KEY_EVERY * media.UNIT :][:n] for i, (a, n) in enumerate(keys))


def test_nested_boxes_and_faults():
    inner = media.box(b"trak", media.box(b"mdia"))
    boxes = [(p, k) for p, k, _, _ in media.walk(memoryview(media.box(b"moov", inner) + media.box(b"free", b"abc")), 0, 8 + len(inner) + 11)]
    assert boxes == [((), b"moov"), ((b"moov",), b"trak"), ((b"moov", b"trak"), b"mdia"), ((), b"free")]
    wide = b"\0\0\0\1free\0\0\0\0\0\0\0\x12ab" + b"\0\0\0\0mdatxyz"
    assert [(k, hi - lo) for _, k, lo, hi in media.walk(memoryview(wide), 0, len(wide))] == [(b"free", 2), (b"mdat", 3)]
    for bad in (b"\0\0\0\4free", b"\0\0\1\0free", b"abc", b"\0\0\0\1free\0"):
        with pytest.raises(media.MediaError):
            media.parse(bad)
        assert media.info(bad) is None
    assert media.info(None) is None and media.info(b"") is None
    with pytest.raises(media.MediaError):
        media.mux(b"")
    with pytest.raises(media.MediaError):
        media.parse(media.mux(b" " * 192)[:-1])


def test_media_columns(spark):
    import hashlib

    texts = ["", None, "é" * 96, "x" * 192, "y" * 193, "long " * 30_000, "x" * 192]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    stored = media.with_media(df)
    out = {r["doc_id"]: r for r in media.read_back(stored).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert out[3]["media_sha256"] == out[6]["media_sha256"] and out[0]["feature"] == out[1]["feature"]
    seen = {r["doc_id"]: r["info"] for r in media.probe(stored).collect()}
    assert seen[5]["codec"] == "raw" and seen[5]["duration_s"] == pytest.approx(150_144 / 8000) and len(seen[5]["keyframes"]) == seen[5]["n_keyframes"] == 25
    assert media.read_back(media.with_media(df.limit(0))).count() == 0


# --- token files ---

ODD = [
    "", None, " ", "a  b", "  lead", "trail ", "x \n y", "\ta b\n\n c", "it's 's don't stop's it'", "<|endoftext|> b <|endoftext|>", "abc,def. ghi?!\nNext", "Ünï çé。漢字 y", ".\n.", "a\u00a0b \u2003c",
    "１２ ②b", "a_b __c", "w" * 5000, "a\x1c b \x1c c", "q\n r\n\ns", "\0a b \0a", "😀 x😀y", *map(chr, range(1, 400)), *[" " + chr(i) + "." for i in range(0x300, 0x3000, 37)],
]


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_encoder(tokenizer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    encode = tokens.Encoder(tokenizer)
    assert encode.cuts
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in encode(ODD)]
        assert got == [[*plain.encode(t or "", add_special_tokens=False).ids, 0] for t in ODD]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n\t.,'sAé1_\u00a0漢", max_size=40))
def test_encoder_cuts_anywhere(tokenizer, text):
    from tokenizers import Tokenizer

    encode = tokens.encoder(tokenizer, 0)
    plain = test_encoder_cuts_anywhere.__dict__.setdefault("plain", Tokenizer.from_file(tokenizer))
    assert np.frombuffer(encode([text])[0], "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=20), st.integers(1, 40))
def test_plane_files(docs, block):
    f = Bytes()
    w = tokens.Writer(f, block)
    for i, d in enumerate(docs):
        w.add(i if i % 3 else None, np.array(d, "<u4").tobytes())
    w.finish()
    r = tokens.Reader(f)
    assert [(i, x.tolist()) for i, x in r.documents()] == [(i if i % 3 else None, d) for i, d in enumerate(docs)]
    flat = [x for d in docs for x in d]
    assert r.ids(len(flat) // 3, len(flat)).tolist() == flat[len(flat) // 3 :] and r.n_ids == len(flat)


def test_planes():
    ids = np.array([0, 1, 0x04030201, 2**32 - 1], "<u4")
    assert tokens.planes(ids)[0] == b"\x00\x01\x01\xff" and (tokens.unplanes(tokens.planes(ids)) == ids).all()
    with pytest.raises(ValueError):
        tokens.Reader(Bytes(b"x" * 100))


def test_token_files(spark, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    rows = [(i * 7 % 501, t, "c") for i, t in enumerate((ODD[:20] * 12)[:200])] + [(None, "no id", "c"), (3, "again", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    manifest = tokens.write(df, tokenizer, f"file://{tmp_path}/t")
    out = sorted(tokens.read(manifest).collect(), key=lambda r: r["start"])
    start = 0
    for r in out:
        assert r["start"] == start and len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    assert [r["doc_id"] for r in out] == sorted((d for d, _, _ in rows), key=lambda d: (d is not None, d))
    want = collections.Counter((d, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 0])) for d, t, _ in rows)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in out) == want
    assert tokens.digest(manifest).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert tokens.digest(tokens.write(df.limit(0), tokenizer)).count() == 0
