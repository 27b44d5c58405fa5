"""Near-duplicate texts of the pipeline against exact shingle sets."""

import numpy as np
import pytest

import corpus_pipeline as C
from strandmap.llm import simhash as S
from strandmap.llm.components import forest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text: str, k: int = 5) -> set[str]:
    words = text.lower().split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def pairs(changes, seed: int = 1) -> list[str]:
    """Texts 2i and 2i + 1 differ in a run of changes[i] words."""
    rng, out = np.random.default_rng(seed), []
    for n in changes:
        base = [f"v{x}" for x in rng.integers(0, 50_000, 300)]
        at = int(rng.integers(5, 290 - n))
        out += [" ".join(base), " ".join([*base[:at], *(f"n{x}" for x in rng.integers(0, 50_000, n)), *base[at + n :]])]
    return out


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    return sorted(((r["doc_id"], r["text"]) for r in C.stage_dedup(spark, docs, "").collect()), key=str)


@pytest.mark.parametrize("slice_", [1 << 20, 500])
def test_stage_against_brute_force(spark, monkeypatch, slice_):
    """Pairs of 0.7 to 0.85, half of them on either side of 0.8 and many close to it."""
    monkeypatch.setattr(S, "SLICE", slice_)
    texts = pairs([*range(18, 50), *[26, 27, 28, 29, 30, 31] * 12])
    at = [jaccard(a, b) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert 0.69 < min(at) < 0.71 and max(at) > 0.85 and sum(0.79 < x < 0.8 for x in at) > 20 and sum(0.8 <= x < 0.81 for x in at) > 10
    want = [i for i in range(len(texts)) if i % 2 == 0 or at[i // 2] < 0.8]
    assert [i for i, _ in sorted(stage(spark, enumerate(texts)))] == want


def test_repeated_lines_are_one(spark):
    rng = np.random.default_rng(2)
    words = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 50_000, n))
    line = " " + words(20)
    a, b, c = words(504) + line * 50, words(504) + line * 50, words(504)
    assert jaccard(a, b) < 0.05 and jaccard(c, c + line * 50) > 0.9
    assert [i for i, _ in stage(spark, enumerate([a, b, c, c + line * 50]))] == [0, 1, 2]


@pytest.mark.parametrize("rows", [1000, 1 << 30])
def test_links_do_not_depend_on_the_table(spark, monkeypatch, rows):
    shape = S.sketch_shape
    monkeypatch.setattr(S, "sketch_shape", lambda n: shape(rows))
    texts = pairs([26, 27, 28, 29, 30] * 20, 3)
    want = [i for i in range(len(texts)) if i % 2 == 0 or jaccard(texts[i - 1], texts[i]) < 0.8]
    assert [i for i, _ in sorted(stage(spark, enumerate(texts)))] == want
    assert 1 - (1 - 0.8**S.ROWS) ** S.bands(0.8) >= S.MET


def test_repeated_and_missing_ids(spark):
    a, b, c, d = pairs([28, 28], 4)
    x, y = pairs([200], 5)
    # Two texts of one id are two documents; their copies don't become one group.
    assert stage(spark, [(1, a), (1, x), (2, b), (3, x), (1, a), (4, y)]) == sorted([(1, a), (1, x), (4, y)], key=str)
    # Copies among rows without an id are one.
    assert len(stage(spark, [(None, c), (None, c), (None, d), (None, y)])) == 2


def test_exact_links():
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 1 << 63, 40, dtype=np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate([base[i % 6][rng.random(40) < 0.9], rng.integers(0, 1 << 63, int(rng.integers(0, 6)), dtype=np.uint64)])) for i in range(90)]
    nodes, sizes = np.arange(90) * 7, np.array([len(s) for s in sets])
    a, b = S.exact_links(nodes, sizes, np.concatenate(sets), 0.8)
    like = np.array([[len(np.intersect1d(s, t)) / len(np.union1d(s, t)) for t in sets] for s in sets])
    assert all(like[i // 7, j // 7] >= 0.8 for i, j in zip(a, b, strict=True))
    p, q = np.nonzero(like >= 0.8)
    assert [z.tolist() for z in forest(a, b)] == [z.tolist() for z in forest(nodes[p], nodes[q])]


def test_hot_groups_against_brute_force(spark, monkeypatch):
    """Large groups of near copies, some of them linked to the rest by one text alone, in small slices."""
    monkeypatch.setattr(S, "BUCKET", 8)
    monkeypatch.setattr(S, "TILE", 6)
    monkeypatch.setattr(S, "SLICE", 1200)
    rng = np.random.default_rng(11)
    base = [f"v{x}" for x in rng.integers(0, 50_000, 200)]
    texts = []
    for i in range(70):  # near copies that drift away from the first: neighbours are links, ends are not
        own = list(base)
        for at in rng.integers(0, 200, 1):
            own[at] = f"n{rng.integers(0, 50_000)}"
        base = own if i % 3 == 0 else base
        texts.append(" ".join(own))
    texts += [" ".join(f"v{x}" for x in rng.integers(0, 50_000, 60)) for _ in range(20)] + texts[:5]
    own = {r["id"]: r["class"] for r in S.text_classes(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    p, q = zip(*[(i, j) for i in range(len(texts)) for j in range(i + 1) if jaccard(texts[i], texts[j]) >= 0.8], strict=True)
    child, root = forest(np.array(p), np.array(q))
    want = np.arange(len(texts))
    want[child] = root
    same = lambda of: {tuple(sorted(i for i in range(len(texts)) if of[i] == c)) for c in {of[i] for i in range(len(texts))}}
    assert same(own) == same(want) and max(map(len, same(want))) > 60


@pytest.mark.parametrize("shipped", [500_000, -1])
def test_rows_kept_are_whole_and_once(spark, monkeypatch, shipped):
    monkeypatch.setattr(S, "SHIPPED_ROWS", shipped)
    a, b = pairs([10], 12)
    (x,) = pairs([250], 13)[:1]
    rows = [(1, a, "k1"), (2, b, "y"), (5, x, "z"), (5, x, "z"), (5, x, "z"), (1, a, "k1"), (None, None, None), (7, "", "q"), (8, "", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    out = sorted(((r["doc_id"], r["text"], r["k1"]) for r in S.one_of_each(df).collect()), key=str)
    assert out == sorted([(1, a, "k1"), (5, x, "z"), (None, None, None), (7, "", "q")], key=str)


def test_one_bit_in_overfull_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 3)
    rng = np.random.default_rng(14)
    base = rng.integers(-(1 << 62), 1 << 62, 6)
    fps = np.unique(np.concatenate([base, *[base ^ (1 << int(k)) for k in rng.integers(0, 62, 12)], *[base ^ (1 << int(k)) ^ (1 << int(m)) for k, m in rng.integers(0, 62, (12, 2))]]))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    got = {r["id"]: r["component"] for r in S.components(S.links(df, 1)).collect()}
    far = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64))
    child, root = forest(*(fps[z] for z in np.nonzero(far <= 1)))
    want = dict(zip(child.tolist(), root.tolist(), strict=True))
    assert got == want | {r: r for r in set(want.values())}
