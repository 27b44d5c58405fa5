"""What token workers keep is bounded in bytes, and hot ids go over several files."""

import numpy as np
import pytest

from strandmap.llm import tokens


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_kept_pieces_are_bounded_in_bytes(tokenizer, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "KEPT_BYTES", 20_000)
    encode, plain = tokens.Encoder(tokenizer), Tokenizer.from_file(tokenizer)
    texts = [f"w{i} 漢字{i}かな " + "漢" * (i % 300) + f" word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} x" for i in range(1500)]
    for t, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*plain.encode(t, add_special_tokens=False).ids, 0]
    for table in (encode.pieces, encode.bare, encode.signs):
        assert all(len(k) <= tokens.KEPT_CHARS for k in [*table, *table.old])
        for kept in (table, table.old):
            assert sum(tokens.ENTRY_BYTES + 4 * len(k) + len(v) for k, v in kept.items()) <= 21_000


def test_one_id_on_most_rows(spark, tokenizer, tmp_path):
    rows = [(None if i % 3 else 5, f"text {i % 40}") for i in range(900)] + [(i, "") for i in range(10, 40)] + [(5, "long " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    manifest = tokens.write(df, tokenizer, f"file://{tmp_path}/h").collect()
    assert max(r["n_docs"] for r in manifest) < 600 and sum(r["n_docs"] for r in manifest) == len(rows)
    out = sorted(tokens.digest(tokens.write(df, tokenizer, f"file://{tmp_path}/i")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:], strict=False))
