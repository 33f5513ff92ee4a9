"""Encoding and decoding against the tokenizers library."""

import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, texts):
    ids, cut = bpe.Encoder(bpe.load_vocabulary(PATH)).encode(texts)
    for k, told in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[cut[k] : cut[k + 1]].tolist() == told.ids, texts[k][:80]


def test_every_character(library):
    points = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    same(library, [f"a{chr(c)}b Q {chr(c)}Z 1{chr(c)}2 .{chr(c)}." for c in points[::7]] + [chr(c) for c in points[:4000]])


def test_words_of_all_lengths(library):
    rnd = random.Random(3)
    odd = ["a<|startoftext|>b<|endoftext|>c", "<|endoftext|><|endoftext|>", "<|start", "<|ENDOFTEXT|>", "日本語" * 3000, "!" * 5000, "ΑΣ Σ", "İstanbul", "it's we'll don'T I'M 'S 's", "", " ", "é é"]
    same(library, odd + ["x" * n for n in range(1, 300, 3)] + ["".join(rnd.choice("abcde") for _ in range(n)) for n in (65, 70, 129, 500, 5000, 60_000)])
    alphabet = "abcdefghijklmnop  '.,éß日本語😀123<|>\n\tΣİ"
    same(library, ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 200))) for _ in range(2000)])


def test_long_words_merge_as_short_ones(library, monkeypatch):
    """Merging wherever a pair is least within reach gives what merging pair by pair does, whatever lies beside a word."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abx!") for _ in range(rnd.randint(1, 120))) for _ in range(600)] + ["x" * 200, "a" * 130, "the" * 60]
    monkeypatch.setattr(bpe, "LONG_WORD", 4)
    same(library, words)


def test_least_nearby():
    x = np.array([random.Random(i).randint(0, 99) for i in range(500)])
    for reach in (1, 3, 32, 600):
        assert bpe.least_nearby(x, reach).tolist() == [min(x[max(0, i - reach) : i + reach + 1]) for i in range(500)]


def test_words_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 5)
    encoder = bpe.Encoder(bpe.load_vocabulary(PATH))
    for text in ("one two three four five six", "seven two", "", "<|endoftext|> six"):
        ids, cut = encoder.encode([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and cut.tolist() == [0, len(ids)]


EDGES = [(1, "Hello  World, it's 2024!"), (2, None), (3, ""), (4, " \n\t"), (None, "no id"), (1, "Hello  World, it's 2024!"), (5, "tail " * 50_000), (6, "a<|endoftext|>b"), (7, "日本語" * 40), (8, "x" * 3000)]


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark, library, tmp_path):
    docs = spark.createDataFrame([(d, t, 7, [1], "x") for d, t in EDGES], "doc_id long, text string, n_tokens int, ids array<int>, decoded string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in bpe.op13_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(((d, *digests(library, t)) for d, t in EDGES), key=repr)
    assert bpe.encode_texts(docs.where("false"), PATH).collect() == []


def test_decoding(spark, library):
    rows = spark.createDataFrame([(1, [320, 49407, 1125]), (2, []), (3, None), (4, [-1, 320, 99999])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode_ids(rows, PATH).collect()}
    assert got == {1: library.decode([320, 49407, 1125], skip_special_tokens=False), 2: "", 3: "", 4: library.decode([320])}


def test_documents(spark, sf_dir, library):
    got = {tuple(r) for r in bpe.op13_bpe(spark, sf_dir).collect()}
    assert got == {(r.doc_id, *digests(library, r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_merges_out_of_order_are_refused(tmp_path):
    import json

    with open(PATH) as f:
        told = json.load(f)
    told["model"]["merges"].reverse()
    (tmp_path / "t.json").write_text(json.dumps(told))
    with pytest.raises(ValueError, match="order"):
        bpe.load_vocabulary(str(tmp_path / "t.json"))
