import os
import sys
import types
import zlib

import numpy as np
import pytest

from cargofile.llm.packing import encoded, pack, patterns, slots
from cargofile.llm.queries import vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(vocabulary())


def plain_ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_words_encoded_apart_equal_the_whole(tokenizer, corner_texts):
    texts = [t or "" for _, t in corner_texts] + [
        "don't they'll  I'M 123 4x <|endoftext|> a<|startoftext|>b", "é ́x İ Σας ﬁ", "\x01 a \x01\x01", "x" * 5000,
        "tab\tand hard　space", "中文 日本語 عربى", "a" * 47 + " " + "b" * 49]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoded(texts, vocabulary())] == [
        plain_ids(tokenizer, t).tolist() for t in texts]


def test_words_in_use_are_not_encoded_again_when_the_cache_is_full(tokenizer, monkeypatch):
    monkeypatch.setattr("cargofile.llm.packing.CACHED_WORDS", 40)
    asked = []

    class Counting:
        def encode_batch_fast(self, texts, **kw):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, **kw)

        def __getattr__(self, name):
            return getattr(tokenizer, name)

    monkeypatch.setitem(sys.modules, "cargofile_kept_tokenizers", types.ModuleType("cargofile_kept_tokenizers"))
    monkeypatch.setattr("tokenizers.Tokenizer", types.SimpleNamespace(from_file=lambda path: Counting()))
    for k in range(30):
        text = "Always here, DON'T go. " + " ".join(f"w{k}x{i}" for i in range(10))
        assert encoded([text], vocabulary())[0] == plain_ids(tokenizer, text).tobytes()
    assert sum(t.split().count("here") for t in asked) == 1


def test_every_id_lies_in_one_piece_and_sequences_have_no_gap(frame, tokenizer, corner_texts):
    rows = pack(frame(corner_texts), vocabulary(), length=64).collect()
    by_text = {}
    for doc, text in corner_texts:
        by_text.setdefault(doc, []).append(np.append(plain_ids(tokenizer, text), 1).astype("<u4"))
    total = sum(len(x) for own in by_text.values() for x in own)
    assert sum(r.length for r in rows) == total
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32
                   for x in by_text[r.doc_id])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(sequences) == list(range(len(sequences)))


def test_empty_table_packs_to_no_rows(frame):
    assert pack(frame([]), vocabulary()).collect() == []


def test_patterns_use_each_length_as_often_as_it_occurs():
    pick = np.random.default_rng(0)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(pick.integers(1, 2049, 5000), return_counts=True))}
    packs, used = patterns(histogram), {}
    for lengths, count in packs:
        assert sum(lengths) <= 2048
        for size in lengths:
            used[size] = used.get(size, 0) + count
    assert used == histogram
    assert sum(histogram[k] * k for k in histogram) > 0.97 * 2048 * sum(c for _, c in packs)
    table = slots(packs)
    assert len({(a, b) for a, b in table[:, :2].tolist()}) == len(table)
