import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ours():
    return bpe.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    t = Library.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids(t, text):
    return list(bpe.array("I", t.encode(text)))


def test_fuzz(ours, library):
    rng = random.Random(1)
    parts = ["hello", "Hello", " WORLD", "²", "½", "Ⅷ", "internationalization", "été", "don't", "we'll", "___", "٣٤", "हिन्दी", "\x1c", "\u200b", "\x85", "\u3000", "<|endoftext|>", "<|endof", "  ", "\n\n", "\t", "!!!", "a" * 40, "12345", "🙂"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x2000, 0x3100), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(12)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(ours, text) == want, text
        assert ours.decode(ours.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_small_automaton_equals_merging():
    """All merge orders over two letters, against merging the best pair again and again."""
    rng = random.Random(2)
    for _ in range(200):
        labels, merges, have = [b"a", b"b"], [], {b"a": 0, b"b": 1}
        for _ in range(rng.randrange(1, 8)):
            u, v = rng.choice(labels), rng.choice(labels)
            if u + v not in have:
                have[u + v] = len(labels)
                merges.append((have[u], have[v], len(labels)))
                labels.append(u + v)
        machine = bpe.Automaton(labels, merges)
        rank = {(u, v): (i, t) for i, (u, v, t) in enumerate(merges)}
        for _ in range(30):
            word = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12)))
            parts = [have[bytes([c])] for c in word]
            while True:
                best = min((rank[p] for p in zip(parts, parts[1:], strict=False) if p in rank), default=None)
                if best is None:
                    break
                u, v, t = *merges[best[0]][:2], best[1]
                out, i = [], 0
                while i < len(parts):
                    if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (u, v):
                        out.append(t)
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            assert machine.encode(word, {}) == parts, (word, merges)


def test_documents(spark, docs, none, ours, library):
    want = {}
    for r in docs.collect():
        got = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(got), hashlib.sha256(bpe.array("I", got).tobytes()).hexdigest(), hashlib.sha256(library.decode(got, skip_special_tokens=False).encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in bpe.digest_documents(spark, docs, ours).collect()} == want
    assert bpe.digest_documents(spark, none, ours).count() == 0


def test_round_trip_of_columns(spark, docs, none, ours):
    encoded = bpe.encode_documents(spark, docs, ours)
    assert encoded.columns == [*docs.columns, "token_ids"]
    back = bpe.decode_documents(spark, encoded, ours)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert bpe.encode_documents(spark, none, ours).count() == 0


def test_full_tables_are_emptied(ours, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    monkeypatch.setattr(bpe, "ARCS_KEPT", 3)
    fresh = bpe.Tokenizer(ours.automaton, ours.added)
    text = "several different words in a row with endings"
    assert ids(fresh, text) == ids(ours, text) and len(fresh._words) <= 3


def test_vocabularies_that_are_refused():
    symbols = bpe.byte_symbols()
    vocab = {c: b for c, b in symbols.items()}
    plain = {"added_tokens": [], "normalizer": None, "model": {"vocab": vocab, "merges": []}}
    assert bpe.Tokenizer.from_json(json.dumps(plain)).decode(bpe.Tokenizer.from_json(json.dumps(plain)).encode("é!")) == "é!"
    for change in ({"normalizer": {"type": "NFC"}}, {"added_tokens": [{"content": "<x>", "id": 256, "lstrip": True}]}, {"model": {"vocab": {c: b for c, b in vocab.items() if b != 65}, "merges": []}}):
        with pytest.raises(ValueError):
            bpe.Tokenizer.from_json(json.dumps(plain | change))


def test_documents_with_repeated_rows_and_any_columns(spark, ours, library):
    long = "word " * 50_000 + "é" * 3000
    data = [(1, "a b", 7, "x"), (1, "a b", 7, "x"), (None, "c", 8, "y"), (2, None, 9, "z"), (3, "", 10, "z"), (4, long, 11, "z")]
    df = spark.createDataFrame(data, "doc_id long, text string, token_ids int, n_tokens string")
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest_documents(spark, df, ours).collect()), key=repr)
    want = []
    for i, text, *_ in data:
        own = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(own), hashlib.sha256(bpe.array("I", own).tobytes()).hexdigest(), hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    encoded = bpe.encode_documents(spark, df, ours)
    assert encoded.columns == ["doc_id", "text", "n_tokens", "token_ids"] and encoded.count() == 6
    back = bpe.decode_documents(spark, encoded.drop("text"), ours)
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for _, t, *_ in data)
