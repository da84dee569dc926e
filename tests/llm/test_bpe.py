"""BPE against the tokenizers library."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from histora.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZéèüßñΣσİıǅ日本語 한글अ१²½Ⅷ'sS’\"!?.,;:-—…\t\n\r\x0b\x1c\x85\xa0 　🙂👩‍👩‍👧é"
    out = ["", " ", "The cat's they're I'LL don't", "a" * 5_000, "ΟΔΟΣ ΣΑΣ", "x <|endoftext|>y<|startoftext|> <|ENDOFTEXT|>", "word " * 20_000]
    return out + ["".join(rng.choices(letters, k=rng.randint(1, 300))) for _ in range(300)]


def test_matches_library(spark):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    all_texts = [*texts(), None]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(all_texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.digested(docs).collect()}
    full = {r.doc_id: r for r in bpe.encoded(docs).collect()}
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(docs)).collect()}
    for i, text in enumerate(all_texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        plain = t.decode(ids, skip_special_tokens=False)
        assert full[i].ids == ids, text
        assert full[i].decoded == plain == back[i]
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest()


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert len({(r.n_tokens, r.ids_sha256) for r in bpe.digested(docs).collect()}) == 1
    assert bpe.digested(docs).count() == 3
    assert bpe.digested(docs.limit(0)).count() == 0


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    codec = bpe.Codec(bpe.Vocabulary(PATH))
    first = list(codec.encode(["one two three four five"]))
    list(codec.encode(["six seven"]))
    assert list(codec.encode(["one two three four five"])) == first
