"""Counts against the library on whole texts."""

import random

from tokenizers import Tokenizer

from visloom.llm import token_counts
from visloom.llm.common import table
from visloom.llm.queries import BYTE_BPE


def counted(df):
    return {r["doc_id"]: r for r in token_counts.token_counts(df, BYTE_BPE).collect()}


def test_all_documents(spark, sf):
    plain = Tokenizer.from_file(BYTE_BPE)
    docs = table(spark, sf, "documents")
    got = counted(docs)
    for r in docs.collect():
        n = len(plain.encode(r["text"], add_special_tokens=False).ids)
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["n_bytes"]) == (n, len(r["text"].encode()))
        assert got[r["doc_id"]]["over_limit"] == (n > 1024)


def test_blanks_specials_and_long_texts(docs):
    plain = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(5)
    bits = [" ", "  ", "\n", " \n ", "\t", "a", "Ab", "'s", " 's", "12", "é", " ", "　", "\x1c", "<|endoftext|>", ".", "🙂", "é"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(800)]
    texts += ["", None, " ", "x" * 200_000, "word " * 50_000, " lead", "trail "]
    got = counted(docs(list(enumerate(texts))))
    for k, text in enumerate(texts):
        assert got[k]["n_tokens"] == len(plain.encode(text or "", add_special_tokens=False).ids), repr(text)[:80]


def test_empty_table_and_null_id(docs):
    assert counted(docs([])) == {}
    assert counted(docs([(None, "one two")]))[None]["n_tokens"] == 2


def test_full_table_of_segments_keeps_counting():
    small = token_counts.SegmentLengths(BYTE_BPE, limit=2)
    plain = Tokenizer.from_file(BYTE_BPE)
    texts = ["one two three four", "four three two one zero"]
    assert small.counts(texts) == [len(plain.encode(t).ids) for t in texts]
    assert len(small) == 2
