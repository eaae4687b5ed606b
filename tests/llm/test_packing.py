import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuslake.llm import packing
from corpuslake.llm.queries import ranks_path

DATA = "/root/testdata/sf0.001/documents.parquet"
FULL = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return FULL.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab  \n\t\u00a0é'sdll123.,ß日\x1c\u3000"), max_size=60))
def test_pieces_encode_like_whole_texts(text):
    assert np.frombuffer(packing._tokens(ranks_path())(text), dtype="<u4").tolist() == ids_of(text)


def test_special_strings():
    text = "a <|endoftext|> b"
    assert np.frombuffer(packing._tokens(ranks_path())(text), dtype="<u4").tolist() == ids_of(text)


def check(docs, pieces, length=1024):
    rows = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in rows:  # gapless
        assert (r.sequence_id, r.offset) == divmod(at, length)
        assert 0 < r.length <= length - r.offset
        at += r.length
    texts = {}
    for d in docs.select("doc_id", "text").collect():
        texts.setdefault(d.doc_id, []).append(ids_of(d.text) + [0])
    assert at == sum(len(i) for t in texts.values() for i in t)
    for doc, lists in texts.items():
        own = [(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == doc]
        # Of repeated rows each is cut in its own places, so the pieces are dealt out to them by what they must begin with.
        for ids in lists:
            start = 0
            while start < len(ids):
                fits = [p for p in own if p[0] == start and p[3] == len(ids) and p[2] == zlib.crc32(np.asarray(ids[start : start + p[1]], dtype="<u4").tobytes())]
                assert fits
                piece = min(fits, key=lambda p: p[1] if len(lists) == 1 else (sum(q[0] == start + p[1] for q in own) == 0, p[1]))
                own.remove(piece)
                start += piece[1]
        assert not own


def test_ids_of_all_documents_are_the_named_tokenizers(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    tokens = packing._tokens(ranks_path())
    for i in range(0, len(texts), 500):
        some = [t or "" for t in texts[i : i + 500]]
        for text, want in zip(some, FULL.encode_batch(some, add_special_tokens=False)):
            assert np.frombuffer(tokens(text), dtype="<u4").tolist() == want.ids


def test_repeated_rows_are_cut_apart(spark):
    docs = spark.createDataFrame([(1, "some words of a text, again and again. " * 20)] * 7 + [(2, None), (2, None), (None, "x"), (None, "x")], "doc_id long, text string").repartition(3)
    check(docs, packing.pack(docs, ranks_path(), 64), 64)


def test_round_trip(spark):
    docs = spark.read.parquet(DATA).repartition(5)
    check(docs, packing.pack(docs, ranks_path()))


def test_odd_rows(spark, odd, empty):
    check(odd, packing.pack(odd, ranks_path(), 64), 64)
    assert packing.pack(empty, ranks_path()).count() == 0
