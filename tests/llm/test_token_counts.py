import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sharescope.llm.token_counts import count_tokens, token_digest

from .cases import awkward, frame, prose, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokens(text):
    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


def test_same_as_library(spark):
    rows = awkward()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_digest(frame(spark, rows), PATH).collect()), key=str)
    assert got == sorted(((r[0], len((r[1] or "").encode()), tokens(r[1]), tokens(r[1]) > 1024) for r in rows), key=str)


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (300, 8), (1000, 200)])
def test_splices_at_any_chunk_size(spark, chunk, overlap):
    texts = [prose(1, 400), "x" * 700, ("日本語" * 100 + " ") * 5, " " * 400 + "end", "a <|endoftext|> " * 60, "don't   stop\n\n\n" * 50, "word" * 90 + " " + "12 345 " * 80]
    docs = with_clashes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "n_tokens", "_row", "_whole", "tokens")
    rows = count_tokens(docs, PATH, chunk=chunk, overlap=overlap).collect()
    assert {(r["_row"], r["_whole"], r["tokens"]) for r in rows} == {("mine",) * 3}
    got = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert got == {i: tokens(t) for i, t in enumerate(texts)}


def test_empty(spark):
    assert token_digest(frame(spark, []), PATH).collect() == []
