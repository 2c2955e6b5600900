import random

import pytest

P = pytest.importorskip("public_tokenizers")

from tallyhouse.llm import token_counts  # noqa: E402
from tallyhouse.llm.queries import op1_token_counts  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def counts(frame, **more):
    return [tuple(r) for r in token_counts.count_tokens(frame, "doc_id", "text", PATH, **more).collect()]


def test_whole_documents_as_the_library_counts_them(spark, folder, documents, library):
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    got = op1_token_counts(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        want = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (want, len(texts[r["doc_id"]].encode()), want > 1024)


def test_signs_that_tell_pre_tokens_apart(spark, library):
    signs = (
        "a b é ß 1 ２ ½ ' 's 're 'll 'd 'm 've 't ! % <|endoftext|> 日 ́ 😀 S _ l Ⅷ".split()
        + [" ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "\r\n", "\x00"]
    )
    rng = random.Random(3)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    got = dict((i, n) for i, _, n in counts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), block_chars=2000))
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_odd_rows(odd, library):
    rows = odd.select("doc_id", "text").collect()
    want = sorted(
        ((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr
    )
    assert sorted(counts(odd), key=repr) == want


def test_empty_table(nothing):
    assert counts(nothing) == []


def test_other_tokenizers_are_refused(odd):
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.count_tokens(odd, "doc_id", "text", P.path("word_bpe_49k.json"))
