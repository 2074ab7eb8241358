import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", "a   b ", "x\n  y", "x\n y", "tab\t end ", "it's 'tis", "<|endoftext|>", "a <|endoftext|> b", "a\n <|endoftext|>", "é  z", "日本語 text", "🙂🙂 ́x", "\x00\x01", "foo \n bar", " lead", "1234 5678!!"]


@pytest.fixture(scope="module")
def tools():
    return Tokenizer.from_file(PATH), bpe.TreeBPE(PATH, long=40, leaf=8, units=4)


def want(tok, t):
    ids = tok.encode(t or "", add_special_tokens=False).ids
    back = tok.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_odd_texts(tools):
    tok, own = tools
    for t in [*ODD, None]:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == tok.decode(ids, skip_special_tokens=False)
    assert own.plain and [own.digest(t) for t in [*ODD, None]] == [want(tok, t) for t in [*ODD, None]]


def test_long_unsplit(tools):
    tok, own = tools
    rng = random.Random(1)
    for alphabet in ("ab", "abcdefghij", "the", "éaß", "!?.", "0123456789", "日本語aé"):
        for n in (41, 100, 777, 3000):
            t = "".join(rng.choice(alphabet) for _ in range(n))
            assert own.encode(t) == tok.encode(t, add_special_tokens=False).ids
    assert own.encode("a" * 5000) == tok.encode("a" * 5000, add_special_tokens=False).ids
    assert own.encode(" " * 999) == tok.encode(" " * 999, add_special_tokens=False).ids


def test_random_texts(tools):
    tok, own = tools
    rng = random.Random(2)
    texts = ["".join(rng.choice("aeth ns  \n\t.'éß1$") for _ in range(rng.randrange(120))) for _ in range(1500)]
    texts += [" ".join("".join(rng.choice("abÉñtheß") for _ in range(rng.randrange(1, 60))) + rng.choice(["", "", ".", ",", "!?", "'s", "'", "…", "9", bpe.TAIL]) for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    assert [own.digest(t) for t in texts] == [want(tok, t) for t in texts]


def test_joins_on_the_tables(tools):
    """Texts of the table are cut into halves and joined; the library says the same of each."""
    import pyarrow.parquet as pq

    own = bpe.TreeBPE(PATH)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    assert [own.digest(t) for t in texts] == [want(tools[0], t) for t in texts]
    assert own.joins > len(texts)


def test_windows_grow(tools):
    """A wrong unit at a join is found and replaced."""
    _, own = tools
    units = [" one", " two", " three", " four", " five", " six"]
    right = [own.unit(u) for u in units]
    wrong = [*right[:2], (1, ",5", b"x"), (1, ",6", b"y"), *right[4:]]
    assert "".join(x[1] for x in own.joined(units, wrong)) == "".join(x[1] for x in right)


def test_query(spark):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None, "same", "same"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    tok = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(df, PATH).collect()}
    assert got == {i: want(tok, t) for i, t, _ in rows}
    assert {r["doc_id"]: list(r["ids"]) for r in bpe.encode(df, PATH).collect()} == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    assert bpe.digests(df.limit(0), PATH).count() == 0
