import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import tokenfile as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_code():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        r = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        c, d = tf.pack(r)
        assert (tf.unpack(np.frombuffer(c, "u1"), np.frombuffer(d, "u1"), n) == r).all()
        assert len(c) == -(-n // 4)


def want(rows):
    tok, out, start = Tokenizer.from_file(PATH), [], 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_roundtrip(spark, tmp_path):
    texts = ["Hello World's end", None, "", "  two  spaces\n\tTab", "É́ É <|endoftext|>x <|startoftext|>", "日本 🙂", "a" * 3000, "word " * 4000, "it's here\x1cnow", "ΣΑΣ İ", "Ab. cd, EF.. gh.,x <|ENDOFTEXT|> 3. a1, 'S. It's.", ". , .a", "ªº µ ß ŉ Ǆ ǅ ÿ İi ĸ Ñandú, É. été ſ"]
    rows = [(100 - i * 7, t) for i, t in enumerate(texts)] + [(None, "null key")]
    df = spark.createDataFrame([(a, b, 9) for a, b in rows], "doc_id long, text string, n long")
    manifest = tf.write(df, f"{tmp_path}/t", PATH)
    got = sorted(map(tuple, tf.scan(manifest).collect()), key=lambda r: r[1])
    assert got == want(rows)
    ids = {r["doc_id"]: list(r["ids"]) for r in tf.scan(manifest, with_ids=True).collect()}
    assert ids[100] == [*Tokenizer.from_file(PATH).encode(texts[0], add_special_tokens=False).ids, 2]


def test_short_way():
    """Plain words go to the merges without the library's splitting, and get the library's ids."""
    own, tok = tf.Encoder(PATH), Tokenizer.from_file(PATH)
    assert own.plain
    rng = np.random.default_rng(3)
    for t in ["".join(rng.choice(list("abTHEéÑßœ İı9.,!'\"<|"), 30)) for _ in range(3000)] + [f"word{x}" for x in tf.TAIL]:
        assert own.encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_ties_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (0, "z")], "doc_id long, text string")
    got = tf.roundtrip(df, PATH).collect()
    assert sorted(r["start"] for r in got)[0] == 0 and sum(r["n_tokens"] for r in got) == 2 + 3 + 3 + 2
    assert {r["doc_id"]: r["start"] for r in got}[0] == 0
    assert tf.roundtrip(df.limit(0), PATH).count() == 0


def test_coded_once(spark, tmp_path, monkeypatch):
    """Each document's ids are coded once, though a range shuffle reads its rows twice."""
    pack, log = tf.pack, f"{tmp_path}/log"

    def counted(ranks):
        with open(log, "a") as f:
            f.write("x")
        return pack(ranks)

    monkeypatch.setattr(tf, "pack", counted)
    df = spark.createDataFrame([(i, f"word {i}") for i in range(50)], "doc_id long, text string").repartition(3)
    assert tf.write(df, f"{tmp_path}/t", PATH).count() > 0
    with open(log) as f:
        assert len(f.read()) == 50


def test_letters_and_marks_are_looked_up_apart():
    """A word is encoded once, whatever marks stand behind it; marks inside, and other characters, change no id."""
    own, tok = tf.Encoder(PATH), Tokenizer.from_file(PATH)
    own.encode("thing, thing. thing! thing\nthing?")
    assert set(own.known) - {""} == {"thing", ",", ".", "!", "?"}
    for t in ["a.b", "..a b..", "end.\n.start", "x,y z'.s's", "Éa.,b!? Ñ.9 a\tb. c", "a. <|endoftext|>. b", " . \n\n ,", "ab.日本,c d", "İ.i ,İ"]:
        assert own.encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_documents_of_a_block(monkeypatch):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << rng.integers(1, 32), n).astype(np.uint32) for n in (1, 0, 3, 4, 5, 100, 2, 8, 0, 7)]
    packed = [tf.pack(d) for d in docs]
    for most in (1, 8, 1000):
        monkeypatch.setattr(tf, "TOGETHER", most)
        got = list(tf.documents(np.array([len(d) for d in docs]), *(np.frombuffer(b"".join(x), "u1") for x in zip(*packed, strict=True))))
        assert [x.tolist() for x in got] == [d.tolist() for d in docs]
