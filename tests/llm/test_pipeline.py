import hashlib
import random
import weakref

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, langid, mixing, ngramjoin, quality

from .test_ngramjoin import brute


def documents():
    rng, rows = random.Random(5), []
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in ("", "n", "rst")]
    for i in range(150):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(8, 90)))
        if i % 5 == 0 and i:
            t = rows[i - rng.randrange(1, 5)][1] or "x"
        if i % 5 == 1 and i > 5 and rows[i - 3][1]:
            w = rows[i - 3][1].split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if i % 11 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if i % 37 == 0:
            t = [None, "", "1 2 3 4 5 6 7 8 9 10 11 12"][i // 37 % 3]
        rows.append((i, t, "en" if i % 4 else "de", ["a", "a", "b", "c", None][i % 5], len(t or "")))
    return rows


def test_against_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"create table documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    good = {r[0] for r in con.sql(quality.sql(keep="doc_id, kept")).fetchall() if r[1]}
    left = [r for r in rows if r[0] in good and any(c.isalpha() for c in r[1])]
    class_of = brute([r[:2] for r in left], 5, 80, 100)
    left = [r for r in left if class_of[r[0]][1] == r[0]]
    assert 0 < len(left) < len(good) < len(rows)
    con.sql("create table mixed (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into mixed values (?, ?, ?)", [(r[0], r[1], r[3]) for r in left])
    copies = {r[0]: r[1] for r in con.sql(f"select doc_id, copies from ({mixing.sql('mixed')})").fetchall()}
    tok, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, t, *_ in left:
        ids = tok.encode(t, add_special_tokens=False).ids
        want += [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] * copies[i]
    assert got == sorted(want)


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [*documents()[:40], (None, "a clean text that has no id but some words in it to be judged", "en", None, 3), (1, None, None, None, None), (2, "dup dup dup row of words that repeat an id once more here", "en", "a", 1), (2, "dup dup dup row of words that repeat an id once more here", "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns
        assert stage(spark, df.limit(0), "").count() == 0
    assert quality.passing(df).where("doc_id is null").count() == 1


def test_a_worker_holds_one_operators_tables():
    """Python workers go from stage to stage, and what a stage before looked up must not stay beside the next one's."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    shingles = weakref.ref(ngramjoin.shingler(5, ()))
    assert ngramjoin.shingler(5, ()) is shingles()
    tree = weakref.ref(bpe.encoder(path))
    assert shingles() is None and bpe.encoder(path) is tree()
    letters = weakref.ref(langid.letters())
    assert tree() is None and langid.letters() is letters()
    ngramjoin.shingler(5, ())
    assert letters() is None
