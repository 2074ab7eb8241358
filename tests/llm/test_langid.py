import random
import zlib

import numpy as np

from tessera.llm import langid

SYL = {"xx": "ka lo mi tu ren".split(), "yy": "éa ßo shu gri van".split(), "zz": "что да нет мы".split()}


def frame(spark):
    rng, rows = random.Random(0), []
    for i in range(240):
        k = rng.choice(list(SYL))
        rows.append((i, " ".join("".join(rng.choice(SYL[k]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 60))), k if i % 7 else None, 0.1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), rows


def test_predictions(spark):
    df, rows = frame(spark)
    more = [(900, None, "xx", 0.0), (901, "", "xx", 0.0), (902, "123 !! \n", None, 0.0), (None, "kalomi turen", "xx", 0.0), (903, "karen " * 30000, None, 0.0), (903, "karen " * 30000, None, 0.0), (904, "漢字", None, 0.0)]
    got = langid.identify(df.union(spark.createDataFrame(more, df.schema))).collect()
    assert len(got) == len(rows) + len(more)
    by = {r["doc_id"]: r for r in got}
    truth = {i: k for i, _, k, _ in rows}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i]["held_out"] == (i in out) for i in truth)
    assert np.mean([by[i]["lang_pred"] == truth[i] for i in out if truth[i]]) > 0.98
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[903]["lang_pred"] == "xx" and by[904]["lang_pred"] in SYL
    assert all(0 <= r["score"] <= 1 for r in got)


def test_recognised(spark):
    """Texts that no filter supports go; where nothing can be learned, texts with letters stay."""
    df, rows = frame(spark)
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("bcdfghjpqwxz") for _ in range(7)) for _ in range(40))
    more = [(900, "漢字 " * 40, None, 0.0), (901, noise, None, 0.0), (902, "123 !!", None, 0.0), (903, None, "xx", 0.0), (904, "kalomi turen kami", None, 0.0)]
    odd = spark.createDataFrame(more, df.schema)
    assert {r["doc_id"] for r in langid.recognised(df.union(odd)).collect()} == {r[0] for r in rows} | {904}
    for none in (odd.selectExpr("doc_id", "text", "cast(null as string) as lang"), odd.selectExpr("doc_id", "text", "if(doc_id = 904, 'xx', null) as lang")):
        assert {r["doc_id"] for r in langid.recognised(none).collect()} == {900, 901, 904}


def test_counts_by_hand():
    """The sliced filters answer as one filter for each language would."""
    letter = langid.letters()
    rng = np.random.default_rng(0)
    tables = [rng.integers(0, 8, 1 << 10, dtype=np.uint64)]
    texts = ["Ab cd é!", "", "zzz top 1a", None, "q"]
    model = langid.Model(["a", "b", "c"], tables)
    got = model.predict(texts, letter)
    for t, (lang, score) in zip(texts, got, strict=True):
        flat = [0] * 4 + [ord(c) if c.isalpha() else 0 for c in (t or "").lower()] + [0] * 4
        n, counts = 0, [0, 0, 0]
        for size in langid.SIZES:
            for i in range(len(flat) - 4):
                w = flat[i : i + size]
                if w[1]:
                    h, _ = langid.grams(np.array(w, np.uint32), size)
                    one, two = langid.slots(h, 1 << 10)
                    m = int(tables[0][one[0]] & tables[0][two[0]])
                    n += 1
                    counts = [c + (m >> k & 1) for k, c in enumerate(counts)]
        right = [max(0, (c - n * f) / (1 - f)) for c, f in zip(counts, model.false, strict=True)]
        if not any(flat):
            assert (lang, score) == ("und", 0.0)
        elif sum(right):
            assert lang == "abc"[int(np.argmax(right))] and abs(score - max(right) / sum(right)) < 1e-9


def test_pieces_of_long_texts(monkeypatch):
    """A text's n-grams and prediction are the same however it is cut, and whatever stands beside it."""
    letter, rng = langid.letters(), np.random.default_rng(1)
    model = langid.Model(["a", "b"], [rng.integers(0, 4, 1 << 10, dtype=np.uint64)])
    texts = ["".join(rng.choice(list("abc é1"), n)) for n in (0, 1, 2, 5, 16, 17, 18, 19, 33, 300)] + [None]
    whole = model.judged(texts, letter)
    assert whole == [model.judged([t], letter)[0] for t in texts]
    for n in (5, 8, 16, 64):
        monkeypatch.setattr(langid, "CHUNK", n)
        assert model.judged(texts, letter) == whole


def test_learned_tables(spark):
    """The filters hold just the n-grams that a count by hand chooses."""
    df, rows = frame(spark)
    model = langid.fit(df, per_language=10**6, n_slots=1 << 14)
    counts, chars = {}, {}
    for _, t, k, _ in rows:
        if k:
            flat = [0] * 4 + [ord(c) if c.isalpha() else 0 for c in t.lower()] + [0] * 4
            chars[k] = chars.get(k, 0) + len(t)
            for size in langid.SIZES:
                for i in range(len(flat) - size + 1):
                    if flat[i + 1]:
                        counts.setdefault(tuple(flat[i : i + size]), {}).setdefault(k, [0])[0] += 1
    want = np.zeros(1 << 14, np.uint64)
    for gram, by in counts.items():
        rate = {k: n[0] / chars[k] for k, n in by.items() if n[0] >= langid.MIN_COUNT}
        for k, r in rate.items():
            if r * langid.RATIO >= max(rate.values()):
                for s in langid.slots(langid.grams(np.array(gram, np.uint32), len(gram))[0], 1 << 14):
                    want[s] |= np.uint64(1 << sorted(chars).index(k))
    assert model.languages == sorted(chars) and (model.tables[0] == want).all()


def test_nothing_to_learn(spark):
    df, _ = frame(spark)
    assert {r["lang_pred"] for r in langid.identify(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_many_languages(spark):
    rows = [(i * 70 + k, f"{chr(0x400 + k) * 3}{chr(0x500 + k) * 2} " * 20, f"l{k:03d}") for i in range(3) for k in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.fit(df)).collect()
    truth = {a: c for a, _, c in rows}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.95


def test_all_rows_count(spark, monkeypatch):
    """Filters hold what few of many labelled rows show, and a usual support is that of all, whatever a task holds at once."""
    rows = [(i, "kalo miren tulo " * 3 + ("wqzzjwqzzj" if i in (4001, 4003, 4007) else ""), "xx") for i in range(6000)]
    rows += [(i, "kalo miren tulo vbbgd", "xx") for i in range(6000, 6200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(df)
    (table,) = model.tables
    for size in langid.SIZES:
        one, two = langid.slots(langid.grams(np.array(list(map(ord, "wqzzjwqzzj")), np.uint32), size)[0], len(table))
        assert (table[one] & table[two] & np.uint64(1)).all()
    monkeypatch.setattr(langid, "HELD", 5)
    assert (langid.fit(df).tables[0] == table).all()
    # the median of all rows is 1: a text with a known third goes
    odd = spark.createDataFrame([(9000, "kalo " + "ggkkpp " * 9, None)], df.schema)
    assert langid.recognised(df.union(odd)).count() == len(rows)


def test_tally():
    a, n = langid.tally(np.array([2, 5], np.uint64), np.array([1, 3]), np.array([1, 2, 9], np.uint64), np.array([4, 5, 6]))
    assert a.tolist() == [1, 2, 5, 9] and n.tolist() == [4, 6, 3, 6]
    assert [x.tolist() for x in langid.tally(*langid.NONE, *langid.tally(*langid.NONE, a, n))] == [a.tolist(), n.tolist()]
