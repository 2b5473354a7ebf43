"""Language ID and the quality classifier: held-out accuracy and defined results."""

import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import langid, quality


def test_languages_of_held_out_texts(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = langid.op2_language_id(spark, sf_small).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").collect()
    assert len(held) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert out.count() == docs.count() and all(0 <= r["score"] <= 1 for r in held)


def test_word_first_then_shorter_grams(spark):
    train = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "die katze sitzt auf der matte", "de"), (3, "the the the", "en"), (4, "x", None), (5, None, "en")], "doc_id long, text string, lang string")
    model = langid.fit(train, least=1)
    assert model["langs"] == ["en", "de"]
    docs = spark.createDataFrame([(1, "The THE"), (2, "katzen"), (3, None), (4, ""), (5, "12 !?"), (6, "日本"), (None, "die matte"), (7, "die " * 200_000)], "doc_id long, text string").selectExpr("*", "1 AS score", "'q' AS lang_pred")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, None, 7)] == ["en", "de", "und", "und", "und", "de", "de"]
    assert got[3][1] == got[5][1] == 0 and got[6] == ("en", 0.0) and got[1][1] > 0.9
    kept = langid.accepted(docs, model, 0.3)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, None, 7}


def brute_scores(model, text):
    """The same backoff, word by word."""
    import re

    words = re.findall(r"[^\W\d_]+", text.lower())
    code = lambda s: np.array([33 if c == " " else ord(c) + 1 for c in s], np.uint64)
    tables = {k: {int(h): v for h, v in zip(keys, scores, strict=True)} for k, (keys, scores) in model["kinds"].items()}

    def h(s, n):
        c = code(s)
        return int((langid.runs_hash(c, np.array([0]), np.array([c.size])) ^ langid.SALT[n])[0])

    found = []
    for w in words:
        if (hit := tables[0].get(h(w, 0))) is not None:
            found.append(hit)
            continue
        edged = f" {w} "
        for n in langid.ORDERS:
            whole = edged if n > 1 else w
            hits = [x for i in range(len(whole) - n + 1) if (x := tables[n].get(h(whole[i : i + n], n))) is not None]
            if hits:
                found.append(np.mean(hits, 0))
                break
    return np.mean(found, 0) if found else None


def test_scores_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    model = langid.fit(docs.where("doc_id < 40"), keep=500)
    texts = [r["text"][:600] for r in docs.where("doc_id >= 40 AND doc_id < 80").collect()]
    tables = {k: langid.Table(keys) for k, (keys, _) in model["kinds"].items()}
    pred, sure = langid.score_texts(model, tables, texts)
    for t, p, s in zip(texts, pred, sure, strict=True):
        want = brute_scores(model, t)
        assert model["langs"][int(want.argmin())] == p and abs(s - 1 / (10.0 ** (want.min() - want)).sum()) < 1e-4


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(none)
    assert langid.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first()["lang_pred"] == "und"
    assert langid.predict(none, model).collect() == []


def test_quality_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality.fit(docs.where(~out), labels)
    assert model[1][0] < model[1][1], "thresholds ascend"
    got = quality.grade(docs.where(out), model).join(labels, "doc_id").collect()
    clean = [r for r in got if r["quality"] == 1 and r["toxic"] == 0]
    low = [r for r in got if r["quality"] == 0]
    assert np.mean([r["p_good"] >= 0.5 for r in clean]) > 0.9 and np.mean([r["p_good"] < 0.5 for r in low]) > 0.8
    assert all(0 <= r["p_good"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)


def test_quality_defined_results(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "good words here"), (None, "BAD!! BAD!!"), (4, "good words here"), (5, "w " * 300_000)], "doc_id long, text string").selectExpr("*", "0 AS p_good", "0 AS grade")
    none = spark.createDataFrame([(1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) is None
    got = quality.grade(docs, None).collect()
    assert len(got) == 7 and {r["doc_id"]: r["p_good"] for r in got}[2] == 0 and {r["doc_id"]: r["p_good"] for r in got}[4] == 1
    kept = quality.selected(docs, None)
    assert kept.columns == docs.columns and kept.count() == 4
    twice = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs.where("doc_id = 4 OR doc_id = 5"), twice) is not None
    assert quality.grade(spark.createDataFrame([], "doc_id long, text string"), None).collect() == []


def test_likelihood_gradient_by_differences():
    """The gradient of the loss against differences of the loss itself, computed text by text."""
    rnd = np.random.default_rng(1)
    grade = rnd.integers(0, 3, 60)
    lists = [rnd.choice(9, rnd.integers(0, 6), replace=False) for _ in grade]
    row, col = np.repeat(np.arange(60), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64)
    p = rnd.normal(size=11)

    def plain(p):
        sig = lambda x: 1 / (1 + np.exp(-x))
        t, total = [p[-2], p[-2] + np.exp(p[-1])], 0.0
        for g, x in zip(grade, lists, strict=True):
            s = p[x].sum()
            below = [sig(t[0] - s), sig(t[1] - s), 1.0]
            total -= np.log(below[g] - (below[g - 1] if g else 0.0)) / (np.mean(grade == g) * 3) / 60
        return total + 0.01 / 2 * (p[:-2] @ p[:-2])

    value, g = quality.loss(p, row, col, grade, 0.01)
    assert abs(value - plain(p)) < 1e-9
    for i in range(p.size):
        step = np.zeros(p.size)
        step[i] = 1e-5
        assert abs((plain(p + step) - plain(p - step)) / 2e-5 - g[i]) < 1e-6


def test_training_orders_grades():
    rnd = np.random.default_rng(1)
    grade = rnd.integers(0, 3, 300)
    index, begin = [], [0]
    for g in grade:
        index += [10 + g] + [100 + int(x) for x in rnd.integers(0, 50, 5)]
        begin.append(len(index))
    w, t = quality.train(np.array(index), np.array(begin), grade)
    assert w[10] < w[11] < w[12] and t[0] < t[1]


def test_features_against_brute_force():
    """Distinct words, shapes and shares of every text, by plain loops."""
    texts = ["The cat, the CAT; sat!! on (the) mat", "", None, "a a a a", "WOW WOW buy now!!! 50% off $$$", "éa b-c b-c x3 3", "w " * 60, "one Two tHREE four!"]
    import pyarrow as pa

    from lodestone.llm.textscan import U, mix, powers, text_bytes

    def spot(h):
        return int(h >> U(64 - quality.BITS))

    def word_code(w):
        raw = w.encode()
        begin = next(i for i, b in enumerate(raw) if quality._CORE[b])
        up, acc = powers(len(raw) + 1)[0], 0
        for i, b in enumerate(raw[begin:]):
            acc = (acc + int(quality._CORE[b]) * int(up[i])) % 2**64
        return spot(mix(np.array([acc], U))[0]), acc

    def extra(code):
        return spot(mix(np.array([code], U) * U(0x9E3779B97F4A7C15) + U(7))[0])

    buf, offs = text_bytes(pa.array(texts, pa.string()))
    index, begin = quality.features(buf, offs)
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        has = [w for w in ws if any(c.isascii() and c.isalnum() or not c.isascii() for c in w)]
        want = {word_code(w)[0] for w in has}
        different = len(want)
        alnum = lambda c: c.isascii() and c.isalnum() or not c.isascii()
        caps = lambda w: sum(c.isascii() and c.isupper() for c in w)
        shapes = {
            1: [w for w in ws if caps(w) >= 2 and not any(c.isascii() and c.islower() for c in w)],
            2: [w for w in ws if w not in has],
            3: [w for w in ws if any(c.isascii() and c.isdigit() for c in w)],
            **{10 + k: [w for w in ws if w[-1] == c] for k, c in enumerate("!*#%$&|~?;:")},
            30: [w for w in ws if len(w) > 1 and not alnum(w[-1]) and not alnum(w[-2])],
            31: [w for w in has if caps(w) > 1 and caps(w) < sum(len(c.encode()) for c in w if alnum(c))],
            32: [b for a, b in zip(ws, ws[1:], strict=False) if (a in has, b in has) == (True, True) and word_code(a)[1] == word_code(b)[1] or a not in has and b not in has],
        }
        for code, found in shapes.items():
            want |= {extra(code * 8 + step) for step, bound in enumerate((0.02, 0.1, 0.3, 0.6)) if ws and len(found) / len(ws) > bound}
        if len(ws) >= 40:
            want |= {extra(500 + step) for step, bound in enumerate((0.05, 0.15, 0.25, 0.35, 0.5)) if different / len(ws) < bound}
        assert set(index[begin[i] : begin[i + 1]].tolist()) == want, t


def test_probabilities_of_a_text_and_ties_at_the_cut(spark):
    """P(grade > k) from the thresholds; a text whose probability equals the cut is selected; clashing label columns."""
    w = np.zeros(1 << quality.BITS, np.float32)
    model = (w, np.array([-1.0, 0.0]))
    df = spark.createDataFrame([(1, "some words"), (2, ""), (1, "some words")], "doc_id long, text string").selectExpr("*", "1 AS quality", "0 AS toxic", "2 AS selected")
    got = sorted((r["doc_id"], round(r["expected_grade"], 9), r["p_good"]) for r in quality.grade(df, model).collect())
    assert got == [(1, round(0.5 + 1 / (1 + np.exp(-1.0)), 9), 0.5)] * 2 + [(2, 0.0, 0.0)]
    assert [r["doc_id"] for r in quality.selected(df, model, 0.5).collect()] == [1, 1]
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 1, "y")], "doc_id long, quality int, toxic int, text string")
    assert quality.fit(df, labels) is not None
