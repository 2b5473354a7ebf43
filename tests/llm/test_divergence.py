"""The source audit against loops over dictionaries."""

import random
import re
from collections import Counter, defaultdict
from itertools import product

import pytest

from lodestone.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, p long, by int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(docs, least, top):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in docs]
    inside = defaultdict(Counter)
    for lang, _, t in terms:
        inside[lang].update(set(t))
    vocab = {lang: {t for t, n in c.items() if n >= least} for lang, c in inside.items()}
    counts, groups = defaultdict(Counter), defaultdict(set)
    for lang, source, t in terms:
        groups[lang].add(source)
        kept = [x for x in t if x in vocab[lang]]
        counts[lang, source].update(kept)
        counts[lang, None].update(kept)
    share = lambda key, t: 1 + 10**9 * (counts[key][t] + 1) // (counts[key].total() + len(vocab[key[0]]))
    out = set()
    for lang in groups:
        for source in groups[lang]:
            far = {}
            for item in groups[lang] - {source}:
                far[item] = sum((share((lang, source), t) - share((lang, item), t)) ** 2 // share((lang, item), t) for t in vocab[lang])
            near = {t: (share((lang, source), t) - share((lang, None), t)) ** 2 // share((lang, None), t) for t in vocab[lang] if counts[lang, source][t] and share((lang, source), t) > share((lang, None), t)}
            for part, found, most in (("pair", far, None), ("term", near, top)):
                ranked = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, source, part, item, v, k + 1) for k, (item, v) in enumerate(ranked)}
    return out


def corpus():
    rnd = random.Random(11)
    words = ["Haus", "haus", "Straße", "über", "été", "x", "don't", "日本語", "𝒳𝒴", "İ", "é", "a1b", "_q_", "tab\there", "nul\x00nul", "end.", "\x7f", "ﬁ"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i, j in product(range(12), repeat=2)]
    docs = []
    for _ in range(150):
        lang = rnd.choice(["de", "de", "de", "fr", None, ""])
        source = rnd.choice(["a", "b", "c", None, "Ä", "Z", ""])
        docs.append((" ".join(rnd.choices(words, k=rnd.randrange(60))), lang, source))
    docs += [(None, "de", "silent"), ("", "de", "a"), ("123 ... 456", "xx", "s1"), ("once", "xx", "s2"), ("once", "xx", "s3"), (None, "one", "alone"), ("long " * 200_000 + "haus", "de", "b")]
    return docs + docs[:20]


@pytest.mark.parametrize("broadcast_rows", [10_000, 0])
@pytest.mark.parametrize(("least", "top"), [(3, 200), (2, 4)])
def test_divergence(spark, broadcast_rows, least, top):
    docs = corpus()
    df = spark.createDataFrame([(i, *d, "clash", 9, 1) for i, d in enumerate(docs)], SCHEMA).repartition(5)
    got = [tuple(r) for r in divergence.divergence(df, least, top, broadcast_rows=broadcast_rows).collect()]
    want = expected(docs, least, top)
    assert len(got) == len(set(got)) == len(want) and set(got) == want
    assert {r[4] for r in got if r[0] == "xx"} == {0}


def test_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([("a b", None, None)], "text string, lang string, source string")
    assert divergence.divergence(one).collect() == []


def test_shares_are_exact(spark):
    """Counts that pass 64 bits when scaled."""
    from pyspark.sql import functions as F

    rnd = random.Random(2)
    values = [(c, c + rnd.randrange(1, 10**9)) for c in [0, 1, 4611686017, 4611686018, 10**10, 9 * 10**17] + [rnd.randrange(10**13) for _ in range(50)]]
    got = spark.createDataFrame(values, "c long, n long").select(divergence.share(F.col("c"), F.col("n"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 1) // n for c, n in values]
