"""Learned words, segmentation against all paths, TF-IDF against loops."""

import math
import random
from collections import Counter

import pytest
from eventloom.functions import text as tx
from eventloom.operators import lexicon as lx

WORDS = ["苹果", "公司", "发布", "人工智能", "手机", "喜欢", "编程", "数据"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    single = "我你他的了在是很和也"
    rows = [(k, "".join(rng.choice(WORDS) if rng.random() < 0.6 else rng.choice(single) for _ in range(rng.randint(3, 15))) + rng.choice(["。", "，Python 3 ", " "])) for k in range(400)]
    return spark.createDataFrame([*rows, (900, None), (901, ""), (902, "no Chinese")], "doc_id int, text string").cache()


def grams(corpus, longest):
    out = Counter()
    sides = {}
    for r in corpus.collect():
        run = ""
        for c in (r.text or "") + " ":
            if "一" <= c <= "龥":
                run += c
                continue
            for i in range(len(run)):
                for k in range(1, min(longest, len(run) - i) + 1):
                    g = run[i : i + k]
                    out[g] += 1
                    left, right = sides.setdefault(g, (Counter(), Counter()))
                    left[run[i - 1] if i else "^"] += 1
                    right[run[i + k] if i + k < len(run) else "$"] += 1
            run = ""
    return out, sides


def test_learn(spark, corpus):
    got = {r.word: r for r in lx.learn(corpus).collect()}
    f, sides = grams(corpus, 4)
    total = sum(n for g, n in f.items() if len(g) == 1)
    h = lambda c: -sum(n / sum(c.values()) * math.log(n / sum(c.values())) for n in c.values())
    want = {}
    for g, n in f.items():
        tight = min((n * total / f[g[:k]] / f[g[k:]] for k in range(1, len(g))), default=None)
        free = min(map(h, sides[g]))
        if len(g) == 1:
            want[g] = (n, None, None)
        elif n >= 5 and tight >= 10 and free >= 0.5:
            want[g] = (n, pytest.approx(tight), pytest.approx(free))
    assert {w: (r.f, r.cohesion, r.freedom) for w, r in got.items()} == want
    assert set(WORDS) <= set(got) and "人工" not in got


def test_segmenter():
    rng = random.Random(1)
    counts = {"".join(rng.choices("甲乙丙", k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(25)}
    counts.pop("丙", None)
    cut = lx.Segmenter(counts)
    total = sum(counts.values())

    def paths(run):
        if not run:
            yield []
        for k in range(1, len(run) + 1):
            if run[:k] in counts or k == 1:
                yield from ([run[:k], *rest] for rest in paths(run[k:]))

    score = lambda path: sum(math.log(counts.get(w, 1) / total) for w in path)
    for _ in range(300):
        run = "".join(rng.choices("甲乙丙丁", k=rng.randint(0, 9)))
        got = cut.cut(run)
        assert "".join(got) == run and score(got) == pytest.approx(max(map(score, paths(run))))


def test_tokenize(spark, corpus):
    lexicon = lx.learn(corpus)
    docs = spark.createDataFrame([(1, "我喜欢用Python编程，3.5 倍！"), (2, None), (3, " \n"), (4, "The end")], "id int, text string")
    got = {r.id: r.tokens for r in lx.tokenize(docs, lexicon).collect()}
    assert got == {1: ["我", "喜欢", "用", "Python", "编程", "，3.5", "倍", "！"], 2: [], 3: [], 4: ["The", "end"]}
    few = lx.tokenize(docs, lexicon, most=1).where("id = 1").first().tokens
    assert few[:4] == ["我", "喜", "欢", "用"]


@pytest.mark.parametrize("most", [500_000, 3])
def test_keywords(spark, corpus, most):
    docs = lx.tokenize(corpus, lx.learn(corpus))
    model = lx.document_frequencies(docs, most=most)
    rows = [(r.doc_id, [t.lower() for t in r.tokens]) for r in docs.collect()]
    df = Counter(t for _, ts in [(k, set(x.tokens)) for k, x in enumerate(docs.collect())] for t in ts)
    kept = dict(sorted(df.items(), key=lambda r: (-r[1], r[0]))[:most])
    rarest = min(kept.values()) if len(kept) >= most else 1
    got = {r.doc_id: [(x.term, x.weight) for x in r.keywords] for r in lx.keywords(docs, model, top=4, most=most).collect()}
    for key, tokens in rows:
        good = [t for t in tokens if len(t) >= 2 and t not in tx.STOPWORDS]
        weight = {t: good.count(t) / len(good) * math.log(404 / (1 + kept.get(t, rarest))) for t in good}
        want = sorted(weight.items(), key=lambda r: (-r[1], good.index(r[0])))[:4]
        assert [(t, pytest.approx(w)) for t, w in want] == got[key]
