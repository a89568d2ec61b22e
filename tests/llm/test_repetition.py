import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from polyad.errors import InvalidParameterError
from polyad.llm import repetition
from polyad.llm.repetition import fit_kneser_ney, letters_of, perplexities, perplexity_bands, repeated, repeated_letters


def brute(text, run):
    letters = [c for c in (text or "").lower() if unicodedata.category(c)[0] == "L"]
    seen, marked = set(), set()
    for k in range(len(letters) - run + 1):
        window = tuple(letters[k : k + run])
        if window in seen:
            marked.update(range(k, k + run))
        seen.add(window)
    return len(letters), len(marked)


def texts():
    rng = random.Random(6)
    out = [None, "", "  \n", "a" * 300, "ab" * 40, "x1y2" * 30, "İstanbul ΣΑΣ ß" * 4, "日本語のテキスト。" * 9, "😀1 " * 50]
    for _ in range(60):
        words = ["".join(rng.choices("abcdeé一Я", k=rng.randint(1, 7))) for _ in range(rng.randint(1, 40))]
        out.append(" ".join(words + rng.choices(words, k=rng.randint(0, 30)) + words[: rng.randint(0, 20)]))
    return out


@pytest.mark.parametrize("run", [1, 3, 5, 24])
def test_repeated(run):
    for text in texts():
        points = letters_of(text)
        assert (len(points), repeated(points, run)) == brute(text, run)


def test_equal_hashes_are_told_apart(monkeypatch):
    text = "abcdefg" * 5 + "hijklm" + "abcdefg"
    monkeypatch.setattr(np, "argsort", lambda x, kind=None: np.arange(len(x)))
    points = letters_of(text)
    assert len(repetition._later_runs(points, 6)) > 0
    monkeypatch.undo()
    assert repeated(points, 6) == brute(text, 6)[1]


def test_corpus(spark):
    rows = [(k, t, "n") for k, t in enumerate(texts())] + [(None, "ab" * 30, None), (3, "a" * 300, ""), (999, "lorem ipsum " * 20_000, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_letters string").repartition(3)
    got = sorted((tuple(r) for r in repeated_letters(df, run=24).collect()), key=repr)
    assert got == sorted(((i, *brute(t, 24)) for i, t, _ in rows), key=repr)
    assert repeated_letters(df.limit(0)).collect() == []
    with pytest.raises(InvalidParameterError):
        repeated_letters(df, run=0)


def model_of(corpus):
    """Interpolated modified Kneser-Ney over character trigrams, spelled out."""
    grams = Counter()
    for text in corpus:
        padded = "\x02\x02" + " ".join((text or "").lower().split())
        grams.update(padded[k - 2 : k + 1] for k in range(2, len(padded)))
    levels = {3: grams, 2: Counter(g[1:] for g in grams)}
    levels[1] = Counter(g[1:] for g in levels[2])
    stats = {}
    for order, counts in levels.items():
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = []
        for k in (1, 2, 3):
            raw = k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else 0
            d.append(raw if raw > 0 else 0.5 * k)
        total, freed = Counter(), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3) - 1]
        stats[order] = (counts, d, total, freed)

    def p(order, g):
        if order == 0:
            return 1 / (len(levels[1]) + 1)
        counts, d, total, freed = stats[order]
        x = g[:-1]
        if not total[x]:
            return p(order - 1, g[1:])
        c = counts[g]
        return max(c - d[min(c, 3) - 1], 0) / total[x] + freed[x] / total[x] * p(order - 1, g[1:]) if c else freed[x] / total[x] * p(order - 1, g[1:])

    return lambda text: [p(3, ("\x02\x02" + text)[k : k + 3]) for k in range(len(text))]


@pytest.mark.parametrize("held", [0, 10**6])
def test_kneser_ney(spark, held):
    rng = random.Random(7)
    corpus = [("en", " ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat"], k=rng.randint(1, 30)))) for _ in range(40)]
    corpus += [("EN-gb", "The Cat"), (None, "xyz xyz"), ("", None), ("en", ""), ("ja", "猫が猫を見た")]
    df = spark.createDataFrame([(k, lang, t, 1) for k, (lang, t) in enumerate(corpus)], "doc_id bigint, lang string, text string, perplexity int").repartition(3)
    model = fit_kneser_ney(df)
    fresh = spark.createDataFrame([(900, "en", "the dog sat"), (901, "fr", "le chat"), (902, "ja", "犬")], "doc_id bigint, lang string, text string")
    got = {r.doc_id: r for r in perplexities(df.select("doc_id", "lang", "text").union(fresh), model, held_rows=held).collect()}
    assert len(got) == len(corpus) + 3
    english = model_of([t for lang, t in corpus if lang and lang.lower().startswith("en")])
    for k, (lang, t) in [*enumerate(corpus), (900, ("en", "the dog sat"))]:
        if lang and lang.lower().startswith("en") and t:
            text = " ".join(t.lower().split())
            want = math.exp(-sum(map(math.log, english(text))) / len(text))
            assert got[k].perplexity == pytest.approx(want, rel=1e-9) and got[k].n_characters == len(text)
    assert got[41].lang == "und" and got[42].perplexity is None and got[43].perplexity is None
    banded = perplexity_bands(perplexities(df, model, held_rows=held), lower=0.1, upper=0.9).collect()
    rejected = [r for r in banded if r.rejected]
    assert rejected and all(r.perplexity < r.low or r.perplexity > r.high for r in rejected)
    assert {r.doc_id for r in banded} == set(range(len(corpus)))


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id bigint, lang string, text string")
    assert perplexity_bands(perplexities(df, fit_kneser_ney(df))).collect() == []
    with pytest.raises(InvalidParameterError):
        perplexity_bands(df, lower=0.9, upper=0.1)
