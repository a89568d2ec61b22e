"""Repetition inside a document.

Two measures. ``repeated_letters`` is exact: the share of a text's letters that lie in a run which the same
text has had before, found in the sorted hashes of all its runs. ``perplexities`` is the n-gram measure: a
modified Kneser-Ney model of character trigrams per language, counted by Spark over the whole corpus and
kept in sorted arrays, under which very predictable and very improbable documents fall outside a band of
their language. A corpus model can't tell how much of a text repeats that same text (a page of ordinary
prose given twice is as ordinary as given once), so the exact measure doesn't build on it.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError
from polyad.runtime import cut, is_mounted

#: Bits of a code point in a packed trigram.
BITS = 21
MASK = (1 << BITS) - 1
#: Stands before a text's first character, twice.
START = 2
#: Trigrams of the model that every worker may hold (12 bytes each); a larger model is joined by a shuffle.
HELD_ROWS = 8_000_000
#: Trigram occurrences counted at once by a worker.
ROOM = 4_000_000

#: Languages that there may be: tables of one row per language are broadcast up to this many rows, and joined by a shuffle beyond.
LANGUAGES = 100_000

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether each code point is of category L."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), dtype=bool))
    return _letters[0]


def letters_of(text: str | None) -> np.ndarray:
    """The letters of the lower-cased text, as code points in order."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points[_is_letter()[points]]


def repeated(points: np.ndarray, run: int) -> int:
    """How many of ``points`` lie in a run of ``run`` that also starts earlier; the two may overlap."""
    n = len(points) - run + 1
    if n < 2:
        return 0
    # hashes of windows of 1, 2, 4, ... points, joined to one of `run` points
    with np.errstate(over="ignore"):
        power, width, left = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1, run
        total, at = np.zeros(n, np.uint64), 0
        while True:
            if left & 1:
                total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + power[at : at + n]
                at += width
            left >>= 1
            if not left:
                break
            power = (power[:-width] ^ (power[:-width] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + power[width:]
            width *= 2
    order = np.argsort(total, kind="stable")
    same = total[order[1:]] == total[order[:-1]]
    later, earlier = order[1:][same], order[:-1][same]
    if len(later):
        windows = np.lib.stride_tricks.sliding_window_view(points, run)
        for start in range(0, len(later), 65_536):
            part = slice(start, start + 65_536)
            if (windows[later[part]] != windows[earlier[part]]).any():  # different runs of one hash: compare the runs themselves
                later = _later_runs(points, run)
                break
    change = np.zeros(len(points) + 1, np.int64)
    change[later] += 1
    change[later + run] -= 1
    return int((np.cumsum(change)[:-1] > 0).sum())


def _later_runs(points: np.ndarray, run: int) -> np.ndarray:
    seen: set[bytes] = set()
    found = []
    data = points.astype(np.uint32)
    for k in range(len(points) - run + 1):
        window = data[k : k + run].tobytes()
        if window in seen:
            found.append(k)
        seen.add(window)
    return np.array(found, dtype=np.int64)


def repeated_letters(documents: DataFrame, *, run: int = 24, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``n_letters`` and ``n_repeated`` (BIGINT) of every document.

    Of the lower-cased text only letters count. A run of ``run`` letters that also starts at an earlier
    place is a repeat, and a letter is repeated if it lies in one. Null, empty and short texts have 0
    repeated letters. A row stays a row; other columns are dropped. One pass, no shuffle.
    """
    if run < 1:
        raise InvalidParameterError("run must be at least 1")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, again = [], []
            for text in batch.column(1):
                points = letters_of(text.as_py())
                kept.append(len(points))
                again.append(repeated(points, run))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.int64()), pa.array(again, pa.int64())], names=["key", "n_letters", "n_repeated"])

    source = documents.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(go, f"key {kind}, n_letters bigint, n_repeated bigint").withColumnRenamed("key", id_column)


# -- the n-gram model


def language(lang: Column) -> Column:
    """Language without region, case and blanks; ``und`` where there is none."""
    base = F.lower(F.trim(F.substring_index(F.substring_index(lang, "-", 1), "_", 1)))
    return F.when(lang.isNull() | (base == ""), F.lit("und")).otherwise(base)


def trigrams_of(text: str | None) -> np.ndarray:
    """Packed trigrams of the lower-cased text with its white space made single blanks, one per character."""
    points = np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    padded = np.concatenate([np.array([START, START], np.int64), points])
    return padded[:-2] << (2 * BITS) | padded[1:-1] << BITS | padded[2:]


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}
    room = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            grams = trigrams_of(text.as_py())
            held.setdefault(lang, []).append(grams)
            room += len(grams)
            if room >= ROOM:
                yield from flush()
                room = 0
    yield from flush()


def _by_language(df: DataFrame) -> DataFrame:
    """A table of one row per language, written once; broadcast, for its rows are counted and few."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= LANGUAGES else df


def _discounts(counts: DataFrame) -> DataFrame:
    """The three discounts of each language, from how many n-grams have count 1 to 4; 0.5, 1 and 1.5 where those say nothing."""
    of = [F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    found = counts.groupBy("lang").agg(*of).withColumn("y", F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")))
    out = []
    for k in (1, 2, 3):
        raw = F.lit(float(k)) - F.try_divide((k + 1) * F.col("y") * F.col(f"n{k + 1}"), F.col(f"n{k}"))
        known = (F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0) & (raw > 0)
        out.append(F.when(known, raw).otherwise(F.lit(0.5 * k)).alias(f"d{k}"))
    return found.select("lang", *out)


def _level(counts: DataFrame, context: Column, by_language: bool) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, context, own part of the probability) and (lang, context, weight of the lower order); ``by_language``: there is one context per language."""
    counts = counts.join(_by_language(_discounts(counts)), "lang").withColumn("context", context)
    less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    contexts = counts.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum(less).alias("freed")).select("lang", "context", "total", (F.col("freed") / F.col("total")).alias("weight"))
    if by_language:
        contexts = _by_language(contexts)
    own = counts.join(contexts.select("lang", "context", "total"), ["lang", "context"]).select("lang", "gram", "context", (F.greatest(F.col("n") - less, F.lit(0.0)) / F.col("total")).alias("own"))
    return own, contexts.select("lang", "context", "weight")


@dataclass
class KneserNey:
    """Tables (lang, gram, log_p) of orders 3, 2, 1 and (lang, context, log_weight) of orders 3, 2, 1; order 1 has the context 0."""

    grams: dict[int, DataFrame]
    weights: dict[int, DataFrame]
    alphabet: DataFrame

    def rows(self) -> int:
        return sum(df.count() for df in [*self.grams.values(), *self.weights.values()])


def fit_kneser_ney(documents: DataFrame, *, lang_column: str = "lang", text_column: str = "text") -> KneserNey:
    """Modified Kneser-Ney over character trigrams of each language, from the whole texts of all documents.

    Lower orders count in how many contexts a character occurs; the lowest mixes with the uniform
    distribution over the language's characters and one unseen character.
    """
    texts = documents.select(language(F.col(lang_column)).alias("lang"), F.col(text_column).alias("text"))
    counted = texts.mapInArrow(_count_trigrams, "lang string, gram bigint, n bigint")
    c3 = cut(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    c2 = cut(c3.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).alias("gram")).agg(F.count("*").alias("n")))
    c1 = cut(c2.groupBy("lang", F.col("gram").bitwiseAND(F.lit(MASK)).alias("gram")).agg(F.count("*").alias("n")))
    alphabet = cut(c1.groupBy("lang").agg((F.count("*") + 1).alias("characters")))
    few = alphabet.count() <= LANGUAGES
    grams, weights, lower = {}, {}, None
    for order, counts, context in ((1, c1, F.lit(0).cast("bigint")), (2, c2, F.shiftright("gram", BITS)), (3, c3, F.shiftright("gram", BITS))):
        own, weight = _level(counts, context, order == 1)
        both = own.join(weight, ["lang", "context"])
        if order == 1:
            p = both.join(F.broadcast(alphabet) if few else alphabet, "lang").select("lang", "gram", (F.col("own") + F.col("weight") / F.col("characters")).alias("p"))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << (order - 1) * BITS) - 1))
            below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            p = both.withColumn("suffix", suffix).join(below, ["lang", "suffix"]).select("lang", "gram", (F.col("own") + F.col("weight") * F.col("below")).alias("p"))
        lower = cut(p)
        grams[order] = lower.select("lang", "gram", F.log("p").alias("log_p"))
        weights[order] = cut(weight.select("lang", "context", F.log("weight").alias("log_weight")))
    return KneserNey(grams, weights, alphabet)


class _Arrays:
    """The model in sorted arrays, read by a worker from the tables on the shared folder."""

    def __init__(self, files: dict[str, list[str]]):
        self.tables: dict[str, dict[str, tuple[np.ndarray, np.ndarray]]] = {}
        import pyarrow.dataset as ds

        for name, paths in files.items():
            frame = ds.dataset(paths, format="parquet").to_table().to_pandas() if paths else pd.DataFrame({"lang": [], "k": [], "v": []})
            frame.columns = ["lang", "k", "v"]
            self.tables[name] = {}
            for lang, part in frame.groupby("lang", sort=False):
                order = np.argsort(part["k"].to_numpy())
                self.tables[name][lang] = (part["k"].to_numpy(dtype=np.int64)[order], part["v"].to_numpy(dtype=np.float64)[order])

    def find(self, table: str, lang: str, keys: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
        known, values = self.tables[table].get(lang, (np.zeros(0, np.int64), np.zeros(0)))
        if not len(known):
            return np.full(len(keys), missing), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        return np.where(hit, values[at], missing), hit

    def log_p(self, lang: str, grams: np.ndarray) -> np.ndarray:
        out, hit = self.find("g3", lang, grams, 0.0)
        rest = np.flatnonzero(~hit)
        if len(rest):
            out[rest] = self._backed_off(lang, grams[rest])
        return out

    def _backed_off(self, lang: str, grams: np.ndarray) -> np.ndarray:
        two = grams & ((1 << 2 * BITS) - 1)
        low, hit = self.find("g2", lang, two, 0.0)
        rest = np.flatnonzero(~hit)
        if len(rest):
            one, seen = self.find("g1", lang, two[rest] & MASK, 0.0)
            size = self.find("a", lang, np.zeros(1, np.int64), 2.0)[0][0]
            one = np.where(seen, one, self.find("w1", lang, np.zeros(1, np.int64), 0.0)[0][0] - np.log(size))
            low[rest] = one + self.find("w2", lang, two[rest] >> BITS, 0.0)[0]
        return low + self.find("w3", lang, grams >> BITS, 0.0)[0]


_arrays: dict[tuple, _Arrays] = {}


def _scores_by_arrays(texts: DataFrame, model: KneserNey, kind: str) -> DataFrame:
    named = {f"g{k}": df for k, df in model.grams.items()} | {f"w{k}": df for k, df in model.weights.items()}
    tables = {name: cut(df.toDF("lang", "k", "v")) for name, df in named.items()}
    tables["a"] = cut(model.alphabet.select("lang", F.lit(0).cast("bigint").alias("k"), F.col("characters").cast("double").alias("v")))
    files = {name: [f.removeprefix("file://").replace("file:/", "/") for f in df.inputFiles()] for name, df in tables.items()}
    mark = tuple(sorted((name, tuple(f)) for name, f in files.items()))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _arrays:
            _arrays.clear()
            _arrays[mark] = _Arrays(files)
        model = _arrays[mark]
        for batch in batches:
            sums, sizes = [], []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                grams = trigrams_of(text.as_py())
                sums.append(float(model.log_p(lang, grams).sum()))
                sizes.append(len(grams))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.float64()), pa.array(sizes, pa.int64())], names=["key", "lang", "log_p", "n"])

    return texts.mapInArrow(go, f"key {kind}, lang string, log_p double, n bigint")


def _scores_by_join(texts: DataFrame, model: KneserNey, kind: str) -> DataFrame:
    """The same for a model of any size: distinct trigrams find their probability, documents' trigrams join these."""

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                grams, counts = np.unique(trigrams_of(batch.column(2)[k].as_py()), return_counts=True)
                if not len(grams):
                    grams, counts = np.array([-1]), np.array([0])
                at = pa.array(np.full(len(grams), k))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(3).take(at), pa.array(grams), pa.array(counts)], names=["key", "lang", "row", "gram", "n"])

    numbered = cut(texts.withColumn("row", F.monotonically_increasing_id()))
    held = cut(numbered.mapInArrow(grams_of, f"key {kind}, lang string, row bigint, gram bigint, n bigint"))
    low = F.lit((1 << 2 * BITS) - 1)
    wanted = held.select("lang", "gram").distinct().withColumn("two", F.col("gram").bitwiseAND(low)).withColumn("one", F.col("gram").bitwiseAND(F.lit(MASK)))
    for order, key, column in ((3, "gram", "p3"), (2, "two", "p2"), (1, "one", "p1")):
        wanted = wanted.join(model.grams[order].select("lang", F.col("gram").alias(key), F.col("log_p").alias(column)), ["lang", key], "left")
    wanted = wanted.withColumn("x3", F.shiftright("gram", BITS)).withColumn("x2", F.shiftright("two", BITS)).withColumn("x1", F.lit(0).cast("bigint"))
    for order in (3, 2, 1):
        weight = model.weights[order].select("lang", F.col("context").alias(f"x{order}"), F.col("log_weight").alias(f"w{order}"))
        wanted = wanted.join(_by_language(weight) if order == 1 else weight, ["lang", f"x{order}"], "left")
    wanted = wanted.join(_by_language(model.alphabet), "lang", "left")
    zero = F.lit(0.0)
    p1 = F.coalesce("p1", F.coalesce("w1", zero) - F.log(F.coalesce(F.col("characters").cast("double"), F.lit(2.0))))
    p2 = F.coalesce(F.col("p2"), p1 + F.coalesce("w2", zero))
    p3 = F.coalesce(F.col("p3"), p2 + F.coalesce("w3", zero))
    scored = held.join(wanted.select("lang", "gram", p3.alias("log_p")), ["lang", "gram"])
    return scored.groupBy("row").agg(F.first("key").alias("key"), F.first("lang").alias("lang"), F.sum(F.col("log_p") * F.col("n")).alias("log_p"), F.sum("n").alias("n")).drop("row")


def perplexities(documents: DataFrame, model: KneserNey, *, id_column: str = "doc_id", lang_column: str = "lang", text_column: str = "text", held_rows: int = HELD_ROWS) -> DataFrame:
    """``id_column``, ``lang``, ``n_characters`` and ``perplexity`` of every document; null for texts without characters.

    A model of at most ``held_rows`` rows is held by every worker in sorted arrays, read from the shared
    folder; a larger one, or one in a folder that isn't mounted as files, is joined.
    """
    texts = documents.select(F.col(id_column).alias("key"), language(F.col(lang_column)).alias("lang"), F.col(text_column).alias("text"))
    kind = texts.schema["key"].dataType.simpleString()
    scored = (_scores_by_arrays if is_mounted(documents.sparkSession) and model.rows() <= held_rows else _scores_by_join)(texts, model, kind)
    value = F.when(F.col("n") > 0, F.exp(-F.col("log_p") / F.col("n")))
    return scored.select(F.col("key").alias(id_column), "lang", F.col("n").alias("n_characters"), value.alias("perplexity"))


def perplexity_bands(scores: DataFrame, *, lower: float = 0.02, upper: float = 0.98) -> DataFrame:
    """``scores`` with ``low``, ``high`` (quantiles of the language's documents) and ``rejected``; texts without perplexity are not rejected."""
    if not 0 <= lower < upper <= 1:
        raise InvalidParameterError("the bands need 0 <= lower < upper <= 1")
    bands = scores.groupBy("lang").agg(F.percentile_approx("perplexity", F.array(F.lit(lower), F.lit(upper)), F.lit(10_000)).alias("band"))
    joined = scores.join(_by_language(bands), "lang", "left").withColumn("low", F.col("band")[0]).withColumn("high", F.col("band")[1]).drop("band")
    outside = (F.col("perplexity") < F.col("low")) | (F.col("perplexity") > F.col("high"))
    return joined.withColumn("rejected", F.coalesce(outside, F.lit(False)))
