"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm import textkit as tk
from skerry.llm.store import written
from skerry.llm.textkit import U

UNKNOWN = "und"
#: Labelled rows that training takes at most, over all languages, and characters of each: the sample's documented bounds.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 1600
#: Rows of each language that training takes besides, as far as there are any, so that a rare language is learned.
LANGUAGE_ROWS = 50
#: What calibration asks of the rows that are accepted: the share of wrong ones at most, and the share of right ones that are lost at most.
RISK, LOST = 0.01, 0.0005
_BINS = 10_000  # of scores, in a calibration's counts
#: Bytes in a subword.
GRAMS = (1, 2, 3, 4)
_PIECE = 60  # words in a training example


@dataclass(frozen=True)
class Model:
    """Embedding and softmax layers folded into one table: a subword's share of each language's logit."""

    languages: tuple[str, ...]
    table: np.ndarray  # buckets x languages, float32
    bias: np.ndarray
    temperature: float
    floor: float | None = None  # scores below it are rejected; None until calibrated


def _subwords(w: tk.Words, buckets: int, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of distinct words, and where each word's begin. Subwords see the word's ends.

    Words are taken in blocks, so that what is held beside the result is small.
    """
    parts, counts = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
    for at in range(0, len(w.start), block):
        found, count = _block_subwords(w.data, w.start[at : at + block], w.end[at : at + block], buckets)
        parts.append(found)
        counts.append(count)
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def _block_subwords(text: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    size = end - start
    total = int((size + 2).sum())
    begin = np.concatenate([[0], np.cumsum(size + 2)])
    data = np.full(total, 32, np.uint8)  # a space at either end
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    data[begin[word] + 1 + place] = tk.LOWER[text[start[word] + place]]
    left = np.repeat(begin[1:], size + 2) - np.arange(total)
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size + 2)
    codes, found, ids = data.astype(U) + U(1), [], []
    for n in GRAMS:
        h = tk.mix(tk.windows(codes, n, 0x100000001B3) + U(n << 56))
        ok = left[: len(h)] >= n
        found.append((h[ok] & U(buckets - 1)).astype(np.int32))
        ids.append(owner[: len(h)][ok])
    ids = np.concatenate(ids)
    order = np.argsort(ids, kind="stable")
    return np.concatenate(found)[order], np.bincount(ids, minlength=len(size))


def _distinct(w: tk.Words) -> tuple[tk.Words, np.ndarray]:
    _, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
    return tk.Words(w.hash[first], w.start[first], w.end[first], np.array([0, len(first)]), w.data), back


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def logits(texts: pa.Array, model: Model) -> np.ndarray:
    """Mean of the subwords' rows of the table over each whole text, with the bias; zeros where there is no word."""
    w = tk.words(texts)
    out = np.zeros((len(w.rows) - 1, len(model.languages)))
    if not len(w.hash):
        return out
    distinct, back = _distinct(w)
    subwords, begin = _subwords(distinct, len(model.table))
    count, row, n = np.diff(begin), w.row_of(), len(out)
    total = np.bincount(row, count[back], n)
    for k in range(len(model.languages)):
        sums = np.add.reduceat(model.table[:, k][subwords], begin[:-1])
        out[:, k] = np.bincount(row, sums[back], n)
    some = total > 0
    out[some] = out[some] / total[some, None] + model.bias
    return out


def train(texts: list[str], labels: list[str], buckets: int = 1 << 15, dim: int = 16, steps: int = 400, rate: float = 0.5, boost: float = 4.0, seed: int = 7) -> Model:
    """Stochastic gradient descent in numpy over pieces of the texts; a fifth of the texts is held back for the temperature.

    The temperature is the one, of a grid, with the least log loss on the texts held back. The floor is left to calibrate().
    """
    rng = np.random.default_rng(seed)
    languages = tuple(sorted(set(labels)))
    if len(languages) < 2:
        return Model(languages, np.zeros((buckets, len(languages)), np.float32), np.zeros(len(languages)), 1.0)
    w = tk.words(pa.array(texts, pa.large_string()))
    distinct, back = _distinct(w)
    subwords, begin = _subwords(distinct, buckets)
    y = np.array([languages.index(x) for x in labels])
    pieces = [(a, min(b, a + _PIECE), k) for k, (lo, b) in enumerate(zip(w.rows[:-1], w.rows[1:], strict=True)) for a in range(lo, b, _PIECE)]
    held = rng.random(len(texts)) < 0.2
    fit = [p for p in pieces if not held[p[2]]]
    table = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    weight, bias = np.zeros((dim, len(languages))), np.zeros(len(languages))

    def features(batch: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        runs = [np.concatenate([subwords[begin[t] : begin[t + 1]] for t in back[a:b]]) for a, b, _ in batch]
        sizes = np.array([len(r) for r in runs])
        return np.concatenate(runs), sizes, y[[k for *_, k in batch]]

    def embedded(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[ids], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]

    step = 0
    while step < steps and fit:
        order = rng.permutation(len(fit))
        for at in range(0, len(order), 64)[: steps - step]:
            ids, sizes, truth = features([fit[k] for k in order[at : at + 64]])
            hidden = embedded(ids, sizes)
            slope = _softmax(hidden @ weight + bias)
            slope[np.arange(len(truth)), truth] -= 1
            slope /= len(truth)
            lr, step = rate * (1 - step / steps), step + 1
            back_to = (slope @ weight.T) / sizes[:, None]
            weight -= boost * lr * hidden.T @ slope
            bias -= lr * slope.sum(axis=0)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            used, at_id = np.unique(ids, return_inverse=True)
            for j in range(dim):
                table[used, j] -= boost * lr * len(truth) / 4 * np.bincount(at_id, back_to[owner, j], len(used))
    folded = Model(languages, (table @ weight).astype(np.float32), bias, 1.0)
    kept_back = [k for k in range(len(texts)) if held[k] and w.counts[k]]
    if not kept_back:
        return folded
    z = logits(pa.array([texts[k] for k in kept_back], pa.large_string()), folded)
    truth = y[kept_back]
    grid = (0.25, 0.5, 1.0, 2.0, 4.0)
    loss = [-np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    return replace(folded, temperature=grid[int(np.argmin(loss))])


def crc_fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 4; a null key counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def _pool(docs: DataFrame) -> DataFrame:
    """Labelled rows outside fold 2: all that the classifier may learn from."""
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return labelled.where((crc_fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())


_TOP = 1 << 30


def _place() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(_TOP))


def _cuts(pool: DataFrame, rows: int) -> tuple[DataFrame, float]:
    """lang, few and cut, and the share of rows of any language: what hashed places are the sample's.

    Rows whose place is below `cut` may be in the sample, all others calibrate; below `few` lie twice LANGUAGE_ROWS rows of each
    language, as far as there are any. A fifth is left to calibrate, of each language that has more rows than LANGUAGE_ROWS.
    """
    sizes = {r["lang"]: r["count"] for r in pool.groupBy("lang").count().collect()}
    share = min(0.8, 1.2 * rows / max(1, sum(sizes.values())))
    few = {lang: 1.0 if n <= LANGUAGE_ROWS else min(0.8, 2 * LANGUAGE_ROWS / n) for lang, n in sizes.items()}
    cuts = [(lang, int(f * _TOP) + 1, int(max(f, share) * _TOP) + 1) for lang, f in few.items()]
    return F.broadcast(pool.sparkSession.createDataFrame(cuts, "lang string, few long, cut long")), share


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """A model of docs' labelled rows outside fold 2, not calibrated yet.

    The sample is the `rows` rows first by a hash of doc_id, with the LANGUAGE_ROWS rows of each language first by it, and of each a
    piece of `chars` characters at a hashed offset: bounded, and the same on every run. Predictions never see lang, source or doc_id.
    """
    order = F.xxhash64("doc_id")
    offset = F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.greatest(F.length("text") - chars + 1, F.lit(1)))
    pool = _pool(docs)
    # a hash picks about the rows wanted, so what is sorted and what tasks send to the driver doesn't grow with their number
    most, share = _cuts(pool, rows)
    picked = pool.join(most, "lang").where(_place() < F.col("cut"))
    pieces = picked.select("doc_id", "lang", (_place() < F.col("few")).alias("few"), F.expr("text").substr(offset.cast("int") + 1, F.lit(chars)).alias("text"), order.alias("h"), (_place() < F.lit(int(share * _TOP) + 1)).alias("any"))
    by = ("h", "doc_id", "lang", "text")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(*by))
    common = pieces.where("any").orderBy(*by).limit(rows).select(*by)
    rare = pieces.where("few").withColumn("k", first).where(F.col("k") <= LANGUAGE_ROWS)
    found = {tuple(r[c] for c in by): None for r in common.collect()}
    found |= {tuple(r[c] for c in by): None for r in rare.select(*by).collect()}
    found = [(x[3], x[2]) for x in found]
    return train([t for t, _ in found], [lang for _, lang in found])


def calibrate(scored: DataFrame, rows: int = SAMPLE_ROWS) -> float:
    """The floor of scores, from all labelled rows outside fold 2 and outside the sample, scored over their whole texts.

    scored: rows of doc_id, text, lang, lang_pred and score. Counts by score are all that comes to the driver. The floor is the least score at
    and above which no more than RISK of the rows are wrong, or, if it is more, the highest below which no more than LOST of the
    right ones lie; 0 where no row is right.
    """
    rest = scored.select("doc_id", "text", "lang", "lang_pred", "score")
    pool = rest.where((crc_fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    most, _ = _cuts(pool, rows)
    held = pool.join(most, "lang").where((_place() >= F.col("cut")) & (F.col("lang_pred") != UNKNOWN))
    bins = held.groupBy(F.floor(F.col("score") * _BINS).cast("int").alias("b")).agg(F.count_if(F.col("lang") == F.col("lang_pred")).alias("right"), F.count("*").alias("n"))
    right, wrong = np.zeros(_BINS + 1, np.int64), np.zeros(_BINS + 1, np.int64)
    for r in bins.collect():
        right[r["b"]], wrong[r["b"]] = r["right"], r["n"] - r["right"]
    return floor_of(right, wrong)


def floor_of(right: np.ndarray, wrong: np.ndarray) -> float:
    """calibrate()'s floor from how many right and wrong rows have scores in each of equal bins."""
    if not right.sum():
        return 0.0
    kept_right, kept_wrong = right[::-1].cumsum()[::-1], wrong[::-1].cumsum()[::-1]
    rate = kept_wrong / np.maximum(1, kept_right + kept_wrong)
    rate[kept_right == 0] = 1.0
    safe = np.flatnonzero(rate <= RISK)
    by_risk = int(safe[0]) if len(safe) else int(rate.argmin())
    by_loss = int(np.flatnonzero(right.sum() - kept_right <= LOST * right.sum())[-1])
    return max(by_risk, by_loss) / (len(right) - 1)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Each row's language: struct columns `own` (all columns of docs) and `found` (lang_pred, score).

    A null text and one without a letter are `und` with score 0. Whole texts are read, however long; of languages that tie the first by name
    is taken. With no labelled row to learn from, all are `und`. Repeated rows are rows of their own, whether or not
    they share a doc_id; a null doc_id counts as an empty one; clashing names stay apart in `own`; an empty table gives an empty one.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in tk.chunks(batches, "text"):
            texts = batch.column(1)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if m.languages:
                p = _softmax(logits(texts, m) / m.temperature)
                best = np.where(letters, p.argmax(axis=1), len(m.languages))
                score = np.where(letters, p.max(axis=1), 0.0)
            else:
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            found = pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["own", "found"])

    return own.mapInArrow(run, T.StructType([own.schema["own"], T.StructField("found", T._parse_datatype_string("struct<lang_pred:string,score:double>"))]))


def _floor(model: Model, scored: DataFrame) -> float:
    return calibrate(scored) if model.floor is None else model.floor


def _rejected(floor: float) -> Column:
    return (F.col("found.lang_pred") == UNKNOWN) | (F.col("found.score") < floor)


def judged(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """identify()'s columns and `rejected`: true for `und` and for scores under the calibrated floor; lang_pred stays the likeliest language.

    Without a floor of the model's own, all rows are scored into a table first, which both the calibration and the caller read: texts
    are scored once. docs then needs doc_id and lang besides text.
    """
    model = model or fit(docs)
    found = identify(docs, model)
    if model.floor is None:
        found = written(found, "scored")
    return found.withColumn("rejected", _rejected(_floor(model, found.select("own.doc_id", "own.text", "own.lang", "found.lang_pred", "found.score"))))


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs, with docs' own columns, whose language the model accepts."""
    return judged(docs, model).where(~F.col("rejected")).select("own.*")


def report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row; texts are scored once, and not kept."""
    model = model or fit(docs)
    there = F.when(F.col("own.text").isNotNull(), F.lit(""))
    found = identify(docs.select("doc_id", "text", "lang"), model).select("own.doc_id", "own.lang", there.alias("text"), "found")
    if model.floor is None:
        found = written(found, "scored")
    floor = _floor(model, found.select("doc_id", "text", "lang", "found.lang_pred", "found.score"))
    return found.select("doc_id", (crc_fold(F.col("doc_id")) == 2).alias("held_out"), "found.lang_pred", "found.score", _rejected(floor).alias("rejected"))
