"""Language of whole texts by error-correcting output codes.

Every language has a codeword of +1/-1 bits. One binary classifier over hashed byte n-grams (2 to 4 bytes) predicts each
bit; a text's language is the codeword with the smallest loss, each bit's loss weighted by how often that bit's classifier
is right for that language. Training needs n-gram counts by language, which Spark adds up; the model is a table of fixed
size (3 x 65,536 buckets x bits) that is sent to the tasks.

Nulls, empty texts and texts without a letter are ``und`` with score 0, as is every text when nothing could be learned.
With a single language every text with a letter has it with score 1. Ties go to the language that sorts first. Repeated
rows get the same answer; other columns of the input play no part. Texts are read whole, in slices. An empty table gives an
empty result, and a model without languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.llm.hashing import chunks
from postgrain.llm.workers import mapped
from postgrain.session import stage

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
ROWS = BUCKETS * len(ORDERS)
UNKNOWN = "und"
SLICE_BYTES = 1 << 17  # of texts that are worked on at once; its n-grams and their weights take some 90 times the room
MOST_LANGUAGES = 256  # the driver and every task hold the model, which grows with them


def _letters() -> np.ndarray:
    """Bytes as they enter n-grams: lower case, and one space for ASCII that is no letter."""
    to = np.arange(256, dtype=np.uint8)
    to[:128] = 0x20
    for first, last in ((ord("a"), ord("z")), (ord("A"), ord("Z"))):
        to[first : last + 1] = np.arange(ord("a"), ord("z") + 1)
    return to


_LETTERS = _letters()


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n-gram order the bucket that ends at each byte, and where each text begins among these bytes.

    A space goes before each text, so that short texts have word starts too. Bucket ``ROWS`` stands for no n-gram.
    """
    text = np.insert(_LETTERS[raw], offsets[:-1], 0x20)
    upper = np.zeros(len(text), dtype=bool)  # the second byte of the upper-case letters U+00C0 to U+00DE
    upper[1:] = (text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0x9E)
    text[upper] += 0x20
    begins = offsets + np.arange(len(offsets))
    at = np.arange(len(text)) - np.repeat(begins[:-1], np.diff(begins))
    blank = text == 0x20
    void = blank.copy()
    void[1:] &= blank[:-1]
    code, out = text.astype(np.uint32), []
    window = code.copy()
    for k, n in enumerate(ORDERS):
        for back in range(1 if k == 0 else ORDERS[k - 1], n):
            window[back:] |= code[:-back] << np.uint32(8 * back)
        bucket = window if n == 2 else (window * np.uint32(0x9E3779B1)) >> np.uint32(16)
        out.append(np.where((at < n - 1) | void, ROWS, bucket.astype(np.int64) % BUCKETS + k * BUCKETS))
    return out, begins


@dataclass
class LanguageModel:
    """Codewords (languages x bits), decoding weights of the same shape and n-gram weights (buckets x bits)."""

    languages: list[str]
    codes: np.ndarray
    trust: np.ndarray
    weights: np.ndarray

    def margins(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """What each bit's classifier says of each text of a slice: evidence summed over n-grams, by its square root of n."""
        found, begins = grams(raw, offsets)
        total = np.zeros((len(offsets) - 1, self.codes.shape[1]))
        count = np.zeros(len(offsets) - 1)
        for buckets in found:
            total += np.add.reduceat(self.weights[buckets], begins[:-1], axis=0)
            count += np.add.reduceat((buckets < ROWS).astype(np.int64), begins[:-1])
        return total / np.sqrt(np.maximum(count, 1))[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each codeword (texts x languages)."""
        out = np.empty((len(margins), len(self.languages)))
        for k, (code, trust) in enumerate(zip(self.codes, self.trust)):
            out[:, k] = np.logaddexp(0.0, -code * margins) @ trust
        return out


def codebook(n: int, seed: int = 0) -> np.ndarray:
    """Codewords for ``n`` languages: all distinct splits up to six languages, beyond that the best of random codes."""
    if n <= 6:
        splits = np.arange(1, 1 << max(n - 1, 0))
        bits = (splits[None, :] >> np.arange(n)[:, None]) & 1 if n > 1 else np.zeros((n, 0), dtype=int)
        return (2 * bits - 1).astype(float)
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))
    tries = (rng.choice([-1.0, 1.0], size=(n, width)) for _ in range(100))

    def distance(code: np.ndarray) -> float:
        apart = (width - code @ code.T) / 2
        np.fill_diagonal(apart, width)
        return apart.min() if (np.abs(code.sum(axis=0)) < n).all() else -1

    return max(tries, key=distance)


def sample_by_language(docs: DataFrame, key: str, rows_per_language: int) -> DataFrame:
    """About ``rows_per_language`` rows of each language, chosen by a hash of the row; all, where there are fewer.

    The hash takes the key, the text and the row's place in the table, so that null and repeated keys and texts are sampled
    like all others. More than ``MOST_LANGUAGES`` languages are refused.
    """
    size = stage(docs.groupBy(F.col("lang").alias("of_lang")).agg(F.count(F.lit(1)).alias("of_rows")))
    if size.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    row = F.xxhash64(F.col(key), F.col("text"), F.monotonically_increasing_id())
    placed = docs.withColumn("place", F.pmod(row, F.lit(1 << 30)) / F.lit(float(1 << 30)))
    chosen = placed.join(F.broadcast(size), F.col("lang") == F.col("of_lang"))  # at most MOST_LANGUAGES rows
    return chosen.filter(F.col("place") < F.lit(float(rows_per_language)) / F.col("of_rows")).select("text", "lang")


def fit_languages(docs: DataFrame, key: str = "doc_id", rows_per_language: int = 4000, smoothing: float = 0.5) -> LanguageModel:
    """Learn from the columns text and lang of labelled documents (rows without either are ignored).

    ``rows_per_language`` bounds the sample that is read in full for counts and decoding weights.
    """
    labelled = docs.select(key, "text", "lang").filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
    sample = stage(sample_by_language(labelled, key, rows_per_language))
    languages = sorted(r[0] for r in sample.select("lang").distinct().toLocalIterator())
    codes = codebook(len(languages))
    if not codes.size:
        return LanguageModel(languages, codes, codes, np.zeros((ROWS + 1, 0), dtype=np.float32))
    place = {name: k for k, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, names = batch.column("text"), batch.column("lang").to_pylist()
            for row, raw, offsets in chunks(column, SLICE_BYTES):
                found, begins = grams(raw, offsets)
                lang = np.array([place[x] for x in names[row : row + len(offsets) - 1]])
                rows = np.repeat(lang, np.diff(begins))
                cell, n = np.unique(np.concatenate([rows[buckets < ROWS] * ROWS + buckets[buckets < ROWS] for buckets in found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell // ROWS), pa.array(cell % ROWS), pa.array(n)], ["lang_at", "bucket", "n"])

    counted = sample.coalesce(sample.sparkSession.sparkContext.defaultParallelism)
    counts = mapped(counted, count, "lang_at long, bucket long, n long").groupBy("lang_at", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most languages x ROWS rows, however long the texts
    table = np.zeros((len(languages), ROWS))
    table[found.lang_at, found.bucket] = found.n
    chance = table.reshape(len(languages), len(ORDERS), BUCKETS) + smoothing
    chance = (chance / chance.sum(axis=2, keepdims=True)).reshape(len(languages), ROWS)
    plus, minus = (codes > 0).astype(float), (codes < 0).astype(float)
    odds = np.log(plus.T @ chance / plus.sum(axis=0)[:, None]) - np.log(minus.T @ chance / minus.sum(axis=0)[:, None])
    weights = np.vstack([odds.T, np.zeros((1, codes.shape[1]))]).astype(np.float32)
    model = LanguageModel(languages, codes, np.full_like(codes, 1.0 / codes.shape[1]), weights)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros((len(place), codes.shape[1] + 1))
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for row, raw, offsets in chunks(batch.column("text"), SLICE_BYTES):
                lang = np.array([place[x] for x in names[row : row + len(offsets) - 1]])
                hits = np.column_stack([model.margins(raw, offsets) * codes[lang] > 0, np.ones(len(lang), dtype=bool)])
                np.add.at(right, lang, hits)
        lang, bit = np.indices(right.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (lang, bit, right)], ["lang_at", "bit", "n"])

    hits = mapped(counted, judge, "lang_at long, bit long, n double").groupBy("lang_at", "bit").agg(F.sum("n").alias("n")).toPandas()
    right = np.zeros((len(languages), codes.shape[1] + 1))
    right[hits.lang_at, hits.bit] = hits.n
    trust = right[:, :-1] / np.maximum(right[:, -1:], 1) + 1e-9
    model.trust = trust / trust.sum(axis=1, keepdims=True)
    return model


def quoted(name: str) -> str:
    """A column's name as an expression, dots included."""
    return "`" + name.replace("`", "``") + "`"


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict_languages(docs: DataFrame, model: LanguageModel, keep: list[str], ambiguous_below: float = 0.5) -> DataFrame:
    """Columns ``keep`` with lang_pred, score (0 to 1) and ambiguous: whether a text with letters scores under the bound.

    The score is the chosen codeword's share of exp(-loss) over all codewords. Kept columns of these names are replaced.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score", "ambiguous")]
    if not model.languages:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    parts = (model.languages, model.codes, model.trust, model.weights)
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # of fixed size
    schema = docs.select(*(F.col(quoted(c)) for c in keep)).schema.add("lang_pred", "string").add("score", "double")
    # A text that is kept goes to Python once; where there is no letter in it, it is not read.
    sent = [F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)]
    read = f"k{keep.index('text')}" if "text" in keep else "read"
    made = docs.select(*sent, *([] if "text" in keep else [F.col("text").alias("read")]), has_letter(F.col("text")).alias("known"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(*shared.value)
        for batch in batches:
            column = pc.if_else(batch.column("known"), batch.column(read), pa.scalar(None, batch.column(read).type))
            name, score = np.zeros(len(column), dtype=np.int64), np.ones(len(column))
            if m.codes.size:
                for row, raw, offsets in chunks(column, SLICE_BYTES):
                    share = -len(m.languages) * m.losses(m.margins(raw, offsets))
                    share = np.exp(share - share.max(axis=1, keepdims=True))
                    here = slice(row, row + len(share))
                    name[here], score[here] = share.argmax(axis=1), share.max(axis=1) / share.sum(axis=1)
            known = np.asarray(column.is_valid())
            names = pa.array([m.languages[k] if ok else UNKNOWN for k, ok in zip(name.tolist(), known.tolist())], pa.string())
            columns = [batch.column(i) for i in range(len(keep))] + [names, pa.array(np.where(known, score, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    out = mapped(made, predict, schema)
    return out.withColumn("ambiguous", (F.col("lang_pred") != UNKNOWN) & (F.col("score") < ambiguous_below))
