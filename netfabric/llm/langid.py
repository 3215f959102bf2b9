"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bitmask of languages per slot.  The masks
at an n-gram's slots, ANDed, give every language that contains the n-gram, for
all languages in one probe.  Per text and language the hits are counted and
corrected for the filter's false positives; the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric.llm import textbuf
from netfabric.session import cut_lineage

#: Lengths of the byte n-grams; words are padded with one blank on either side.
NGRAMS = (3, 4, 5)
HASHES = 3
#: In a language with fewer n-grams in all, each counts, however rare it is.
THIN = 20_000
UNKNOWN = "und"
PRED_TYPE = "lang_pred string, score double"
#: All ASCII that is not a letter ends a word; bytes of other characters are kept.
NOT_LETTER = np.array([not (chr(b).isalpha() or b >= 0x80) for b in range(256)])
TO_GRAM = np.where(NOT_LETTER, np.uint8(0x20), textbuf.LOWER)


class LanguageFilter(NamedTuple):
    """``slots[i, k]``: languages ``64 k`` to ``64 k + 63`` with an n-gram at slot ``i``; ``noise``: chance of a false hit."""

    langs: list[str]
    slots: np.ndarray
    noise: np.ndarray


def gram_hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and rows of the n-grams that lie within a word and its two blanks."""
    n = len(data)
    if n == 0:
        return
    row = textbuf.owners(offsets)
    # Each row gets a blank before and after it, so that its first and last words are padded too.
    padded = np.full(n + 2 * (len(offsets) - 1), 0x20, np.uint8)
    padded[np.arange(n) + 2 * row + 1] = TO_GRAM[data]
    rows = textbuf.owners(offsets + 2 * np.arange(len(offsets)))
    blank = padded == 0x20
    blanks = np.concatenate([[0], np.cumsum(blank)])
    sums = textbuf.running_hash(padded)
    for size in NGRAMS:
        if len(padded) < size:
            continue
        at = np.arange(len(padded) - size + 1)
        # No blank inside, and not only blanks around one letter's place.
        ok = (blanks[at + size - 1] - blanks[at + 1] == 0) & (rows[at] == rows[at + size - 1])
        at = at[ok]
        yield textbuf.gram_hash(sums, at, at + size), rows[at]


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, gram, n)``: how often each n-gram occurs in each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang")
            for name in lang.unique().to_pylist():
                texts = batch.filter(pc.equal(lang, name)).column("text")
                for chunk in textbuf.chunks(texts, textbuf.CHUNK_BYTES * 4):
                    grams = [g for g, _ in gram_hashes(chunk.data, chunk.offsets)]
                    gram, n = np.unique(np.concatenate([*grams, np.zeros(0, np.uint64)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def slot_of(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
    step = textbuf.mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    for i in range(HASHES):
        yield ((grams + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


def build_filter(langs: list[str], grams: pd.DataFrame, bits_per_gram: int) -> LanguageFilter:
    """``grams`` is ``(lang, gram)``; the filter has ``bits_per_gram`` slots for each distinct n-gram at least."""
    distinct = max(1, grams["gram"].nunique())
    size = 1 << max(10, (distinct * bits_per_gram - 1).bit_length())
    slots = np.zeros((size, (len(langs) + 63) // 64 or 1), np.uint64)
    noise = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = grams.loc[grams["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        for at in slot_of(own, size):
            slots[at, k // 64] |= np.uint64(1) << np.uint64(k % 64)
        noise[k] = np.mean((slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)) ** HASHES
    return LanguageFilter(langs, slots, noise)


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 4000,
    min_count: int = 3, min_share: float = 0.1, bits_per_gram: int = 16,
) -> LanguageFilter:
    """Fit on a sample of ``rows_per_language`` labelled rows of each language on average.

    The sample is drawn by a hash of the id, so its size, and with it the filter,
    has a bound that does not grow with the table.  An n-gram belongs to a
    language that has it ``min_count`` times, or once if all its texts together are short (``THIN``), and at ``min_share`` of the highest
    rate that any language has it at.  Rows with a null language teach nothing.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return build_filter([], pd.DataFrame({"lang": [], "gram": []}), bits_per_gram)
    part = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, rows_per_language / sizes[k])))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counts = cut_lineage(count_grams(labelled.filter(draw < part[F.col(lang_col)]), text_col, lang_col))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
    enough = (F.col("n") >= min_count) | (F.col("total") < THIN)
    kept = rates.filter(enough).join(best, "gram").filter(F.col("rate") >= min_share * F.col("best"))
    return build_filter(langs, kept.select("lang", "gram").toPandas(), bits_per_gram)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict_batch(model: LanguageFilter, texts: pa.Array) -> pa.StructArray:
    n, k = len(texts), len(model.langs)
    hits, grams = np.zeros((n, k)), np.zeros(n)
    letter = np.zeros(n, bool)
    ascii_letter = ~NOT_LETTER & (np.arange(256) < 0x80)
    for chunk in textbuf.chunks(texts):
        found = np.concatenate([[0], np.cumsum(ascii_letter[chunk.data])])[chunk.offsets]
        letter[chunk.lo : chunk.hi] = np.diff(found) > 0
        for gram, row in gram_hashes(chunk.data, chunk.offsets):
            masks = reduce(np.bitwise_and, (model.slots[at] for at in slot_of(gram, len(model.slots))))
            rows = chunk.hi - chunk.lo
            grams[chunk.lo : chunk.hi] += np.bincount(row, minlength=rows)
            for j in range(k):
                bit = (masks[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)
                hits[chunk.lo : chunk.hi, j] += np.bincount(row[bit == 1], minlength=rows)
    for i in np.flatnonzero(~letter):
        letter[i] = texts[i].is_valid and has_letter(texts[i].as_py())
    if k == 0:
        lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
    else:
        share = np.clip((hits / np.maximum(grams, 1)[:, None] - model.noise) / (1 - model.noise), 0, 1)
        best = share.argmax(axis=1)
        lang = np.where(letter, np.array(model.langs, object)[best], UNKNOWN)
        score = np.where(letter, share[np.arange(n), best], 0.0)
    return pa.StructArray.from_arrays([pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])


def predictor(docs: DataFrame, model: LanguageFilter):
    """A column function: text to ``(lang_pred, score)``.  The filter is sent to each executor once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(PRED_TYPE)
    def predict(texts: pa.Array) -> pa.Array:
        return predict_batch(shared.value, texts)

    return predict


def identify(docs: DataFrame, model: LanguageFilter, text: Column) -> DataFrame:
    """``docs`` with a ``_lang`` column of ``(lang_pred, score)``, scored on whole texts.

    A text that is null or has no letter is ``und`` with score 0.  Equal texts score alike.  The language found
    has the largest corrected share of n-grams; ties go to the first in code point order.  Columns of ``docs``
    stay, whatever their names.
    """
    return docs.withColumn("_lang", predictor(docs, model)(text))
