"""Line dedup by winnowing: repeated runs of words go, their first occurrence stays.

Every run of ``min_words`` words has a fingerprint, the RUN words in it with the smallest hash (the first of
equal ones), whatever stands around the run and wherever its lines end: of any places that share the run, all
have the fingerprint. A run is deleted where an earlier place, by (doc_id, text hash, word), holds it.

Places that have a fingerprint with the same words around, as far as runs with it reach, hold the same runs: all
but the first of such a class are deleted without a look at their runs. The first places of the classes of a
fingerprint meet by the codes of their runs, so each run meets the first place that really holds it, and
rows grow with the words of the places, not with the square of their number.

A null text stays null. Rows of equal id and text are one document and get the same text.
Null ids come last. A text with fewer than ``min_words`` words has no run. An empty table gives an empty result.
Extra columns stay. Overlapping repeats within one text leave their first period.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewell.llm.common import giving_back, mixed, rows_in_pieces, run_codes, text_codes, words_of
from ratewell.scale import ensure_checkpoint_dir, join_dimension, settle

RUN = 20
BATCH_ROWS = 500
MIN_WORDS = 50
#: Stands for a null id; a row that has it, with the same text, is the same document.
LAST_ID = 2**63 - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprints(texts: list[str | None], min_words: int) -> tuple[np.ndarray, ...]:
    """(number of the text, word number, hash, code of the words around) of the fingerprints of all texts."""
    codes, sizes = text_codes(texts)
    enough = sizes >= min_words
    codes, sizes = codes[np.repeat(enough, sizes)], np.where(enough, sizes, 0)
    last = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    size = min(RUN, min_words)
    hashes = run_codes(codes, size)
    best = lowest(hashes, min_words - size + 1)
    best = best[np.arange(len(best)) + min_words <= last[owner[: len(best)]]]
    at = best[np.append(True, best[1:] != best[:-1])] if len(best) else best
    start, end = np.maximum(at - (min_words - size), (last - sizes)[owner[at]]), np.minimum(at + min_words, last[owner[at]])
    around = mixed(run_codes(codes, end - start, start) ^ (at - start).astype(np.uint64))
    return owner[at], at - (last - sizes)[owner[at]], hashes[at], around


def lowest(values: np.ndarray, window: int) -> np.ndarray:
    """Place of the smallest value, by its upper 32 bits, the first of equal ones, among each ``window`` neighbours."""
    best, span = values >> np.uint64(32) << np.uint64(32) | np.arange(len(values), dtype=np.uint64), 1
    while span < window and len(best):
        step = min(span, window - span)
        best, span = np.minimum(best[:-step], best[step:]), span + step
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the given runs of words and the white space after each."""
    data = text.encode()
    starts = [m.start() for m in WORD.finditer(data)] + [len(data)]
    kept, at = [], 0
    for start, end in sorted(runs):
        if starts[end] > at:
            kept.append(data[at : max(at, starts[start])])
            at = starts[end]
    return b"".join([*kept, data[at:]]).decode()


def _places(docs: DataFrame, min_words: int) -> DataFrame:
    """(hash, around, id, digest, word) of every fingerprint."""
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows_in_pieces(batches, BATCH_ROWS):
            owner, word, hashed, around = fingerprints(list(batch["_text"]), min_words)
            yield pd.DataFrame({
                "hash": hashed.view(np.int64), "around": around.view(np.int64), "id": batch["_id"].to_numpy()[owner],
                "digest": batch["_digest"].to_numpy()[owner], "word": word,
            })

    return docs.select("_id", "_digest", "_text").mapInPandas(giving_back(found), "hash long, around long, id long, digest long, word int")


def _written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared checkpoint folder: compressed, read several times."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _firsts(places: DataFrame, keys: list[str]) -> DataFrame:
    """The first place of each key and the number n of its places."""
    return places.groupBy(*keys).agg(F.min(F.struct("id", "digest", "word")).alias("first"), F.count("*").alias("n"))


def _is_later() -> Column:
    return (F.col("id") != F.col("first.id")) | (F.col("digest") != F.col("first.digest")) | (F.col("word") != F.col("first.word"))


def _run_places(docs: DataFrame, keys: DataFrame, min_words: int) -> DataFrame:
    """(code, id, digest, word) of the runs with one of the fingerprints that ``keys`` (_id, _digest, at) lists."""
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach = min_words - min(RUN, min_words)
        for batch in rows_in_pieces(batches, BATCH_ROWS):
            codes, sizes = text_codes(batch["_text"])
            last = np.cumsum(sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            first = np.repeat(last - sizes, [len(at) for at in batch["at"]])
            at = np.concatenate(list(batch["at"])).astype(np.int64) + first
            steps = np.bincount(np.maximum(at - reach, first), minlength=len(codes) + 1) - np.bincount(at + 1, minlength=len(codes) + 1)
            starts = np.flatnonzero(np.cumsum(steps) > 0)
            starts = starts[starts + min_words <= last[owner[starts]]]
            yield pd.DataFrame({
                "code": run_codes(codes, min_words, starts).view(np.int64), "id": batch["_id"].to_numpy()[owner[starts]],
                "digest": batch["_digest"].to_numpy()[owner[starts]], "word": starts - (last - sizes)[owner[starts]],
            })

    return join_dimension(docs, keys, ["_id", "_digest"]).select("_id", "_digest", "_text", "at").mapInPandas(
        listed, "code long, id long, digest long, word int"
    )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, digest, runs) with what each text repeats; ``docs`` has _id, _digest and _text.

    A run of words, from start to before end, is start * 2**32 + end; an end may lie beyond the text. Runs do not touch.
    """
    reach = min_words - min(RUN, min_words)
    places = _written(_places(docs, min_words))
    met = _written(places.join(_shared(places, "hash"), "hash"))
    classes = _written(_firsts(met, ["hash", "around"]))
    copies = (
        met.join(classes.where("n > 1").drop("n"), ["hash", "around"]).where(_is_later())
        .select("id", "digest", F.greatest(F.col("word") - reach, F.lit(0)).alias("start"), (F.col("word") + min_words).alias("end"))
    )
    open_places = (
        classes.join(_shared(classes, "hash"), "hash").groupBy(F.col("first.id").alias("_id"), F.col("first.digest").alias("_digest"))
        .agg(F.collect_list("first.word").alias("at"))
    )
    runs = _written(_run_places(docs, open_places, min_words))
    met_runs = _written(runs.join(_shared(runs, "code"), "code"))
    repeats = (
        met_runs.join(_firsts(met_runs, ["code"]).drop("n"), "code").where(_is_later())
        .select("id", "digest", F.col("word").alias("start"), (F.col("word") + min_words).alias("end"))
    )
    run = F.shiftleft(F.col("start").cast("long"), 32) + F.col("end")

    def united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["runs"] = [merged(r) for r in batch["runs"]]
            yield batch

    found = copies.unionByName(repeats).groupBy("id", "digest").agg(F.collect_list(run).alias("runs"))
    return found.mapInPandas(giving_back(united), "id long, digest long, runs array<long>")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The keys of two rows or more."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").drop("n")


def dedup_lines(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns, the text without its repeated runs, and ``removed_words``; a column of that name is replaced."""
    names = [c for c in docs.columns if c != "removed_words"]
    tagged = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_digest"), F.col(text).alias("_text"),
    )
    runs = repeated_runs(tagged.select("_id", "_digest", "_text"), min_words)
    runs = runs.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "runs")
    joined = join_dimension(tagged, runs, ["_id", "_digest"], "left").select("_row", "_text", "runs")
    schema = T.StructType([
        joined.schema["_row"], T.StructField("_text", T.StringType()), T.StructField("removed_words", T.LongType()),
    ])

    def cleaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs = [within(r, len(words_of(t))) for t, r in zip(batch["_text"], batch["runs"])]
            batch["removed_words"] = [sum(end - start for start, end in r) for r in runs]
            batch["_text"] = [without(t, r) for t, r in zip(batch["_text"], runs)]
            yield batch[["_row", "_text", "removed_words"]]

    plain = joined.where("runs IS NULL").select("_row", "_text", F.lit(0).cast("long").alias("removed_words"))
    changed = joined.where("runs IS NOT NULL").mapInPandas(giving_back(cleaned), schema)
    return plain.unionByName(changed).select(
        *[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in names], "removed_words"
    )


def merged(runs: np.ndarray) -> np.ndarray:
    """The union of runs (start * 2**32 + end) as runs that do not touch, in ascending order."""
    runs = np.sort(np.asarray(runs, np.int64))
    start, end = runs >> 32, np.maximum.accumulate(runs & 0xFFFFFFFF)
    new = np.append(True, start[1:] > end[:-1])
    return start[new] << 32 | end[np.append(new[1:], True)]


def within(runs: np.ndarray, n_words: int) -> list[tuple[int, int]]:
    """(start, end) of runs (start * 2**32 + end), cut at the end of the text."""
    return [(run >> 32, min(run & 0xFFFFFFFF, n_words)) for run in runs.tolist()]
