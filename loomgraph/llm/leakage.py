"""Evaluation items that occur, in whole or in part, in documents.

MinHash containment search.  A passage is LENGTH successive words of an item, a set
of LENGTH - SHINGLE + 1 shingles of SHINGLE words.  Items are partitioned by size
into passages of that one size, so that the threshold of every partition is full
containment of the passage, however long the document; a document that contains a
passage contains its MinHash.  The distinct MinHashes of an item's passages are its
keys.  Documents whose shingles meet a key are candidates; a candidate is verified
by exact containment of a passage.

Words are compared in a form without case, accents and look-alikes.  Items of no
more than ITEM_BYTES are sent to the executors; more than that are joined by key.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, parallel
from . import shingles
from .lookalikes import COMPOSED, FIRST, INVISIBLE, JOINED, expression

LENGTH = 14
SHINGLE = 5
#: The most text of items that is broadcast.
ITEM_BYTES = 32 << 20

_FOLD = str.maketrans(FIRST | JOINED | COMPOSED | dict.fromkeys(INVISIBLE, ""))
_OTHER = re.compile(r"[^\w]+|_+")


def plain(text: str) -> str:
    """The text with look-alikes mapped, accents and case taken off, and only letters and digits beyond ASCII left."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text.translate(_FOLD)).translate(_FOLD)
    text = unicodedata.normalize("NFKD", text.casefold()).translate(_FOLD)
    return _OTHER.sub(" ", "".join(c for c in text if not unicodedata.combining(c)).lower())


def _plain(texts: pa.Array) -> pa.Array:
    return pa.array([plain(t) if t else "" for t in texts.to_pylist()], pa.large_string())


def _grams(texts: pa.Array, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size, (hash, text index) of every run of that many words."""
    h, which = shingles.words(texts)
    out = []
    for k in sizes:
        g = shingles.combine(h, k)
        whole = which[: len(g)] == which[k - 1 :][: len(g)] if len(g) else np.zeros(0, bool)
        out.append((g[whole], which[: len(g)][whole]))
    return out


class Items:
    """Keys and passages of evaluation items, sorted for search."""

    def __init__(self, ids: list[int], texts: list[str | None]) -> None:
        (grams, at), (passages, owner) = _grams(_plain(pa.array(texts, pa.string())), (SHINGLE, LENGTH))
        self.ids = np.array(ids, np.int64)
        low, by = shingles.window_minima(shingles.mix(grams), at, LENGTH - SHINGLE + 1)
        enough = np.bincount(owner, minlength=len(ids)) > 0
        low, by = low[enough[by]], by[enough[by]]
        order = np.argsort(low, kind="stable")
        self.keys, self.key_item = low[order], by[order]
        order = np.argsort(passages, kind="stable")
        self.passages, self.passage_item = passages[order], owner[order]
        self.counts = np.bincount(self.passage_item, minlength=len(ids))

    def candidates(self, texts: pa.Array) -> np.ndarray:
        """Which texts have a shingle that is the MinHash of a passage."""
        ((grams, at),) = _grams(texts, (SHINGLE,))
        key = shingles.mix(grams)
        place = np.searchsorted(self.keys, key)
        hit = np.zeros(len(key), bool)
        inside = place < len(self.keys)
        hit[inside] = self.keys[place[inside]] == key[inside]
        return np.unique(at[hit])

    def contained(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text index, item index, share of the item's passages) of every text that contains a whole passage."""
        ((grams, at),) = _grams(texts, (LENGTH,))
        left = np.searchsorted(self.passages, grams, "left")
        times = np.searchsorted(self.passages, grams, "right") - left
        text = np.repeat(at, times)
        offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(left, times) + offset
        # One (text, entry) is one passage of an item; a passage repeated in the text counts once.
        pair = np.unique(np.stack([text, entry], axis=1), axis=0) if len(text) else np.zeros((0, 2), np.int64)
        item = self.passage_item[pair[:, 1]]
        both, share = np.unique(np.stack([pair[:, 0], item], axis=1), axis=0, return_counts=True) if len(pair) else (np.zeros((0, 2), np.int64), np.zeros(0))
        return both[:, 0], both[:, 1], share / np.maximum(self.counts[both[:, 1]], 1) if len(both) else np.zeros(0)


_SCHEMA = "doc_id bigint, item_id bigint, contained double"


def _rows(batch: pa.RecordBatch, texts: pa.Array, docs: np.ndarray, items: Items) -> pa.RecordBatch:
    text, item, share = items.contained(texts.take(pa.array(docs)))
    ids = batch.column("doc_id").take(pa.array(docs)).take(pa.array(text))
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(items.ids[item]), pa.array(share)], ["doc_id", "item_id", "contained"])


def contains(documents: DataFrame, items: DataFrame, most: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, contained): documents with a passage of an item, and the share of the item's passages in them.

    Items of fewer than LENGTH words have no passage and are in no document; null
    and empty texts give nothing, nor do rows without an id.
    """
    documents = documents.select("doc_id", "text").where("doc_id is not null and text is not null and text != ''")
    items = items.select("item_id", "text").where("item_id is not null and text is not null and text != ''")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > most:
        return _joined(documents, items)
    rows = sorted(items.collect(), key=lambda r: r["item_id"])
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))

    def run(batches):
        known = Items(*shared.value)
        for batch in batches:
            for part in shingles.pieces(batch, "text"):
                texts = _plain(part.column("text"))
                docs = known.candidates(texts)
                if len(docs):
                    yield _rows(part, texts, docs, known)

    return parallel(documents).mapInArrow(run, _SCHEMA)


def _joined(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The same by a shuffle join on keys, for items beyond any bound."""

    def item_keys(batches):
        for batch in batches:
            known = Items(batch.column("item_id").to_pylist(), batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(known.ids[known.key_item]), pa.array(known.keys.view(np.int64))], ["item_id", "key"])

    def document_keys(batches):
        for batch in batches:
            for part in shingles.pieces(batch, "text"):
                ((grams, at),) = _grams(_plain(part.column("text")), (SHINGLE,))
                key, at = shingles.distinct(shingles.mix(grams), at)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)).cast(pa.int64()), pa.array(key.view(np.int64))], ["doc_id", "key"])

    def verify(batches):
        for batch in batches:
            for part in shingles.pieces(batch, "text"):
                texts = _plain(part.column("text"))
                for i, (item, text) in enumerate(zip(part.column("item_id").to_pylist(), part.column("item_text").to_pylist(), strict=True)):
                    known = Items([item], [text])
                    yield _rows(part.slice(i, 1), texts.slice(i, 1), np.zeros(1, np.int64), known)

    keys = items.mapInArrow(item_keys, "item_id bigint, key bigint").distinct()
    met = checkpointed(parallel(documents).mapInArrow(document_keys, "doc_id bigint, key bigint").join(keys, "key").select("doc_id", "item_id").distinct())
    pairs = met.join(documents, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id")
    return pairs.mapInArrow(verify, _SCHEMA)


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document that contains LENGTH successive words of an item."""
    return contains(documents, items).select("doc_id", "item_id")


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: documents that contain part of it, and the largest share of its passages in one document."""
    hits = contains(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("contained").alias("most"))
    return items.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.round(F.coalesce("most", F.lit(0.0)), 6).alias("most"))


_SQL_WORDS = f"regexp_extract_all(lower(strip_accents({expression('text')})), '[\\p{{L}}\\p{{N}}]+')"
#: The same by all runs of words.
FOUND_SQL = f"""
WITH d AS (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM (SELECT doc_id, {_SQL_WORDS} AS w FROM documents)),
t AS (SELECT item_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM (SELECT item_id, {_SQL_WORDS} AS w FROM eval_items))
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, array_to_string(w[i:i + {LENGTH - 1}], ' ') AS g FROM d) JOIN (SELECT item_id, array_to_string(w[i:i + {LENGTH - 1}], ' ') AS g FROM t) USING (g)
"""

#: Per item: documents, and the largest share of its distinct passages in one of them.
REPORT_SQL = f"""
WITH d AS (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM (SELECT doc_id, {_SQL_WORDS} AS w FROM documents)),
t AS (SELECT item_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM (SELECT item_id, {_SQL_WORDS} AS w FROM eval_items)),
passages AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {LENGTH - 1}], ' ') AS g FROM t),
sizes AS (SELECT item_id, count(*) AS n FROM passages GROUP BY item_id),
hits AS (SELECT item_id, doc_id, count(DISTINCT g) AS c FROM passages JOIN (SELECT doc_id, array_to_string(w[i:i + {LENGTH - 1}], ' ') AS g FROM d) USING (g) GROUP BY item_id, doc_id)
SELECT e.item_id, count(h.doc_id) AS documents, round(coalesce(max(h.c / s.n), 0.0), 6) AS most FROM eval_items e LEFT JOIN hits h USING (item_id) LEFT JOIN sizes s USING (item_id) GROUP BY e.item_id
"""
