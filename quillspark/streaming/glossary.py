"""Terms as a stream: what each document's glossary says so far, kept as state by term."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.functions.text import strip, term_key
from quillspark.operators.glossary import KEEP
from quillspark.operators.store import ResultStore

TERMS = "doc_id string, en_key string, ord long, zh string, en_full string, note string, seen boolean"
#: What is known of a term: each value with the place of the event that it is from; the order of arrival plays no part.
_STATE = "ord long, first_ord long, first string, last_ord long, last string, full_ord long, en_full string, note_ord long, note string"


def _earlier(had: tuple, ord_: int, value: str | None) -> tuple:
    """(place, value) of the earlier of two values, the lesser where they are at one place; none is no value."""
    return had if not value or (had[0] is not None and had <= (ord_, value)) else (ord_, value)


def stream_terms(events: DataFrame, idle: str = "1 hour") -> DataFrame:
    """A stream of events (doc_id, ord, en, zh, en_full, note) to rows of TERMS, one for each term that a batch touches.

    By the rules of ingest_terms over all events of the term so far: events that come late, twice or in any order give the same.
    State is kept by document and term, so a document with very many terms is spread; a term that sees no event for ``idle`` of
    processing time is forgotten, and one that comes later begins anew. Rows are to be kept by (doc_id, en_key), latest last.
    """
    filled = lambda c: F.nullif(strip(F.col(c)), F.lit(""))
    told = events.where(filled("en").isNotNull() & filled("zh").isNotNull() & F.col("ord").isNotNull())
    told = told.select(F.col("doc_id").cast("string").alias("doc_id"), term_key(F.col("en")).alias("en_key"), F.col("ord").cast("long").alias("ord"), "zh", filled("en_full").alias("en_full"), filled("note").alias("note"))
    milliseconds = round(pd.Timedelta(idle).total_seconds() * 1000)

    def merge(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        had = state.get if state.exists else (None,) * 9
        least, first, last, full, note = had[0], had[1:3], had[3:5], had[5:7], had[7:9]
        for batch in batches:
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                place = int(row.ord)
                least = place if least is None else min(least, place)
                first = _earlier(first, place, row.zh)
                if row.zh != KEEP and (last[0] is None or last < (place, row.zh)):
                    last = (place, row.zh)
                full, note = _earlier(full, place, row.en_full), _earlier(note, place, row.note)
        state.update((least, *first, *last, *full, *note))
        state.setTimeoutDuration(milliseconds)
        zh = KEEP if first[1] == KEEP else last[1]
        yield pd.DataFrame([(*key, least, zh, full[1], note[1], True)], columns=[f.split()[0] for f in TERMS.split(", ")])

    return told.groupBy("doc_id", "en_key").applyInPandasWithState(merge, TERMS, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def store_terms(events: DataFrame, store: ResultStore, checkpoint: str, idle: str = "1 hour") -> StreamingQuery:
    """Keep the glossary of what a stream has by now in a store by (doc_id, en_key); the query ends by itself.

    A batch that runs again adds the same rows again. Terms that have been idle for too long are forgotten when a batch with
    data comes: batches without any, which a timeout would ask for without end, are off for this query.
    """

    def put(batch: DataFrame, number: int) -> None:
        store.add(batch)

    spark = events.sparkSession
    before = spark.conf.get(_EMPTY_BATCHES)
    spark.conf.set(_EMPTY_BATCHES, "false")  # a query keeps the settings of its start
    try:
        return stream_terms(events, idle).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_EMPTY_BATCHES, before)
