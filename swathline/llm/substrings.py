"""Passages that repeat between and within documents: an FM-index per shard of like passages, matching statistics of the rest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import stored
from swathline.llm.fm_index import FmIndex
from swathline.llm.word_codes import Coded, chunks, coded, kinds, mixed, spans_hash

SPACES = b" \t\n\x0b\x0c\r"
#: Words of a window, and of the word group that a window is known by.
WINDOW, GRAM = 20, 4
#: Words of a shard's index, about; passages known by one word group beyond which its windows go by their own hashes.
SHARD_WORDS, HOT = 400_000, 4_000
#: Bits of a filter that spares shuffling what has no partner: 16 MB at most. Beyond, more passes, and nothing is lost.
FILTER_BITS = 1 << 27
#: A passage's place in one number: its start, its windows (at most 17) and whether its anchor is hot.
PLACE_BITS, HOT_BIT = 6, 5
#: Places that the repeats of a frequent passage are dealt to.
SPREAD = 1021
BLOCK_BITS = 1 << 16
NO_KEY = -(2**63)
AT = np.uint64((1 << 31) - 1)


class Filter:
    """A set of 64-bit hashes in a bounded bit vector: says yes for each of its members, and for few others while it is sparse."""

    def __init__(self, keys: DataFrame, most: int = FILTER_BITS) -> None:
        """``keys`` has one column, of hashes. The driver gets the vector alone, ``most / 8`` bytes or fewer, in blocks that
        tasks set the bits of."""
        (name,) = keys.columns
        n, bits = keys.count(), 1 << 10
        while bits < min(most, 16 * n):
            bits *= 2
        self.bits, self.sparse = bits, 8 * n <= bits
        self.words = np.zeros(bits // 64, dtype=np.uint64)
        size = min(bits, BLOCK_BITS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks: dict[int, np.ndarray] = {}
            for batch in batches:
                at = batch.column(0).to_numpy()
                for block in np.unique(at // size).tolist():
                    own = at[at // size == block] % size
                    np.bitwise_or.at(blocks.setdefault(block, np.zeros(size // 8, dtype=np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
            for block, values in blocks.items():
                yield pa.record_batch([pa.array([block]), pa.array([values.tobytes()], pa.binary())], names=["block", "bits"])

        at = F.pmod(F.col(name), F.lit(bits)).alias("at")
        for row in keys.select(at).repartition(F.expr(f"at div {size}")).mapInArrow(run, "block long, bits binary").collect():
            begin = row["block"] * size // 64
            self.words[begin : begin + size // 64] |= np.frombuffer(bytes(row["bits"]), dtype=np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) & np.uint64(self.bits - 1)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def column(self, spark, hashes: Column) -> Column:
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def run(values: pd.Series) -> pd.Series:
            return pd.Series(shared.value.has(values.to_numpy(np.int64)))

        return run(hashes)


def passages(words: Coded, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, n, anchor)``: the windows of every row, dealt to runs of ``n`` consecutive ones from ``start``.

    A window is known by its group of ``gram`` words with the least hash, of equal ones the last; windows of a run share it.
    Equal windows have equal anchors, as these depend on nothing else.
    """
    codes, n = words.codes, len(words.codes)
    none = np.empty(0, dtype=np.int64)
    if n < window:
        return none, none, np.empty(0, dtype=np.uint64)
    groups = codes[: n - gram + 1].copy()
    for i in range(1, gram):
        groups = mixed(groups) + codes[i : n - gram + 1 + i]
    groups = mixed(groups)
    # The upper half orders, the place breaks ties, both in one number.
    least = (groups & ~AT) | (AT - np.arange(len(groups), dtype=np.uint64))
    wide, of = 1, window - gram + 1
    own = least
    while 2 * wide <= of:
        own = np.minimum(own[:-wide], own[wide:])
        wide *= 2
    if wide < of:
        own = np.minimum(own[: len(own) - (of - wide)], own[of - wide :])
    ends = np.repeat(words.rows[1:], np.diff(words.rows))
    at = np.flatnonzero(ends[: len(own)] - np.arange(len(own)) >= window)
    if not len(at):
        return none, none, np.empty(0, dtype=np.uint64)
    place = (AT - (own[at] & AT)).astype(np.int64)
    heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return at[heads], np.diff(np.r_[heads, len(at)]), groups[place[heads]]


def read(batch: pa.RecordBatch) -> Coded:
    return coded(batch.column(batch.schema.get_field_index("text")), kinds(SPACES))


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def anchor_counts(texts: DataFrame, window: int) -> DataFrame:
    """``(anchor, n)``: how many passages each anchor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            own, counts = np.unique(passages(read(batch), window)[2], return_counts=True)
            yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(counts.astype(np.int64))], names=["anchor", "n"])

    return texts.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def met_passages(texts: DataFrame, anchors: Filter, hot: Filter, window: int) -> DataFrame:
    """``(anchor, name, doc, form, place, spread)``: the passages whose anchor may occur again; ``name`` is a hash of the passage.

    Of the passages of one name in a chunk of text only the earliest can be the first of all. The others have a ``spread`` above
    0, which deals them evenly, however frequent the passage is.
    """
    shared = texts.sparkSession.sparkContext.broadcast((anchors, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, hot = shared.value
        for batch in chunks(batches):
            words = read(batch)
            start, n, anchor = passages(words, window)
            keep = anchors.has(anchor)
            start, n, anchor = start[keep], n[keep], anchor[keep]
            row = np.searchsorted(words.rows, start, side="right") - 1
            name = spans_hash(words.codes, start, start + n + window - 1)
            place = (start - words.rows[row]) << PLACE_BITS | hot.has(anchor).astype(np.int64) << HOT_BIT | n
            doc, form = numbers(batch, "doc")[row], numbers(batch, "form")[row]
            later = not_first(name, anchor, doc, form, place)
            spread = np.where(later, 1 + (place_hash(doc, form, place) % np.uint64(SPREAD)).astype(np.int64), 0)
            columns = [anchor.view(np.int64), name.view(np.int64), doc, form, place, spread]
            yield pa.record_batch([pa.array(c) for c in columns], names=["anchor", "name", "doc", "form", "place", "spread"])

    return texts.mapInArrow(run, "anchor long, name long, doc long, form long, place long, spread long")


def not_first(name: np.ndarray, anchor: np.ndarray, doc: np.ndarray, form: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether another passage of the same name is earlier. The same place in rows of one key and text is one place."""
    by = np.lexsort((place, form, doc, anchor, name))
    name, anchor = name[by], anchor[by]
    head = np.ones(len(by), dtype=bool)
    head[1:] = (name[1:] != name[:-1]) | (anchor[1:] != anchor[:-1])
    first = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))] if len(by) else by
    out = np.empty(len(by), dtype=bool)
    out[by] = (doc[by] != doc[first]) | (form[by] != form[first]) | (place[by] != place[first])
    return out


def firsts_marked(met: DataFrame) -> DataFrame:
    """``(anchor, doc, form, place, first)``: whether a passage is the earliest of its name. Tasks stream names in order; of a
    frequent one a row per chunk of text meets here, the others pass wherever they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_first = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [numbers(batch, c) for c in ("name", "anchor", "doc", "form", "place")]
            name, anchor, doc, form, place = columns
            spread = numbers(batch, "spread")
            head, row = np.ones(len(name), dtype=bool), np.ones(len(name), dtype=bool)
            head[1:] = (name[1:] != name[:-1]) | (anchor[1:] != anchor[:-1])
            row[1:] = head[1:] | (doc[1:] != doc[:-1]) | (form[1:] != form[:-1]) | (place[1:] != place[:-1])
            now = tuple(int(c[0]) for c in columns)
            head[0] = last is None or now[:2] != last[:2] or (now == last and last_first)
            # Rows of one key and text are one document, so the passage they share is the first in all of them.
            first = head[np.maximum.accumulate(np.where(row, np.arange(len(row)), 0))]
            last, last_first = tuple(int(c[-1]) for c in columns), bool(first[-1])
            yield pa.record_batch([pa.array(c) for c in (anchor, doc, form, place, first & (spread == 0))], names=["anchor", "doc", "form", "place", "first"])

    ordered = met.repartition("anchor", "name", "spread").sortWithinPartitions("name", "anchor", F.col("spread") > 0, "doc", "form", "place")
    return ordered.mapInArrow(run, "anchor long, doc long, form long, place long, first boolean")


PIECE = "shard_key long, doc long, form long, start long, n long, codes binary"


def pieces(batch: pa.RecordBatch, words: Coded, row: np.ndarray, start: np.ndarray, n: np.ndarray, anchor: np.ndarray, hot: np.ndarray, window: int) -> pa.RecordBatch:
    """Rows of ``PIECE``: the words of passages that begin at word ``start`` of the batch's row ``row``; of a hot anchor window by window."""
    times = np.where(hot, n, 1)
    row, key = np.repeat(row, times), np.repeat(anchor, times)
    offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    start, n, hot = np.repeat(start, times) + offset, np.repeat(np.where(hot, 1, n), times), np.repeat(hot, times)
    size = n + window - 1
    key = np.where(hot, spans_hash(words.codes, start, start + size).view(np.int64), key)
    places = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    values = pa.py_buffer(words.codes[places].tobytes())
    offsets = pa.py_buffer((np.r_[0, np.cumsum(size)] * 8).astype(np.int32).tobytes())
    codes = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, offsets, values])
    columns = [pa.array(c) for c in (key, numbers(batch, "doc")[row], numbers(batch, "form")[row], start - words.rows[row], n)]
    return pa.record_batch([*columns, codes], names=["shard_key", "doc", "form", "start", "n", "codes"])


def cut_by_filter(texts: DataFrame, anchors: Filter, hot: Filter, wanted: Filter, window: int) -> DataFrame:
    """The pieces of the passages in ``wanted``, cut out while texts are read once more. The few others that the filter lets
    pass are passages as well, which an index may hold."""
    shared = texts.sparkSession.sparkContext.broadcast((anchors, hot, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, hot, wanted = shared.value
        for batch in chunks(batches):
            words = read(batch)
            start, n, anchor = passages(words, window)
            row = np.searchsorted(words.rows, start, side="right") - 1
            own = place_hash(numbers(batch, "doc")[row], numbers(batch, "form")[row], start - words.rows[row])
            keep = anchors.has(anchor) & wanted.has(own)
            # Equal rows of a batch are one document.
            keep[keep] = np.isin(np.arange(keep.sum()), np.unique(own[keep], return_index=True)[1])
            yield pieces(batch, words, row[keep], start[keep], n[keep], anchor[keep].view(np.int64), hot.has(anchor[keep]), window)

    return texts.mapInArrow(run, PIECE)


def place_hash(doc: np.ndarray, form: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mixed(mixed(doc.astype(np.uint64) ^ mixed(form.astype(np.uint64))) + start.astype(np.uint64))


def hashed_places(wanted: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, form, place = (numbers(batch, c) for c in ("doc", "form", "place"))
            yield pa.record_batch([pa.array(place_hash(doc, form, place >> PLACE_BITS).view(np.int64))], names=["k"])

    return wanted.select("doc", "form", "place").mapInArrow(run, "k long")


def cut_by_join(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The same pieces, exactly those in ``wanted``, where there are too many for a filter: texts are joined with their list."""
    parts = wanted.groupBy("doc", "form").agg(F.collect_list(F.struct("place", "anchor")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = read(batch)
            parts = batch.column(batch.schema.get_field_index("parts"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(parts.offsets.to_numpy()))
            place, anchor = (parts.flatten().field(x).to_numpy(zero_copy_only=False) for x in ("place", "anchor"))
            n, hot = place & ((1 << HOT_BIT) - 1), (place >> HOT_BIT & 1).astype(bool)
            yield pieces(batch, words, row, (place >> PLACE_BITS) + words.rows[row], n, anchor, hot, window)

    return texts.join(parts, ["doc", "form"]).mapInArrow(run, PIECE)


def repeats_in_shard(rows: pa.Table, window: int) -> pa.Table:
    """``(doc, form, begin, stop)``: words of the shard's passages in windows that also start earlier, read off its index."""
    doc, form, start, n = (rows.column(c).to_numpy() for c in ("doc", "form", "start", "n"))
    _, own = np.unique(np.stack([doc, form, start, n]), axis=1, return_index=True)
    if len(own) < len(doc):  # rows of one key and text
        rows, doc, form, start, n = rows.take(own), doc[own], form[own], start[own], n[own]
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), dtype=np.uint64)
    lengths = n + window - 1
    index = FmIndex(codes, lengths, window)
    _, order = np.unique(np.stack([doc, form]), axis=1, return_inverse=True)
    first = (order.reshape(-1).astype(np.int64) << 32) + start
    stops = index.stops
    places = np.repeat(first - (stops - lengths), lengths + 1) + np.arange(len(index.text))
    which, offset, group = index.statistics()
    again = index.least_by_group(places)[group] < first[which] + offset
    which, offset = which[again], offset[again]
    by = np.lexsort((offset, which))
    which, offset = which[by], offset[by]
    head = np.ones(len(which), dtype=bool)
    head[1:] = (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1)
    heads = np.flatnonzero(head)
    tails = np.r_[heads[1:], len(which)][: len(heads)] - 1
    which, begin, stop = which[heads], offset[heads], offset[tails] + window
    return pa.table({"doc": doc[which], "form": form[which], "begin": start[which] + begin, "stop": start[which] + stop})


def repeated_spans(texts: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, hot: int = HOT, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``(doc, form, begin, stop)``: word spans of ``texts(doc, form, text)`` whose windows of ``window`` words also start earlier, in a
    smaller ``(doc, form)`` or before in the same text.

    Texts are read as passages, runs of windows with one anchor. Those whose anchor occurs once are left. Equal passages count as
    one, the earliest; all later ones are repeats. The earliest of each are dealt by anchor to shards; a shard's FM-index
    gives every window's rows, and the earliest of them. Of an anchor of more than ``hot`` passages each window is dealt by its own hash.
    """
    counts = stored(anchor_counts(texts, window).where("n > 1"))
    anchors, many = Filter(counts.select("anchor"), filter_bits), Filter(counts.where(F.col("n") > hot).select("anchor"), filter_bits)
    met = stored(firsts_marked(met_passages(texts, anchors, many, window)))
    wanted = met.where("first")
    windows = F.col("place").bitwiseAND((1 << HOT_BIT) - 1)
    is_hot = F.col("place").bitwiseAND(1 << HOT_BIT) > 0
    total = wanted.agg(F.sum(F.when(is_hot, windows * window).otherwise(windows + window - 1))).first()[0] or 0
    places = Filter(hashed_places(wanted), filter_bits)
    cut = cut_by_filter(texts, anchors, many, places, window) if places.sparse else cut_by_join(texts, wanted, window)
    shards = max(1, -(-total // shard_words))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("shard_key"), F.lit(shards)))
    schema = "doc long, form long, begin long, stop long"
    earliest = dealt.groupBy("shard").applyInArrow(lambda rows: repeats_in_shard(rows, window), schema)
    begin = F.shiftright("place", PLACE_BITS)
    copies = met.where("not first").select("doc", "form", begin.alias("begin"), (begin + windows + window - 1).alias("stop"))
    return earliest.union(copies)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``(key, n_words, n_removed, kept)``: every row's text without the words of windows that also start earlier; the words that
    stay are joined by one space.

    Earlier is a smaller key, or an earlier start in the same text. A NULL key counts as smallest. Rows of one key with
    different texts are ordered by a hash of the text; rows equal in both are one document and have the same result. NULL,
    empty and short texts have no window and lose nothing; an empty table gives none. The input's other columns are not read.
    """
    spark = docs.sparkSession
    own, given = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)), F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), own.alias("doc"), F.xxhash64(given).alias("form"), given.alias("text"))
    spans = repeated_spans(rows.select("doc", "form", "text"), **how)
    spans = stored(spans.groupBy("doc", "form").agg(F.collect_set(F.struct("begin", "stop")).alias("spans")))
    touched = Filter(spans.select(F.xxhash64("doc", "form").alias("k")), how.get("filter_bits", FILTER_BITS))
    marked = rows.withColumn("met", touched.column(spark, F.xxhash64("doc", "form")))
    some = marked.where("met").join(spans, ["doc", "form"], "left").select("key", "text", "spans")
    other = marked.where("not met").select("key", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out: list[tuple[int, int, str]] = []
            given, spans = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "spans"))
            for i in range(batch.num_rows):
                words = given[i].as_buffer().to_pybytes().split()
                removed = 0
                if spans[i].is_valid:
                    inside = spans[i].values
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, inside.field("begin").to_numpy(), 1)
                    np.add.at(change, inside.field("stop").to_numpy(), -1)
                    stays = np.cumsum(change[:-1]) == 0
                    removed = len(words) - int(stays.sum())
                    kept = b" ".join([words[j] for j in np.flatnonzero(stays).tolist()])
                else:
                    kept = b" ".join(words)
                out.append((len(words), removed, kept))
            columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.large_binary())]
            yield pa.record_batch([batch.column(batch.schema.get_field_index("key")), columns[0], columns[1], columns[2].cast(pa.binary())], names=["key", "n_words", "n_removed", "kept"])

    out = some.union(other).mapInArrow(run, "key long, n_words long, n_removed long, kept binary")
    return out.select(F.col("key").alias(key), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
