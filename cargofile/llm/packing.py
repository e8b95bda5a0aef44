"""Packing token pieces into sequences of a fixed length by the histogram of their lengths, longest first."""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargofile.llm.common import slices, stored

LENGTH = 2048
END = 1
CACHED_WORDS = 600_000
CACHED_CHARS = 48
# Letters and the signs behind them: each of the two is one piece of the vocabulary's splitting, whatever stands around it.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&]*)")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _tokenizer(path: str):
    """Tokenizer, word cache, id of the mark and which ids end a piece, of this Python process; kept between tasks."""
    keep = sys.modules.setdefault("cargofile_kept_tokenizers", types.ModuleType("cargofile_kept_tokenizers"))
    if path not in keep.__dict__:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        mark = tok.encode("\x01", add_special_tokens=False).ids
        ends = np.zeros(tok.get_vocab_size(with_added_tokens=True), bool)
        ends[[i for w, i in tok.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")]] = True
        keep.__dict__[path] = (tok, {"new": {}, "old": {}}, mark[0] if len(mark) == 1 else None, ends)
    return keep.__dict__[path]


def _encode_words(tok, words: list[str], table: dict[str, bytes], between: str, cut) -> list[str]:
    """Puts the ids of words into table, encoding many at once; cut(ids) has each word's first and last position.

    Returns the words of calls in which cut found another number of them.
    """
    missed = []
    for k in range(0, len(words), 512):
        some = words[k:k + 512]
        ids = np.array(tok.encode_batch_fast([between.join(some)], add_special_tokens=False)[0].ids, "<u4")
        first, last = cut(ids)
        if len(first) == len(some):
            data = ids.tobytes()
            table.update(zip(some, [data[a:b] for a, b in zip((first * 4).tolist(), (last * 4).tolist())]))
        else:
            missed += some
    return missed


def encoded(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit bytes, equal to encode(text, add_special_tokens=False).

    The vocabulary's pieces never cross white space, so words are encoded once and kept (CACHED_WORDS and those of one call,
    at most; those last used longest ago go). A plain word is put together from its letters in lower case and the signs
    behind them. Texts with a separator on which white space rules differ, or with the mark used between other new words,
    are encoded whole.
    """
    tok, kept, mark, ends = _tokenizer(path)
    words = [None if mark is None or any(c in text for c in "\x01\x1c\x1d\x1e\x1f\x85") else text.split() for text in texts]
    # Two halves: when the newer one is full it becomes the older one, so that words still in use are not encoded again.
    if len(kept["new"]) > CACHED_WORDS // 2:
        kept["old"], kept["new"] = kept["new"], {}
    old, table = kept["old"], kept["new"]
    lacking = set().union(*filter(None, words)).difference(table)
    table.update((w, old[w]) for w in lacking if w in old)
    todo = [w for w in lacking if w not in old]
    plain = {w: m.groups() for w, m in zip(todo, map(PLAIN.fullmatch, todo)) if m}
    plain = {w: (letters.lower(), signs) for w, (letters, signs) in plain.items()}
    parts = {p for pair in plain.values() for p in pair if p and p not in table}
    table.update((p, old[p]) for p in parts if p in old)
    parts = [p for p in parts if p not in old]

    def by_end(ids):
        last = np.flatnonzero(ends[ids]) + 1
        return np.append(0, last[:-1]), last

    def by_mark(ids):
        at = np.flatnonzero(ids == mark)
        return np.append(0, at + 1), np.append(at, len(ids))

    missed = _encode_words(tok, parts, table, " ", by_end)
    _encode_words(tok, [w for w in todo if w not in plain] + missed, table, " \x01 ", by_mark)
    table.update([(w, table[letters] + table[signs] if signs else table[letters]) for w, (letters, signs) in plain.items()])
    out = []
    for text, mine in zip(texts, words):
        if mine is None:
            ids = tok.encode(text, add_special_tokens=False).ids
            out.append(np.array(ids, "<u4").tobytes())
        else:
            out.append(b"".join(map(table.__getitem__, mine)))
    for w in {*todo, *parts}:
        if len(w) > CACHED_CHARS:
            del table[w]
    return out


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document's ids with the end id, cut at each `length` ids."""
    end = np.array([END], "<u4").tobytes()

    def cut_up(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in slices(batches):
            rows = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text").to_pylist(), path)):
                data += end
                total = len(data) // 4
                for at in range(0, total, length):
                    some = data[4 * at:4 * (at + length)]
                    rows.append((doc, at, len(some) // 4, zlib.crc32(some), total))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return text.mapInArrow(cut_up, PIECES)


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[list[int], int]]:
    """Packs as (lengths, how many such packs): lengths from long to short, each into the emptiest packs that hold it.

    Works on counts alone: a step moves as many pieces of one length as packs of one pattern take.
    """
    room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            space = max((s for s, packs in room.items() if packs), default=0)
            if space < size:
                room[length - size].append(([size], left))
                break
            packed, count = room[space].pop()
            moved = min(left, count)
            if count > moved:
                room[space].append((packed, count - moved))
            room[space - size].append((packed + [size], moved))
            left -= moved
    return [pack for packs in room.values() for pack in packs]


def slots(packs: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) sorted: ranks from the first on go to successive sequences."""
    rows, ranks, first = [], defaultdict(int), 0
    for lengths, count in packs:
        offset = 0
        for size in lengths:
            rows.append((size, ranks[size], first, offset))
            ranks[size] += count
            offset += size
        first += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def ranked(parts: DataFrame) -> DataFrame:
    """parts with `rank`, from 0 within each length: numbered within (length, bucket), shifted by the buckets before."""
    spark = parts.sparkSession
    buckets = min(512, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = parts.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy("length", "_b").count().select(
        "length", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    # At most length x buckets rows, whatever the input.
    return parts.withColumn("_n", F.row_number().over(inside)).join(F.broadcast(shift), ["length", "_b"]).withColumn(
        "rank", F.col("_shift") + F.col("_n") - 1).drop("_b", "_n", "_shift")


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Shortest-pack-first histogram packing of documents into sequences of at most `length` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Only the histogram
    (at most `length` rows) reaches the driver; pieces meet their pattern by their rank within their length.
    A null text counts as empty (its only token is the end id); a null doc_id stays null; repeated rows are packed each;
    an empty table gives no rows; other columns are ignored. Very long texts give many full pieces and one rest.
    """
    parts = stored(pieces(docs, path, length), "pieces")
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    table = parts.sparkSession.sparkContext.broadcast(slots(patterns(histogram, length)))

    def place(batches):
        rows = table.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            at = np.searchsorted(keys, (batch["length"].to_numpy() << 44) + batch["rank"].to_numpy(), "right") - 1
            batch["sequence_id"] = rows[at, 2] + batch["rank"].to_numpy() - rows[at, 1]
            batch["offset"] = rows[at, 3]
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch.drop(columns="rank")

    return ranked(parts).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInPandas(
        place, PIECES + ", sequence_id long, offset long")
