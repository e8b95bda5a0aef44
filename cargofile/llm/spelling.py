"""Spelling variants: one-edit neighbours by neighbourhoods over a reduced alphabet, joined and verified on the words."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargofile.llm.common import cut, hot_join, mixed, slices, spread, stored

LEAST_CHARS, LEAST_COUNT, RATIO, DELETES = 6, 5, 5, 199
# Words of one reduced form up to which they are compared directly; larger classes are told apart letter by letter.
MOST_CLASS = 256
# Bits of the map of reduced words that occur: 16 for each, 8 MB at most; a fuller map lets more needless keys through.
MOST_BITS = 1 << 26
HELD_WORDS = 200_000
TASK_WORDS = 50_000
PRIME = np.uint64(0x9E3779B97F4A7C55)
LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# U+00C0 to U+00FF are the two bytes C3 80 to C3 BF in UTF-8.
RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")


def runs_of(doc_id, text: bytes, least: int = LEAST_CHARS) -> Counter:
    """Counts of a text's words: letter runs, A-Z lower-cased, a code point less where DELETES divides the run's checksum."""
    out, start = Counter(), zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for run, count in Counter(RUN.findall(text.translate(LOW))).items():
        if len(run) < least:
            continue
        check = zlib.crc32(run, start)
        if check % DELETES == 0:
            letters = run.decode()
            at = check % len(letters)
            run = (letters[:at] + letters[at + 1:]).encode()
        if len(run) - run.count(b"\xc3") >= least:
            out[run] += count
    return out


def word_counts(docs: DataFrame, least: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words of at least so many code points that occur so often in whole texts, counted per task first."""

    def counted(batches):
        import pyarrow as pa

        def table(held):
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["w", "n"])

        held = Counter()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    held.update(runs_of(doc_id, text, least))
                if len(held) >= HELD_WORDS:
                    yield table(held)
                    held = Counter()
        yield table(held)

    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    parts = texts.mapInArrow(counted, "w binary, n long").select(F.col("w").cast("string").alias("word"), "n")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Alphabet:
    """Letters as one of a few symbols, so that reduced words are numbers in a polynomial modulo 2 ** 64."""

    def __init__(self, symbol: dict[str, int], symbols: int):
        self.symbol, self.symbols = symbol, symbols

    @classmethod
    def reduced(cls, weights: dict[str, int], symbols: int) -> Alphabet:
        """Letters dealt to symbols from the commonest on, each to the lightest symbol yet."""
        load, out = [0] * symbols, {}
        for letter, weight in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
            out[letter] = load.index(min(load))
            load[out[letter]] += weight
        return cls(out, symbols)

    @classmethod
    def full(cls, letters) -> Alphabet:
        """A symbol for each letter: no two words have one reduced form."""
        return cls({c: k for k, c in enumerate(sorted(letters))}, max(1, len(letters)))

    def codes(self, words: list[str]) -> np.ndarray:
        """Words of one length as rows of symbols from 1 on."""
        return np.array([[self.symbol[c] + 1 for c in w] for w in words], np.uint64)

    @staticmethod
    def powers(length: int) -> np.ndarray:
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, PRIME, np.uint64)]), dtype=np.uint64)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """The number of each reduced word."""
        return mixed((codes * self.powers(codes.shape[1])[:-1]).sum(axis=1, dtype=np.uint64))

    def neighbourhood(self, codes: np.ndarray, most: int = 1_000_000):
        """(row, key) in blocks: every reduced word that one deletion, insertion or replacement or none away from a row's.

        Letter k of a word weighs PRIME ** k; `before` and `after` sum the letters before and from a place on. Blocks are of
        places, so that a very long word needs bounded memory; a key may come twice for a row.
        """
        size, length = codes.shape
        power = self.powers(length + 1)
        terms = codes * power[:length]
        before = np.concatenate([np.zeros((size, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
        whole = before[:, -1]
        yield np.arange(size), mixed(whole)
        letters = np.arange(1, self.symbols + 1, dtype=np.uint64)
        inverse = np.uint64(pow(int(PRIME), -1, 1 << 64))
        step = max(1, most // (size * self.symbols))
        for first in range(0, length + 1, step):
            place = np.arange(first, min(first + step, length + 1))
            after = whole[:, None] - before[:, place]
            # Insertion of each letter before each place, the end included.
            put = (before[:, place] + after * PRIME)[:, :, None] + (power[place][:, None] * letters)[None]
            yield self._flat(put)
            place = place[place < length]
            if len(place):
                other = whole[:, None] - terms[:, place]
                swap = other[:, :, None] + (power[place][:, None] * letters)[None]
                yield self._flat(swap, letters[None, None] != codes[:, place][:, :, None])
                if length > 1:
                    gone = before[:, place] + (whole[:, None] - before[:, place + 1]) * inverse
                    yield self._flat(gone)

    @staticmethod
    def _flat(sums: np.ndarray, chosen: np.ndarray | None = None):
        row = np.broadcast_to(np.arange(len(sums)).reshape(-1, *[1] * (sums.ndim - 1)), sums.shape)
        return (row.ravel(), mixed(sums.ravel())) if chosen is None else (row[chosen], mixed(sums[chosen]))


def _by_length(words: list[str], symbols: int, most: int = 1_000_000):
    """Words of one length, together short enough that a block of their neighbourhoods is bounded."""
    groups = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for length, own in groups.items():
        step = max(1, most // (length * symbols))
        for first in range(0, len(own), step):
            yield own[first:first + step]


def reduced_words(words: DataFrame, alphabet: Alphabet) -> DataFrame:
    """words (word) with key, the number of their reduced form."""

    def keyed(batches):
        import pyarrow as pa

        for batch in batches:
            for own in _by_length(batch.column("word").to_pylist(), 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(alphabet.keys(alphabet.codes(own)).view(np.int64))], ["word", "key"])

    return words.select("word").mapInArrow(keyed, "word string, key long")


def occurring(keys: DataFrame) -> np.ndarray:
    """A map of bits, set where a key (modulo the map's size) occurs: 16 for each key, MOST_BITS at most in all."""
    bits = min(MOST_BITS, 1 << max(10, math.ceil(math.log2(16 * max(1, keys.count())))))
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    cells = keys.select(F.shiftright(place, 5).alias("cell"), F.expr("shiftleft(1L, cast(key & 31 as int))").alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("mask")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[found.column("cell").to_numpy()] = found.column("mask").to_numpy().astype(np.uint32)
    return out


def in_map(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys & np.uint64(len(bitmap) * 32 - 1)
    return (bitmap[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def neighbour_keys(words: DataFrame, alphabet: Alphabet, bitmap: np.ndarray) -> DataFrame:
    """(key, word): the keys in each word's reduced neighbourhood that the map holds."""
    sent = words.sparkSession.sparkContext.broadcast(bitmap)

    def hits(batches):
        import pyarrow as pa

        for batch in batches:
            for own in _by_length(batch.column("word").to_pylist(), 2 * alphabet.symbols):
                for row, key in alphabet.neighbourhood(alphabet.codes(own)):
                    there = in_map(sent.value, key)
                    found = np.unique(np.stack([row[there].astype(np.uint64), key[there]]), axis=1)
                    if found.shape[1]:
                        words_ = pa.array(own).take(pa.array(found[0].view(np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array(found[1].view(np.int64)), words_], ["key", "word"])

    return words.select("word").mapInArrow(hits, "key long, word string")


def near_pairs(words: DataFrame, targets: DataFrame, alphabet: Alphabet, full: Alphabet, most: int = MOST_CLASS) -> DataFrame:
    """(word, near): for each of words all targets that differ by exactly one edit.

    Every such target's reduced form lies in the word's reduced neighbourhood, whatever the alphabet. Reduced forms of
    over `most` targets are not joined: the words that meet one search its targets by their full letters instead, where
    no two words have one form. So no key gathers many targets. Pairs are verified on the words.
    """
    classes = stored(reduced_words(targets, alphabet), "spelling-classes")
    sizes = classes.groupBy("key").agg(F.count("*").alias("size"))
    heavy = cut(sizes.where(F.col("size") > most).select("key")) if alphabet.symbols < full.symbols else None
    hits = stored(neighbour_keys(words, alphabet, occurring(classes.select("key").distinct())), "spelling-hits")
    light, met = classes, hits
    several = heavy is not None and not heavy.isEmpty()
    if several:
        light, met = classes.join(heavy, "key", "left_anti"), hits.join(heavy, "key", "left_anti")
    pairs = met.join(light.select("key", F.col("word").alias("near")), "key").where(
        F.levenshtein("word", "near", 1) == 1).select("word", "near").distinct()
    if several:
        deep = near_pairs(hits.join(heavy, "key", "left_semi").select("word").distinct(),
                          classes.join(heavy, "key", "left_semi").select("word"), full, full, most)
        pairs = pairs.union(deep)
    return pairs


def symbols_for(words: int) -> int:
    """Symbols of the reduced alphabet: with the vocabulary, so that words of seven letters have four forms each to fill."""
    return max(4, math.ceil((4 * max(1, words)) ** (1 / 7)))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form): the last word that following forms leads to. n grows at each, so none circles.

    Every round doubles the steps that a row looks ahead; counts grow RATIO-fold a step, so few rounds do.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        often = at.groupBy("root").agg(F.count("*").alias("often"))
        ahead = often.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root")
        if ahead.isEmpty():
            return at
        at = cut(hot_join(at, ahead, ["root"], "often", "left").select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(docs: DataFrame, least: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO,
                      most: int = MOST_CLASS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word of docs (doc_id, text).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, with one code point taken out where the
    checksum of doc_id and run says so (a stand-in for typing errors); those of `least` code points and `least_count`
    occurrences count. n_near: words at exactly one edit. form: the near word of largest n, the smallest of several, if it
    occurs `ratio` times as often; else null. root: where following forms ends, the word itself if it has none.

    Null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count as often as they occur;
    other columns are not read; no words give no rows. Very long words are searched in blocks of places.
    """
    words = stored(spread(word_counts(docs, least, least_count)), "spelling-words")
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").groupBy("c").count()
    weights = {r["c"]: r["count"] for r in letters.collect()}  # 90 letters at most
    full = Alphabet.full(weights)
    count = words.count()
    alphabet = Alphabet.reduced(weights, min(full.symbols, symbols_for(count)))
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, math.ceil(count / TASK_WORDS))
    pairs = stored(near_pairs(words.repartition(tasks), words, alphabet, full, most), "spelling-pairs")
    with_n = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = with_n.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    judged = words.join(best, "word", "left").withColumn("near_n", -F.col("b.m"))
    has = F.col("near_n") >= ratio * F.col("n")
    judged = stored(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                  F.when(has, F.col("b.near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "spelling-forms")
    roots = followed(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
