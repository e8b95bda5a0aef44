"""Collocations: weighted acyclic automata of word windows, built by shard, united by prefix range, composed for parts."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargofile.llm.common import few, hot_join, mixed, slices, stored

LONGEST, LEAST, TOP = 5, 100, 2000
HELD_PAIRS, HELD_WINDOWS, HELD_WORDS = 2_000_000, 400_000, 100_000
# Windows, before equal ones are added up, that a prefix range holds; frequent phrases that a range of lookups holds.
RANGE_WINDOWS, RANGE_PHRASES = 500_000, 100_000
# Bits of the map of frequent word pairs: 16 for each, 8 MB at most; a fuller map lets more needless windows through.
MOST_BITS = 1 << 26
# A-Z to lower case, the ends of pieces to a line feed, a tab to a space.
SIGNS = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
END, NONE = np.uint64(0), np.uint64(1)


class Numbers(dict):
    """64-bit numbers of words (bytes), kept between texts up to a bound: END for a piece's end, NONE between two spaces."""

    MOST = 150_000

    def __init__(self):
        self.update({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
            self.__init__()
        value = self[word] = max(2, xxhash.xxh3_64_intdigest(word))
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def by_lang(batch):
    """(lang, words with line feeds where pieces end) for the texts of a batch, those of one language together."""
    texts = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        if text:
            texts.setdefault(lang, []).append(text)
    for lang, own in texts.items():
        yield lang, b"\n".join(own).translate(SIGNS).replace(b"\n", b" \n ").split(b" ")


def numbered(lang: str, words: list[bytes], numbers: Numbers) -> np.ndarray:
    """The words' numbers in a language, END at the ends of pieces. A language's numbers differ where its words' do."""
    found = numbers.of(words)
    found = found[found != NONE]
    own = np.full(1, xxhash.xxh3_64_intdigest(lang.encode(), seed=1), np.uint64)
    return np.where(found == END, END, mixed(found * np.uint64(0x9E3779B97F4A7C15) + own))


def pair_keys(found: np.ndarray) -> np.ndarray:
    """A number for each word and the one behind it; 0 where a piece ends between."""
    keys = mixed(found[:-1] * np.uint64(0x9E3779B97F4A7C15) + found[1:])
    return np.where((found[:-1] != END) & (found[1:] != END), keys, END)


def window_keys(windows: np.ndarray) -> np.ndarray:
    out = np.full(len(windows), 7, np.uint64)
    for column in windows.T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def summed(windows: np.ndarray, weights: np.ndarray):
    """Windows in order, equal ones once with their weights added up."""
    order = np.lexsort(windows.T[::-1])
    windows, weights = windows[order], weights[order]
    new = np.ones(len(windows), bool)
    new[1:] = (windows[1:] != windows[:-1]).any(axis=1)
    return windows[new], np.add.reduceat(weights, np.nonzero(new)[0]) if len(windows) else weights


class Transducer:
    """A weighted acyclic automaton: the last arc of a path from state `root` weighs how often the path's words occur.

    Arcs of state s are first[s] to first[s + 1], by label; equal states are kept once. State 0 has no arcs.
    """

    def __init__(self, first, label, weight, target, root: int):
        self.first, self.label, self.weight, self.target, self.root = first, label, weight, target, root

    @classmethod
    def built(cls, windows: np.ndarray, weights: np.ndarray, closed: bool = False) -> Transducer:
        """From windows in order, each once, padded with 0. An arc weighs what the windows through it weigh together; where
        every prefix asked for is a row of its own (closed), it weighs what that row does.

        Levels are made from the last to the first: the arcs that leave a prefix are next to each other, and prefixes whose
        arcs have the same labels, weights and targets become one state.
        """
        size, depth = windows.shape
        change = np.ones((size, depth), bool)
        if size:
            change[1:] = np.logical_or.accumulate(windows[1:] != windows[:-1], axis=1)
        below, states, arcs, count = None, [], [], 1
        for d in range(depth - 1, -1, -1):
            start = np.nonzero(change[:, d])[0]
            total = weights[start] if closed else np.add.reduceat(weights, start) if size else weights
            real = windows[start, d] != 0
            target = below[start] if below is not None else np.zeros(len(start), np.int64)
            label, total, target, start = windows[start, d][real], total[real], target[real], start[real]
            # The prefix that each arc leaves: the last row at which the columns before d change.
            parent = np.maximum.accumulate(np.where(change[:, d - 1], np.arange(size), 0)) if d else np.zeros(size, np.int64)
            owner, begin = np.unique(parent[start], return_index=True)
            length = np.diff(np.append(begin, len(start)))
            marks = [mixed(label * np.uint64(k) ^ mixed(total.astype(np.uint64) + np.uint64(k) * target.astype(np.uint64)))
                     for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            sign = np.stack([np.add.reduceat(m, begin) if len(begin) else m for m in marks] + [length.astype(np.uint64)])
            _, one, which = np.unique(sign, axis=1, return_index=True, return_inverse=True)
            which = which.ravel()
            below = np.zeros(size, np.int64)
            below[owner] = count + which
            # A state's arcs as they leave the first prefix that has it.
            pick = np.repeat(begin[one], length[one]) + _within(length[one])
            states.append(length[one])
            arcs.append((label[pick], total[pick], target[pick]))
            count += len(one)
        if size:
            # Rows between the first of a prefix and the next one have its state.
            root = int(below[0])
        first = np.concatenate([[0, 0], np.cumsum(np.concatenate(states))]).astype(np.int64)
        label, weight, target = (np.concatenate([a[k] for a in arcs]) for k in range(3))
        return cls(first, label, weight, target, root if size else 0)

    def windows(self, depth: int = LONGEST):
        """The windows and weights it was built from."""
        rows, weights = [], []
        path, state = np.zeros((1, 0), np.uint64), np.array([self.root])
        for d in range(depth):
            length = self.first[state + 1] - self.first[state]
            arc = np.repeat(self.first[state], length) + _within(length)
            path = np.concatenate([np.repeat(path, length, axis=0), self.label[arc][:, None]], axis=1)
            state = self.target[arc]
            through = np.zeros(len(self.first) - 1, np.int64)
            sums = np.concatenate([[0], np.cumsum(self.weight)])
            through[:] = sums[self.first[1:]] - sums[self.first[:-1]]
            ends = self.weight[arc] - through[state]
            here = ends > 0
            rows.append(np.concatenate([path[here], np.zeros((here.sum(), depth - d - 1), np.uint64)], axis=1))
            weights.append(ends[here])
        return np.concatenate(rows), np.concatenate(weights)

    def prefixes(self, least: int, from_: int = 2, depth: int = LONGEST):
        """(words, weight) of every path of from_ arcs or more that weighs `least` or more; others are not followed."""
        path, state = np.zeros((1, 0), np.uint64), np.array([self.root])
        for d in range(depth):
            length = self.first[state + 1] - self.first[state]
            arc = np.repeat(self.first[state], length) + _within(length)
            path = np.concatenate([np.repeat(path, length, axis=0), self.label[arc][:, None]], axis=1)
            stay = self.weight[arc] >= least
            path, arc = path[stay], arc[stay]
            state = self.target[arc]
            if d + 1 >= from_:
                yield path, self.weight[arc]

    def composed(self, asked: np.ndarray) -> np.ndarray:
        """The weight of each path asked for (rows padded with 0); 0 where it has none."""
        state, out, alive = np.full(len(asked), self.root), np.zeros(len(asked), np.int64), np.ones(len(asked), bool)
        for column in asked.T:
            go = np.nonzero(alive & (column != 0))[0]
            low, high = self.first[state[go]], self.first[state[go] + 1]
            ends = high
            while (low < high).any():
                middle = (low + high) // 2
                less = (low < high) & (self.label[np.minimum(middle, len(self.label) - 1)] < column[go])
                high = np.where(less | (low >= high), high, middle)
                low = np.where(less, middle + 1, low)
            at = np.minimum(low, max(0, len(self.label) - 1))
            hit = (low < ends) & (self.label[at] == column[go]) if len(self.label) else np.zeros(len(go), bool)
            alive[go], out[go] = hit, np.where(hit, self.weight[at] if len(self.label) else 0, 0)
            state[go[hit]] = self.target[at[hit]]
        return np.where(alive, out, 0)

    def packed(self) -> bytes:
        sizes = np.array([len(self.first), len(self.label), self.root], np.int64)
        parts = [sizes, self.first, self.label, self.weight.astype(np.int64), self.target.astype(np.int64)]
        return zlib.compress(b"".join(p.tobytes() for p in parts), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Transducer:
        data = zlib.decompress(data)
        states, arcs, root = np.frombuffer(data, np.int64, 3)
        numbers = np.frombuffer(data, np.int64, offset=24)
        first, rest = numbers[:states], numbers[states:]
        return cls(first, rest[:arcs].view(np.uint64), rest[arcs:2 * arcs], rest[2 * arcs:], int(root))


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2 … for each length in turn."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def frequent(docs: DataFrame, least: int):
    """(words, pairs): words (lang, word, h, n) with all counts, and pairs (p, n) of neighbours that may occur `least` times.

    Numbers of two pairs can be equal, so a pair's n is at least its count. One scan of the texts and one shuffle.
    """

    def counted(batches):
        import pyarrow as pa

        numbers, words, pairs, held = Numbers(), {}, [], 0

        def word_rows(lang, own):
            keys = [w for w in own if w and w != b"\n"]
            h = numbered(lang, keys, numbers)
            return rows([lang] * len(keys), keys, h, [own[w] for w in keys])

        def rows(langs, keys, h, n):
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.binary()),
                                               pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["lang", "w", "h", "n"])

        def pair_rows():
            keys, n = np.unique(np.concatenate(pairs), return_counts=True)
            for first in range(0, len(keys), 500_000):
                part = keys[first:first + 500_000]
                yield rows([None] * len(part), [None] * len(part), part, n[first:first + 500_000])

        for batch in slices(batches):
            for lang, own in by_lang(batch):
                counts = words.setdefault(lang, Counter())
                counts.update(own)
                found = pair_keys(numbered(lang, own, numbers))
                pairs.append(found[found != END])
                held += len(pairs[-1])
            if sum(map(len, words.values())) > HELD_WORDS:
                yield from (word_rows(*x) for x in words.items())
                words = {}
            if held > HELD_PAIRS:
                yield from pair_rows()
                pairs, held = [], 0
        yield from (word_rows(*x) for x in words.items())
        if pairs:
            yield from pair_rows()

    parts = docs.mapInArrow(counted, "lang string, w binary, h long, n long")
    sums = parts.groupBy("lang", "w", "h").agg(F.sum("n").alias("n")).where(F.col("lang").isNotNull() | (F.col("n") >= least))
    sums = stored(sums, "collocation-counts")
    return (sums.where("lang is not null").select("lang", F.col("w").cast("string").alias("word"), "h", "n"),
            sums.where("lang is null").select(F.col("h").alias("p"), "n"))


def pair_map(pairs: DataFrame) -> np.ndarray:
    """A map of bits, set where a frequent pair's number (modulo the map's size) occurs."""
    bits = min(MOST_BITS, 1 << max(10, math.ceil(math.log2(16 * max(1, pairs.count())))))
    place = F.col("p").bitwiseAND(F.lit(bits - 1))
    cells = pairs.select(F.shiftright(place, 5).alias("cell"), F.expr("shiftleft(1L, cast(p & 31 as int))").alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("mask")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[found.column("cell").to_numpy()] = found.column("mask").to_numpy().astype(np.uint32)
    return out


def windows_of(found: np.ndarray, bitmap: np.ndarray, longest: int) -> np.ndarray:
    """The longest window from each word whose pair with the next is in the map: on while pairs are, padded with 0."""
    keys = pair_keys(found)
    low = keys & np.uint64(len(bitmap) * 32 - 1)
    good = (keys != END) & ((bitmap[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1)
    start = np.nonzero(good)[0]
    out = np.zeros((len(start), longest), np.uint64)
    out[:, 0], out[:, 1] = found[start], found[start + 1]
    good, on = np.concatenate([good, np.zeros(longest, bool)]), np.ones(len(start), bool)
    for k in range(2, longest):
        on &= good[start + k - 1]
        out[on, k] = found[start[on] + k]
    return out


def phrases(docs: DataFrame, pairs: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, words, a): phrases of 2 to `longest` words (as numbers) that occur at least `least` times, with their count.

    Every task builds transducers of the windows in its texts, one per prefix range and language; a range's are united and
    its rare paths left out. A pair commoner than a range should hold is dealt to ranges by whole windows; paths that
    start with it are summed over ranges before rare ones are left out.
    """
    spark, bitmap = docs.sparkSession, pair_map(pairs)
    total = pairs.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, math.ceil(total / RANGE_WINDOWS))
    # 100,000 pairs at most have over a 100,000th of all.
    often = pairs.where(F.col("n") > max(RANGE_WINDOWS, total // 100_000)).select("p").toArrow()
    heavy = np.sort(often.column("p").to_numpy().view(np.uint64))
    sent = spark.sparkContext.broadcast((bitmap, heavy))

    def shards(batches):
        import pyarrow as pa

        bitmap, heavy = sent.value
        numbers, new, held = Numbers(), {}, {}

        def add(lang):
            """Sums a language's new windows into those that the shard holds."""
            own = np.concatenate(new.pop(lang))
            before = held.get(lang, (np.zeros((0, longest), np.uint64), np.zeros(0, np.int64)))
            held[lang] = summed(np.concatenate([before[0], own]), np.concatenate([before[1], np.ones(len(own), np.int64)]))

        def rows(lang):
            windows, weights = held.pop(lang)
            pair = pair_keys(windows[:, :2].ravel())[::2]
            at = np.minimum(np.searchsorted(heavy, pair), max(0, len(heavy) - 1))
            wide = heavy[at] == pair if len(heavy) else np.zeros(len(pair), bool)
            unit = np.where(wide, window_keys(windows) % np.uint64(ranges) + np.uint64(ranges), pair % np.uint64(ranges))
            order = np.argsort(unit, kind="stable")
            units, begin = np.unique(unit[order], return_index=True)
            data = [Transducer.built(windows[part], weights[part]).packed() for part in np.split(order, begin[1:])]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(units)), pa.array(units.astype(np.int64)), pa.array(data, pa.binary())],
                                              ["lang", "unit", "data"])

        def count(kept):
            return sum(sum(map(len, x)) for x in new.values()) if kept is new else sum(len(x[0]) for x in held.values())

        for batch in slices(batches):
            for lang, own in by_lang(batch):
                new.setdefault(lang, []).append(windows_of(numbered(lang, own, numbers), bitmap, longest))
            if count(new) > HELD_WINDOWS:
                for lang in list(new):
                    add(lang)
                if count(held) > HELD_WINDOWS:
                    yield from (rows(lang) for lang in list(held))
        for lang in list(new):
            add(lang)
        yield from (rows(lang) for lang in list(held) if len(held[lang][0]))

    def united(rows):
        import pandas as pd

        lang, unit = rows["lang"].iloc[0], int(rows["unit"].iloc[0])
        parts = [Transducer.unpacked(bytes(d)).windows(longest) for d in rows["data"]]
        windows, weights = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        one = Transducer.built(windows, weights)
        found = [(p, n) for paths, sums in one.prefixes(least if unit < ranges else 1, 2, longest)
                 for p, n in zip(paths.view(np.int64).tolist(), sums.tolist())]
        return pd.DataFrame({"lang": pd.Series([lang] * len(found), dtype=object), "words": pd.Series([f[0] for f in found], dtype=object),
                             "a": pd.Series([f[1] for f in found], dtype="int64")})

    parts = docs.mapInArrow(shards, "lang string, unit long, data binary")
    paths = parts.groupBy("lang", "unit").applyInPandas(united, "lang string, words array<long>, a long")
    return stored(few(paths.groupBy("lang", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)), "collocation-phrases")


def prefix_units(table: DataFrame, parts: list[DataFrame], longest: int, most: int = RANGE_PHRASES) -> list[DataFrame]:
    """parts (lang, words …) with `unit`, the same for a phrase in all of them: a number of its first words.

    Two words decide, or one where there is no second; where over `most` phrases of table start alike, one more word does.
    """
    units = max(1, math.ceil(table.count() / most)) * 4

    def key(d):
        return F.xxhash64("lang", F.slice("words", 1, d))

    wide = {d: [r["k"] for r in table.where(F.size("words") >= d).groupBy(key(d).alias("k")).count().where(F.col("count") > most).collect()]
            for d in range(2, longest)}  # fewer keys than phrases / most
    chosen = key(longest)
    for d in range(longest - 1, 1, -1):
        chosen = F.when(key(d).isin(wide[d]) & (F.size("words") > d), chosen).otherwise(key(d)) if wide[d] else key(d)
    return [p.withColumn("unit", F.pmod(chosen, F.lit(units))) for p in parts]


def weights_of(table: DataFrame, asked: DataFrame, longest: int) -> DataFrame:
    """asked (lang, words) with f, how often the phrase occurs by table (lang, words, a).

    A range's phrases become a transducer, and the paths asked for are composed with it.
    """
    table, asked = prefix_units(table, [table, asked], longest)

    def answered(own, wanted):
        import pandas as pd

        out = []
        for lang, part in wanted.groupby("lang"):
            rows = own[own["lang"] == lang]
            paths, weights = padded(rows["words"], longest), rows["a"].to_numpy()
            order = np.lexsort(paths.T[::-1])
            one = Transducer.built(paths[order], weights[order], closed=True)
            out.append(part[["lang", "words"]].assign(f=one.composed(padded(part["words"], longest))))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (
            ("lang", object), ("words", object), ("f", "int64"))})

    return table.groupBy("unit").cogroup(asked.groupBy("unit")).applyInPandas(answered, "lang string, words array<long>, f long")


def padded(words, longest: int) -> np.ndarray:
    out = np.zeros((len(words), longest), np.uint64)
    for k, w in enumerate(words):
        out[k, :len(w)] = np.asarray(w, np.int64).view(np.uint64)
    return out


def scored(table: DataFrame, words: DataFrame, totals: DataFrame, longest: int) -> DataFrame:
    """(lang, words, a, l, r, n, score) of every phrase of two words or more at its lowest-scoring cut, the first of several.

    Counts are exact as decimals of 38 digits: 1000 * a * n stays below that while a and n are below 10 ** 17.
    """
    known = table.union(words.select("lang", F.array("h").alias("words"), F.col("n").alias("a")))
    cuts = table.select("lang", F.col("words").alias("phrase"), "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = stored(few(cuts.withColumn("left", F.slice("phrase", F.lit(1), F.col("k"))).withColumn(
        "right", F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")))), "collocation-cuts")
    sides = cuts.select("lang", F.explode(F.array("left", "right")).alias("words"))
    often = sides.groupBy("lang", "words").agg(F.count("*").alias("often"))
    parts = stored(few(weights_of(known, often.select("lang", "words"), longest).join(often, ["lang", "words"])), "collocation-parts")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = hot_join(cuts, parts.select("lang", F.col("words").alias(side), F.col("f").alias(name), "often"), ["lang", side], "often")
    score = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) "
                   "div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "n", "a")).alias("b"))
    return best.select("lang", F.col("phrase").alias("words"), "b.a", "b.l", "b.r", "b.n", "b.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int | None = TOP, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best `top` phrases of docs (text, lang), or all of them.

    A-Z are lower-cased; texts are cut into pieces at . , ; : ! ? and line ends (0A to 0D), these into words at spaces and
    tabs. A phrase is 2 to `longest` words of a piece that occur at least `least` times in it, overlaps included. n counts
    all words of the language; cutting a phrase in two that occur l and r times scores floor(1000 a n / (l r)), and the
    lowest cut counts. Phrases inside a longer one that occurs as often are left out: comparing with phrases one word
    longer is enough, since counts never grow with length. Ordered by score, a, then the phrase's bytes.

    A null lang is `und`, a null or empty text has no words, other columns are not read, repeated rows count as often as
    they occur, no words give no rows. Words are told apart by 64-bit numbers; equal ones of two words raise an error.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").cast("binary").alias("text"))
    words, pairs = frequent(docs, least)
    if not words.groupBy("h").count().where("count > 1").isEmpty():
        raise ValueError("two words have one number")
    table = phrases(docs, pairs, least, longest)
    totals = stored(few(words.groupBy("lang").agg(F.sum("n").alias("n"))), "collocation-totals")
    words = stored(few(words.where(F.col("n") >= least)), "collocation-words")
    longer = table.where("size(words) > 2").select("lang", F.explode(F.array(
        F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"), "a")
    longer = longer.groupBy("lang", "words").agg(F.max("a").alias("most"))
    kept = scored(table, words, totals, longest).join(longer, ["lang", "words"], "left").where("most is null or most < a")
    kept = stored(few(kept.drop("most")), "collocation-kept")
    apart = kept.select("lang", F.col("words").alias("key"), F.posexplode("words").alias("pos", "h"))
    often = apart.groupBy("lang", "h").agg(F.count("*").alias("often"))
    spelt = hot_join(apart, often.join(words.select("lang", "h", "word"), ["lang", "h"]), ["lang", "h"], "often")
    text = spelt.groupBy("lang", "key").agg(F.concat_ws(" ", F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])).alias("phrase"))
    rows = kept.join(text.withColumnRenamed("key", "words"), ["lang", "words"]).drop("words")
    return ranked(rows, top)


def ranked(rows: DataFrame, top: int | None) -> DataFrame:
    """rows with rank by lang. With `top`, parts of a language keep as many each, then parts of what is left, until a task
    that ranks a language has at most 50 times as many rows."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        rows = stored(few(rows), "collocation-rows")
        parts = math.ceil(rows.count() / (50 * top))
        while parts > 1:
            part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
            rows = stored(few(rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank")), "collocation-rows")
            parts = math.ceil(parts / 50)
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return (out if top is None else out.where(F.col("rank") <= top)).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
