"""Benchmark decontamination by multi-pattern search over words, with block shift tables (Wu and Manber)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargofile.llm.common import alphanumeric_table, few, hot_join, slices, stored

WORDS = 10
# Windows and bytes of windows that a task searches for at a time.
SHARD_ROWS = 100_000
SHARD_BYTES = 32_000_000
# Sets of owners that meet one copy of an owner's items.
SALT_ROWS = 1_000
TABLE = alphanumeric_table()


def words(text: str) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and any other code points from U+0080 on."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


class Patterns:
    """Shift tables, suffix buckets and test strings of (words joined by a blank, owner) pairs; one set for each length."""

    def __init__(self, pairs: list[tuple[bytes, str]]):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for window, item in pairs:
            key = tuple(self.ids.setdefault(w, len(self.ids)) for w in window.split())
            found.setdefault(key, set()).add(item)
        self.base = len(self.ids) + 1
        self.sets = []
        for size in sorted({len(k) for k in found}):
            block = min(2, size)
            shift: dict[int, int] = {}
            tests: dict[int, dict[int, list[tuple[list[int], set[str]]]]] = {}
            for key, items in found.items():
                if len(key) != size:
                    continue
                for at in range(block, size + 1):
                    code = self.code(key, at, block)
                    shift[code] = min(shift.get(code, size), size - at)
                tests.setdefault(self.code(key, size, block), {}).setdefault(key[0], []).append((list(key), items))
            self.sets.append((size, block, shift, tests))

    def code(self, key, end: int, block: int) -> int:
        return key[end - 1] if block == 1 else key[end - 2] * self.base + key[end - 1]

    def search(self, text: list[bytes], hit: bytearray, items: set[str]) -> None:
        """Marks the words inside any occurrence in hit and adds the items."""
        ids = list(map(self.ids.get, text))
        for size, block, shift, tests in self.sets:
            last, far, base = size - 1, size - block + 1, self.base
            while last < len(ids):
                now = ids[last]
                if now is None:
                    last += size
                    continue
                if block == 2:
                    before = ids[last - 1]
                    if before is None:
                        last += size - 1
                        continue
                    now += before * base
                step = shift.get(now, far)
                if step:
                    last += step
                    continue
                first = last - size + 1
                for key, owners in tests[now].get(ids[first], ()):
                    if ids[first:last + 1] == key:
                        hit[first:last + 1] = b"\x01" * size
                        items |= owners
                last += 1


def windows(benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """Distinct (window, item_id): every `size` consecutive words of an item, or all words of a shorter one."""

    def cut_up(batches):
        import pandas as pd

        for batch in batches:
            rows = set()
            for item, text in zip(batch["item_id"], batch["text"]):
                own = words(text)
                rows |= {(b" ".join(own[k:k + size]), item) for k in range(max(1, len(own) - size + 1)) if own}
            yield pd.DataFrame(sorted(rows), columns=["window", "item_id"])

    return benchmark.where("text is not null and item_id is not null").select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInPandas(
            cut_up, "window binary, item_id string").distinct()


def owned(pairs: DataFrame) -> DataFrame:
    """(window, owner, often): windows that lie in the same items have one owner, a digest of those items; often items."""
    of = [F.sum(F.xxhash64(F.lit(k), "item_id").cast("decimal(38,0)")).cast("string") for k in (1, 2)]
    owners = pairs.groupBy("window").agg(F.count("*").alias("often"), F.concat_ws(":", *of).alias("of"))
    return owners.select("window", F.md5(F.concat_ws(":", F.col("often").cast("string"), "of")).alias("owner"), "often")


def searched(rows: DataFrame, tests: list[tuple[bytes, str]], keep: list[str]) -> tuple[DataFrame, object]:
    """The columns `keep` of rows with n_words, _spans (hit words) and _owners of a whole text, and the broadcast of tests."""
    sent = rows.sparkSession.sparkContext.broadcast(tests)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([rows.schema[c] for c in keep] + [
        T.StructField("n_words", T.LongType()), T.StructField("_spans", T.ArrayType(span)),
        T.StructField("_owners", T.ArrayType(T.StringType()))])

    def search(batches):
        import pyarrow as pa

        table = Patterns(sent.value)
        kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]
        for batch in slices(batches):
            out = ([], [], [])
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                own, owners = words(text) if text is not None else [], set()
                hit = bytearray(len(own))
                table.search(own, hit, owners)
                spans, end = [], 0
                while (start := hit.find(1, end)) >= 0:
                    end = hit.find(0, start)
                    end = len(hit) if end < 0 else end
                    spans.append({"start": start, "end": end})
                for column, value in zip(out, (len(own), spans, sorted(owners))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(x, k) for x, k in zip(out, kinds)],
                names=schema.names)

    return rows.mapInArrow(search, schema), sent


def covered(spans: Column) -> Column:
    """The number of places in any of the spans, which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(spans), start, lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"),
        F.greatest(a["end"], x["end"]).alias("end")), lambda a: a["n"])


def hit_words(docs: DataFrame, tests: DataFrame, keep: list[str], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """_row (the columns `keep` of docs), n_words, n_hit and _owners, a comma-joined list, from every window's occurrences.

    The distinct windows of tests (window, owner), without their items, are cut into shards of about shard_rows windows
    and SHARD_BYTES. One shard at a time passes through the driver and is searched for in all documents; its broadcast
    goes before the next one comes. With a single shard documents stay where they are; with several they are stored once
    under a row number, by which what the passes found is put together.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"))
    size = tests.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("window")), F.lit(0)).alias("bytes")).first()
    shards = max(1, math.ceil(size["n"] / shard_rows), math.ceil(size["bytes"] / SHARD_BYTES))

    def shard(k: int) -> list[tuple[bytes, str]]:
        own = tests.where(F.pmod(F.xxhash64("window"), F.lit(shards)) == k).select("window", "owner")
        return [(bytes(r["window"]), r["owner"]) for r in own.toLocalIterator()]

    if shards == 1:
        found, _ = searched(rows, shard(0), ["_row"])
    else:
        rows, parts = stored(rows.withColumn("_nr", F.monotonically_increasing_id()), "numbered"), []
        for k in range(shards):
            part, sent = searched(rows.select("_nr", "text"), shard(k), ["_nr"])
            parts.append(stored(few(part if k == 0 else part.where(F.size("_owners") > 0)), "hits"))
            sent.unpersist()
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        # A document is in each part once at most, so its lists are bounded by its own words.
        found = rows.select("_nr", "_row").join(every.groupBy("_nr").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("_spans")).alias("_spans"),
            F.flatten(F.collect_list("_owners")).alias("_owners")), "_nr")
    return found.select("_row", "n_words", covered(F.col("_spans")).alias("n_hit"),
                        F.array_join(F.array_sort(F.array_distinct("_owners")), ",").alias("_owners"))


def item_lists(asked: DataFrame, pairs: DataFrame, tests: DataFrame) -> DataFrame:
    """(_owners, n_items, items_sha256) for each distinct list of owners in asked (_owners).

    An owner that many lists name meets them in as many tasks as SALT_ROWS asks for, each with a copy of its items. The
    items of one list are put together in one task, as its digest covers them all.
    """
    first = tests.groupBy("owner", "often").agg(F.min("window").alias("window"))
    items = hot_join(pairs, first, ["window"], "often").select("owner", "item_id")
    apart = asked.where("_owners != ''").select("_owners", F.explode(F.split("_owners", ",")).alias("owner"))
    salts = apart.groupBy("owner").agg(F.count("*").alias("often"), F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("_n"))
    left = hot_join(apart, salts, ["owner"], "often").withColumn(
        "_salt", F.pmod(F.xxhash64("_owners"), F.col("_n")).cast("int")).drop("_n")
    right = hot_join(items, first.select("owner", "often").join(salts.drop("often"), "owner", "left"), ["owner"], "often").where(
        "_n is not null").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    lists = left.join(right, ["owner", "_salt"]).groupBy("_owners").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return lists.select("_owners", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))


RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def kept_columns(docs: DataFrame, keep: list[str] | None) -> list[str]:
    return [c for c in docs.columns if c not in RESULTS and (keep is None or c in keep)]


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WORDS, shard_rows: int = SHARD_ROWS,
                 keep: list[str] | None = None) -> DataFrame:
    """docs (its columns in `keep`, else all) with n_words, n_hit and contaminated: occurrences() without the items."""
    tests = stored(few(owned(windows(benchmark, size))), "windows")
    own = kept_columns(docs, keep)
    return hit_words(docs, tests, own, shard_rows).select(
        *[F.col("_row")[c].alias(c) for c in own], "n_words", "n_hit", (F.col("n_hit") > 0).alias("contaminated"))


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = WORDS, shard_rows: int = SHARD_ROWS,
                keep: list[str] | None = None) -> DataFrame:
    """docs (its columns in `keep`, else all) with n_words, n_hit, n_items, items_sha256 and contaminated, from every window's occurrences in whole texts.

    Windows go to tasks in shards of bounded size (see hit_words), items never do: they are joined to the distinct lists
    of owners that documents turn out to have. The kept columns are stored once with what was found. A null text has no
    words; an item without words, text or id has no window; repeated rows are judged each; an empty benchmark hits
    nothing; the other columns of docs pass through, columns named like a result are replaced.
    """
    pairs = stored(few(windows(benchmark, size)), "pairs")
    tests = stored(few(owned(pairs)), "windows")
    own = kept_columns(docs, keep)
    rows = stored(hit_words(docs, tests, own, shard_rows), "hits")
    asked = stored(few(rows.groupBy("_owners").agg(F.count("*").alias("often"))), "owners")
    lists = asked.join(item_lists(asked.select("_owners"), pairs, tests), "_owners", "left").select(
        "_owners", "often", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return hot_join(rows, stored(few(lists), "lists"), ["_owners"], "often").select(
        *[F.col("_row")[c].alias(c) for c in own], "n_words", "n_hit", "n_items", "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"))
