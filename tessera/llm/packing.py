"""Filling containers of fixed capacity (problem 9).

Sizes are whole numbers up to the capacity, so a packing is decided on the *histogram* of sizes, which has
at most ``capacity`` rows whatever the number of items: it is the only thing the driver sees. There,
Martello and Toth's reduction fixes sets of up to three items that dominate every other set holding their
largest item; best-fit decreasing places the rest, whole runs of equal sizes and equal gaps at a time.
Both look at a size's count only as none, few or many, and handle many at once, so the steps taken and the
intervals made depend on the number of sizes and not on how many items there are. The result are intervals
("items number a to b of size s go to bins from n on, m each", some four per size at most), which are
broadcast and looked up by an item's number within its size. A size that holds a third of all items is
numbered in salted parts.

Only an item above the capacity is split: it fills bins of its own, and its remainder is an item as
others. Items of size 0 lie in bin 0 (they need no room). Defined results: a null or empty text has size
0; a null id is an item as others; an empty table gives no rows; every item is placed.
"""

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.bpe import TOKENIZERS, vocabulary
from tessera.session import cut

SALTS = 256
#: Copies of a size that a set fixed many times at once leaves, so that every copy fixed had the same alternatives.
SPARE = 4
PYTHON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Interval = tuple[int, int, int, int, int]


def token_count(text: Column, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> Column:
    """Tokens of the public tokenizer; 0 for null and empty. The vocabulary (1 MB) travels with the tasks."""
    ranks = SparkSession.active().sparkContext.broadcast(vocabulary(path))

    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        e = tiktoken.Encoding("own", pat_str=PYTHON_PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        for s in parts:
            yield s.map(lambda x: len(e.encode_ordinary(x)) if x else 0)

    return F.pandas_udf(count, "int")(text)


class Plan:
    """Intervals ``(size, from, to, first bin, items a bin)`` for a histogram of sizes."""

    def __init__(self, sizes: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {s: n for s, n in sizes.items() if s > 0 and n > 0}
        self.order = sorted(self.left)
        self.taken: dict[int, int] = {}
        self.last: dict[int, int] = {}
        self.bins, self.steps, self.intervals = 0, 0, []
        self.fixed = self._reduce()
        self._fit()
        if sizes.get(0):
            self.intervals.append((0, 0, sizes[0], 0, sizes[0]))
            self.bins = max(1, self.bins)

    def _take(self, size: int, each: int, base: int, bins: int) -> None:
        start = self.taken.get(size, 0)
        self.taken[size] = start + each * bins
        before = self.intervals[self.last[size]] if size in self.last else None
        if before and before[4] == each and before[3] + (before[2] - before[1]) // each == base:
            self.intervals[self.last[size]] = (size, before[1], start + each * bins, before[3], each)
        else:
            self.last[size] = len(self.intervals)
            self.intervals.append((size, start, start + each * bins, base, each))
        self.left[size] -= each * bins
        if not self.left[size]:
            del self.left[size]
            self.order.pop(bisect_left(self.order, size))

    def _open(self, members: list[int], times: int) -> int:
        base = self.bins
        self.bins += times
        for s in dict.fromkeys(members):
            self._take(s, members.count(s), base, times)
        return base

    def _smallest(self, besides: int, k: int) -> list[int]:
        out: list[int] = []
        for s in self.order:
            out += [s] * min(k - len(out), self.left[s] - (s == besides))
            if len(out) >= k:
                break
        return out

    def _largest_up_to(self, room: int, besides: int) -> int:
        i = bisect_right(self.order, room) - 1
        while i >= 0 and self.left[self.order[i]] - (self.order[i] == besides) <= 0:
            i -= 1
        return self.order[i] if i >= 0 else 0

    def _best_pair(self, room: int, w: int) -> tuple[int, int]:
        lo, hi, best, pair = 0, bisect_right(self.order, room) - 1, 0, (0, 0)
        have = lambda s: self.left[s] - (s == w)
        while lo <= hi:
            a, b = self.order[hi], self.order[lo]
            if a + b > room:
                hi -= 1
                continue
            if have(a) > 0 and have(b) > (a == b) and a + b > best:
                best, pair = a + b, (a, b)
            lo += 1
        return pair

    def _dominant(self, w: int) -> tuple[list[int], int] | None:
        """The set that dominates all others with an item of size ``w``, and how many times it may be fixed at once."""
        room, n = self.capacity - w, self.left[w]
        small = self._smallest(w, 3)
        k = next((i for i in range(len(small)) if sum(small[: i + 1]) > room), len(small))
        if k == 0:
            return [w], n
        top = self._largest_up_to(room, w)
        pairs = n // 2 if top == w else min(n, self.left[top])
        if k == 1 or top == room:
            return [w, top], pairs
        if k != 2:
            return None
        a, b = self._best_pair(room, w)
        if top >= a + b:
            return [w, top], pairs
        if a != top:
            return None
        if a == b:
            return [w, a, b], n // 3 if a == w else min(n, self.left[a] // 2)
        i, j = bisect_left(self.order, a), bisect_left(self.order, b)
        between = sum(self.left[s] - (s == w) for s in self.order[j + 1 : i]) + self.left[a] - (a == w) - 1
        before: list[int] = []
        for s in self.order[j + 1 :]:
            before += [s] * min(2, self.left[s] - (s == w))
            if len(before) >= 2:
                break
        if between <= 1 or w + sum(before[:2]) > self.capacity:
            if w in (a, b):
                return [w, a, b], max(1, min((self.left[x] - SPARE) // [w, a, b].count(x) for x in {w, a, b}))
            return [w, a, b], max(1, min(n, self.left[a] - 2, self.left[b]))
        return None

    def _reduce(self) -> int:
        i = len(self.order) - 1
        while i >= 0:
            w = self.order[i]
            while w in self.left and (found := self._dominant(w)):
                self.steps += 1
                self._open(*found)
            i = bisect_left(self.order, w) - 1
        return self.bins

    def _fit(self) -> None:
        """Best-fit decreasing: a size goes to the bins with the least gap it fits in, which it fills as far as it can."""
        gaps: list[int] = []
        runs: dict[int, list[tuple[int, int]]] = {}

        def keep(gap: int, base: int, bins: int) -> None:
            if bins and gap:
                if gap not in runs:
                    insort(gaps, gap)
                    runs[gap] = []
                runs[gap].append((base, bins))

        for s in sorted(self.left, reverse=True):
            while (count := self.left.get(s, 0)) > 0:
                self.steps += 1
                i = bisect_left(gaps, s)
                if i < len(gaps):
                    gap = gaps[i]
                    base, bins = runs[gap].pop()
                    if not runs[gap]:
                        del runs[gap]
                        gaps.pop(i)
                else:
                    gap, base, bins = self.capacity, self.bins, -(-count // (self.capacity // s))
                    self.bins += bins
                each = gap // s
                full = min(bins, count // each)
                if full:
                    self._take(s, each, base, full)
                    keep(gap - each * s, base, full)
                    base, bins, count = base + full, bins - full, count - full * each
                if bins and 0 < count < each:
                    self._take(s, count, base, 1)
                    keep(gap - count * s, base, 1)
                    base, bins = base + 1, bins - 1
                keep(gap, base, bins)


def pack(items: DataFrame, containers: DataFrame) -> DataFrame:
    """``container_id, bin, item, part, size`` for every item (``item, size``) in every container (``container_id, capacity``).

    ``containers`` is a short list. ``bin`` is ``b<n>`` for a shared bin and ``<item>/<part>`` for one filled by a
    single item above the capacity.
    """
    spark = items.sparkSession
    items = cut(items.select("item", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size")), "sizes")
    kinds = [(r[0], r[1]) for r in containers.select("container_id", F.col("capacity").cast("long")).where("capacity > 0").collect()]
    if not kinds:
        return spark.createDataFrame([], "container_id int, bin string, item bigint, part bigint, size bigint")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("container_id"), F.lit(c).alias("capacity")) for i, c in kinds]))
    spread = items.select("item", "size", each.alias("c")).select("item", F.col("size").alias("whole"), "c.*")
    full = F.when(F.col("whole") > F.col("capacity"), F.floor(F.col("whole") / F.col("capacity"))).otherwise(0)
    rest = spread.withColumn("full", full).withColumn("size", F.col("whole") - F.col("full") * F.col("capacity"))
    shared = rest.where("size > 0 or full = 0")

    parts = shared.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    counted = parts.groupBy("container_id", "size", "salt").agg(F.count("*").alias("n"))
    intervals: list[tuple[int, int, int, int, int, int]] = []
    histogram: dict[int, dict[int, int]] = {}
    # At most capacity + 1 rows a container.
    for r in counted.groupBy("container_id", "size").agg(F.sum("n").alias("n")).toLocalIterator():
        histogram.setdefault(r[0], {})[r[1]] = r[2]
    for i, c in kinds:
        intervals += [(i, *x) for x in Plan(histogram.get(i, {}), c).intervals]
    names = "container_id int, size bigint, low bigint, high bigint, base bigint, each bigint"
    plan = spark.createDataFrame(pd.DataFrame(intervals, columns=[c.split()[0] for c in names.split(", ")]).astype({"container_id": "int32"}) if intervals else [], names)
    # Bounded by the number of sizes: the join sends no item anywhere, however many have one size.
    places = F.broadcast(plan.groupBy("container_id", "size").agg(F.array_sort(F.collect_list(F.struct("low", "high", "base", "each"))).alias("places")))

    line = W.partitionBy("container_id", "size", "salt")
    offsets = counted.withColumn("offset", F.sum("n").over(W.partitionBy("container_id", "size").orderBy("salt")) - F.col("n")).drop("n")
    numbered = (
        parts.withColumn("number", F.row_number().over(line.orderBy("item")) - 1)
        .join(offsets, ["container_id", "size", "salt"])
        .withColumn("number", F.col("number") + F.col("offset"))
    )
    bin_ = F.concat(F.lit("b"), (F.col("p.base") + F.floor((F.col("number") - F.col("p.low")) / F.col("p.each"))).cast("string"))
    placed = (
        numbered.join(places, ["container_id", "size"])
        .withColumn("p", F.explode(F.filter("places", lambda x: (F.col("number") >= x["low"]) & (F.col("number") < x["high"]))))
        .select("container_id", bin_.alias("bin"), "item", F.col("full").cast("long").alias("part"), "size")
    )
    alone = rest.where("full > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("full") - 1))).select(
        "container_id", F.concat_ws("/", F.coalesce(F.col("item").cast("string"), F.lit("null")), F.col("part").cast("string")).alias("bin"), "item", F.col("part").cast("long").alias("part"), F.col("capacity").alias("size")
    )
    return placed.unionByName(alone)


def invariants(packed: DataFrame, items: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container: items placed, items whose parts do not add up to their size once, bins above the capacity, and
    items split although they fit. The last three must be 0. Items are told apart by ``item``."""
    whole = items.groupBy("item").agg(F.sum(F.coalesce(F.col("size").cast("long"), F.lit(0))).alias("whole"))
    parts = packed.groupBy("container_id", "item").agg(F.sum("size").alias("size"), F.count("*").alias("parts"))
    told = parts.join(whole, parts["item"].eqNullSafe(whole["item"])).join(F.broadcast(containers), "container_id")
    per_item = told.groupBy("container_id").agg(F.count("*").alias("items"), F.count_if(F.col("size") != F.col("whole")).alias("unequal"), F.count_if((F.col("parts") > 1) & (F.col("whole") <= F.col("capacity"))).alias("split"))
    used = packed.groupBy("container_id", "bin").agg(F.sum("size").alias("used")).join(F.broadcast(containers), "container_id")
    over = used.groupBy("container_id").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"))
    return per_item.join(over, "container_id").select("container_id", "items", "unequal", "split", "overfull")


def summary(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container: bins, tokens, and the share of the bins' room that is used."""
    bins = packed.groupBy("container_id", "bin").agg(F.sum("size").alias("used"))
    return (
        bins.groupBy("container_id").agg(F.count("*").alias("bins"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
        .join(containers, "container_id")
        .select("container_id", "capacity", "bins", "tokens", "fullest", (F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("filled"))
    )
