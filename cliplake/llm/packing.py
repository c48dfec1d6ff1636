"""Items of varying length into containers of fixed capacity with as little unused space as possible.

Each group of items starts from best fit by falling size; then a local search moves, exchanges one for one,
two for one or one for two items between underfull containers, always from an emptier to a fuller one, so
the sum of squared fills grows and the emptiest containers run empty. Groups are hash groups of about
GROUP_ITEMS items, whatever the table's size; after each level, the items of containers that still have
more than SLACK of their space free are regrouped across groups and searched again.

Defined results: NULL and empty texts have no tokens and are in no container; an item beyond the capacity is
cut into full pieces and a rest, and only the rest is packed with others; repeated items are items of their
own; a window without a name or with a capacity that is NULL or not positive is left out. Every token of every document is in exactly one
container.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplake.llm.tokens import token_counts
from cliplake.session import written
from cliplake.sources.tables import table

GROUP_ITEMS, SLACK, LEAST_GAIN = 4096, 0.005, 1e-5
#: A level that closes a smaller share of its items than this is the last.
WORTH = 0.1
#: Containers come in few sizes: each is a factor of the items, so a longer table is refused.
MOST_WINDOWS = 1000


class _Pool:
    """Items by size with constant-time 'largest size up to x'."""

    def __init__(self) -> None:
        self.items: dict[int, list[int]] = {}
        self.mask = 0

    def add(self, size: int, item: int) -> None:
        self.items.setdefault(size, []).append(item)
        self.mask |= 1 << size

    def up_to(self, x: int) -> int:
        """The largest size not above x, 0 if there is none."""
        return (self.mask & ((1 << (x + 1)) - 1)).bit_length() - 1 if x > 0 and self.mask & ((1 << (x + 1)) - 1) else 0

    def take(self, size: int) -> int:
        held = self.items[size]
        item = held.pop()
        if not held:
            del self.items[size]
            self.mask &= ~(1 << size)
        return item


def _best_fit(order: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}
    mask = 0
    for i in order:
        s = sizes[i]
        above = mask >> s
        if above:
            room = s + (above & -above).bit_length() - 1
            held = free[room]
            b = held.pop()
            if not held:
                del free[room]
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > s:
            free.setdefault(room - s, []).append(b)
            mask |= 1 << (room - s)
    return bins


def _pairs(pool: _Pool) -> int:
    """The set of sums of two items of the pool, as bits."""
    found = 0
    for s, held in pool.items.items():
        found |= (pool.mask if len(held) > 1 else pool.mask & ~(1 << s)) << s
    return found


def _exchange(own: list[int], room: int, capacity: int, pool: _Pool) -> tuple[list[int], list[int]] | None:
    """(sizes that leave, sizes that come from the pool) of the exchange that gains most, None if none gains."""
    best, gain = None, 0
    for b in own:  # one for one
        if (g := pool.up_to(b + room) - b) > gain:
            best, gain = ([b], [b + g]), g
            if gain == room:
                return best
    pairs = _pairs(pool)
    for b in own:  # two for one
        under = pairs & ((1 << (b + room + 1)) - 1)
        if (g := under.bit_length() - 1 - b) > gain:
            s = next(s for s, held in pool.items.items() if s < b + g and pool.mask >> (b + g - s) & 1 and (2 * s != b + g or len(held) > 1))
            best, gain = ([b], [s, b + g - s]), g
            if gain == room:
                return best
    for n, b in enumerate(own):  # one for two
        for c in own[n + 1 :]:
            if (g := pool.up_to(min(b + c + room, capacity)) - b - c) > gain:
                best, gain = ([b, c], [b + c + g]), g
                if gain == room:
                    return best
    return best


def _search(sizes: list[int], capacity: int, bins: list[list[int]], fill: list[int]) -> None:
    """One pass: underfull containers, the fullest first, take from the emptiest eighth of them, which is then packed anew."""
    under = sorted((k for k in range(len(bins)) if bins[k] and fill[k] < capacity), key=lambda k: (fill[k], k))
    if len(under) < 2:
        return
    donors = under[: max(1, len(under) // 8)]
    pool, home = _Pool(), {}
    for d in donors:
        for i in bins[d]:
            pool.add(sizes[i], i)
            home[i] = d

    def shift(item: int, a: int, b: int) -> None:
        bins[a].remove(item)
        bins[b].append(item)
        fill[a] -= sizes[item]
        fill[b] += sizes[item]

    for k in reversed(under[len(donors) :]):
        while (room := capacity - fill[k]) and pool.mask:
            if s := pool.up_to(room):  # move
                i = pool.take(s)
                shift(i, home.pop(i), k)
                continue
            found = _exchange(sorted(sizes[i] for i in bins[k]), room, capacity, pool)
            if found is None:
                break
            leave, come = found
            taken = [pool.take(s) for s in come]
            goes: list[int] = []
            for s in leave:
                goes.append(next(i for i in bins[k] if sizes[i] == s and i not in goes))
            free = {d: capacity - fill[d] for d in donors}
            for i in taken:
                free[home[i]] += sizes[i]
            to = []  # what leaves goes to the donor in which it leaves least room
            for i in reversed(goes):
                near = [d for d in donors if free[d] >= sizes[i]]
                if not near:
                    break
                to.append((i, d := min(near, key=lambda d: (free[d], d))))
                free[d] -= sizes[i]
            if len(to) < len(goes):  # nothing has moved yet
                for i in taken:
                    pool.add(sizes[i], i)
                break
            for i in taken:
                shift(i, home.pop(i), k)
            for i, d in to:
                shift(i, k, d)
                home[i] = d
                pool.add(sizes[i], i)
    left = [i for d in donors for i in bins[d]]
    again = _best_fit(sorted(left, key=lambda i: (-sizes[i], i)), sizes, capacity)
    filled = [sum(sizes[i] for i in b) for b in again]
    score = lambda f: (-sum(1 for x in f if x), sum(x * x for x in f))
    if score(filled) > score([fill[d] for d in donors]):  # never more containers than the donors were
        for n, d in enumerate(donors):
            bins[d], fill[d] = (again[n], filled[n]) if n < len(again) else ([], 0)


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item; sizes are between 1 and capacity.

    Passes go on while they empty containers or raise the sum of squared fills by more than LEAST_GAIN of it.
    """
    bins = _best_fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sizes, capacity)
    fill = [sum(sizes[i] for i in b) for b in bins]
    used, squares = len(bins), sum(f * f for f in fill)
    while True:
        before, was = used, squares
        _search(sizes, capacity, bins, fill)
        used, squares = sum(1 for b in bins if b), sum(f * f for f in fill)
        if used >= before and squares <= was * (1 + LEAST_GAIN):
            break
    out = [-1] * len(sizes)
    for n, b in enumerate(b for b in bins if b):
        if sum(sizes[i] for i in b) > capacity:
            raise AssertionError("a container exceeds its capacity")
        for i in b:
            out[i] = n
    if -1 in out:
        raise AssertionError("an item is in no container")
    return out


_PACKED = "window_name string, capacity int, container_id string, doc_id bigint, piece int, n_tokens int, open boolean"


def _pack_level(items: DataFrame, level: int) -> DataFrame:
    """Packs each (window_name, grp)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        capacity = int(pdf["capacity"].iloc[0])
        where = pd.Series(pack(pdf["n_tokens"].tolist(), capacity))
        filled = pdf["n_tokens"].groupby(where).transform("sum")
        pdf["container_id"] = f"{level}." + pdf["grp"].astype(str) + "." + where.astype(str)
        pdf["open"] = filled < capacity * (1 - SLACK)
        return pdf[[c.split()[0] for c in _PACKED.split(", ")]]

    return items.groupBy("window_name", "grp").applyInPandas(run, _PACKED)


def _grouped(items: DataFrame, counts: dict[str, int]) -> DataFrame:
    pairs = [x for name, n in counts.items() for x in (F.lit(name), F.lit(-(-n // GROUP_ITEMS)))]
    groups = F.create_map(*pairs)[F.col("window_name")]
    return items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.lit(11)), groups).cast("int"))


def containers(sizes: DataFrame, windows: DataFrame) -> DataFrame:
    """sizes (doc_id, n_tokens) and windows (window_name, capacity_tokens) -> window_name, capacity, container_id, doc_id, piece, n_tokens.

    The windows are a small table (refused above MOST_WINDOWS rows) and go into the plan as an array; the
    number of items of a level is its only other figure on the driver. Levels go on while more than one group
    is open and the level before closed at least WORTH of its items.
    """
    wins = windows.where("window_name IS NOT NULL AND capacity_tokens > 0").select("window_name", F.col("capacity_tokens").cast("int").alias("capacity")).distinct()
    rows = wins.limit(MOST_WINDOWS + 1).collect()
    if len(rows) > MOST_WINDOWS:
        raise ValueError("the table of container sizes must stay small")
    names = ["window_name", "capacity", "container_id", "doc_id", "piece", "n_tokens"]
    known = [F.struct(F.lit(r.window_name).alias("window_name"), F.lit(r.capacity).alias("capacity")) for r in sorted(rows)]
    known = F.array(*known) if known else F.array().cast("array<struct<window_name:string,capacity:int>>")
    items = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(known).alias("w")).select("doc_id", "n_tokens", "w.*")
    full = F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("int")
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), full)))
    items = items.withColumn("n_tokens", F.least("capacity", F.col("n_tokens") - F.col("piece") * F.col("capacity")).cast("int"))
    items = items.select("window_name", "capacity", "doc_id", "piece", "n_tokens")
    whole = items.where("n_tokens = capacity").withColumn("container_id", F.concat_ws(".", F.lit("full"), "doc_id", "piece"))
    open_items = written(items.where("n_tokens < capacity"), "pack-items")
    counts = _counts(open_items)
    done, level = [whole], 0
    while counts:
        level += 1
        packed = written(_pack_level(_grouped(open_items, counts), level), "pack-level")
        still = packed.where("open").select("window_name", "capacity", "doc_id", "piece", "n_tokens")
        after = _counts(still) if max(counts.values()) > GROUP_ITEMS else {}
        if not after or sum(after.values()) > (1 - WORTH) * sum(counts.values()):
            done.append(packed)
            break
        done.append(packed.where("NOT open"))
        open_items, counts = still, after
    return reduce(DataFrame.unionByName, [d.select(names) for d in done])


def _counts(items: DataFrame) -> dict[str, int]:
    return {r[0]: r[1] for r in items.groupBy("window_name").count().collect()}


def p9_containers(spark, folder: str) -> DataFrame:
    """Every piece of every non-empty document in its container, for each context window."""
    sizes = written(token_counts(table(spark, folder, "documents")), "pack-sizes")
    return containers(sizes, table(spark, folder, "context_windows"))


def p9_fill(spark, folder: str) -> DataFrame:
    """Per window: containers used, tokens, and the least number of containers that any packing needs."""
    c = p9_containers(spark, folder)
    out = c.groupBy("window_name", "capacity").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return out.withColumn("least", F.ceil(F.col("n_tokens") / F.col("capacity")).cast("bigint")).withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))
