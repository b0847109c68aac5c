"""Documents into containers of a fixed number of tokens, with little unused space.

A text longer than the capacity is cut into full containers and a rest; no
other text is split.  Rests and whole texts are then packed:

1. linear grouping: the large items (over ``SMALL_SHARE`` of the capacity),
   sorted by size, are cut into groups of equal cardinality; a group's items
   count as its largest;
2. few-size configurations: with few sizes left, fillings of a container are
   optimised one after the other, each beginning with the largest size left
   and completed by a knapsack over the others, and used as often as the
   counts allow;
3. substitution: the documents take the places of their group by rank;
4. the small items go into what the documents really left, each into the
   fullest container that still takes it; further containers are opened where
   none does.

Only the histogram of sizes (at most the capacity's number of rows) reaches
the driver.  Ranks are counted in salted cells, so a size that very many
documents share does not meet in one task, and best fit works in shards of
bounded size.

Defined results: null and empty texts have no tokens and no container (one row
with a null container and 0 tokens each); containers of null or non-positive
capacity are left out; ties go by salt and id, so the result is deterministic.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GROUPS = 64
SMALL_SHARE = 0.0625
SALTS = 64
SHARD_CONTAINERS = 20_000
_GRID = 2048


def _fill(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size (ascending) to put into one container: the largest left, then the best completion."""
    chosen = np.zeros(len(sizes), dtype=np.int64)
    largest = int(np.flatnonzero(counts)[-1])
    chosen[largest] = 1
    unit = max(1.0, capacity / _GRID)
    room = int((capacity - sizes[largest]) // unit)
    left = counts.copy()
    left[largest] -= 1
    weight = np.ceil(sizes / unit).astype(np.int64)
    # reach[s]: the size by which grid sum s was reached last (-1: not reached); larger sizes first
    reach = np.full(room + 1, -1)
    reach[0] = len(sizes)
    for i in np.flatnonzero((left > 0) & (weight <= room))[::-1]:
        for _ in range(int(min(left[i], room // weight[i]))):
            fresh = np.flatnonzero((reach[: room + 1 - weight[i]] >= i) & (reach[weight[i] :] < 0)) + weight[i]
            if not len(fresh):
                break
            reach[fresh] = i
        if reach[room] >= 0:
            break
    at = int(np.flatnonzero(reach >= 0)[-1])
    while at > 0:
        i = reach[at]
        if left[i] <= 0:
            break
        chosen[i] += 1
        left[i] -= 1
        at -= weight[i]
    return chosen


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int, int]], int]:
    """(groups, places, number of containers) for the large sizes of a histogram.

    groups: (first rank, group size) from the largest item down; places:
    (group, first rank inside the group, one past the last, first container,
    items a container).
    """
    sizes = sorted((s for s in histogram), reverse=True)
    total = sum(histogram.values())
    if not total:
        return [], [], 0
    per_group = max(1, -(-total // groups))
    starts: list[tuple[int, int]] = []
    rank = 0
    for s in sizes:
        end = rank + histogram[s]
        while len(starts) * per_group < end:
            starts.append((len(starts) * per_group, s))
        rank = end
    counts = np.array([min(per_group, total - first) for first, _ in starts])[::-1].copy()
    group_sizes = np.array([s for _, s in starts])[::-1].copy()
    used = np.zeros(len(starts), dtype=np.int64)
    places, containers = [], 0
    while counts.any():
        chosen = _fill(group_sizes, counts, capacity)
        inside = np.flatnonzero(chosen)
        times = int((counts[inside] // chosen[inside]).min())
        for i in inside:
            g, n = len(starts) - 1 - int(i), int(chosen[i])
            places.append((g, int(used[i]), int(used[i]) + n * times, containers, n))
            used[i] += n * times
            counts[i] -= n * times
        containers += times
    return starts, places, containers


def best_fit(small: list[tuple[int, int]], rooms: list[tuple[int, str]], capacity: int, new_name) -> list[tuple[int, str]]:
    """(index of item, container) for small items (size, index), given (room, container) of open ones."""
    open_rooms = sorted(rooms)
    out, opened = [], 0
    for size, index in sorted(small, key=lambda x: (-x[0], x[1])):
        at = bisect_left(open_rooms, (size, ""))
        if at == len(open_rooms):
            room, name = capacity, new_name(opened)
            opened += 1
        else:
            room, name = open_rooms.pop(at)
        out.append((index, name))
        if room > size:
            insort(open_rooms, (room - size, name))
    return out


def pack(spark: SparkSession, items: DataFrame, containers: DataFrame, groups: int = GROUPS) -> DataFrame:
    """container_kind, doc_id, piece_no, token_from, tokens, container_id of every piece of every document.

    items: doc_id, tokens (a stored table: it is read several times).
    containers: container_kind, capacity_tokens, a short list.
    """
    kinds = {r["container_kind"]: r["capacity_tokens"] for r in containers.collect() if r["capacity_tokens"] and r["capacity_tokens"] > 0 and r["container_kind"] is not None}
    listed = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(int(c)).cast("long").alias("capacity")) for k, c in sorted(kinds.items())])
    out_columns = ["container_kind", "doc_id", "piece_no", "token_from", "tokens", "container_id"]
    if not kinds:
        return items.select(F.lit("").alias("container_kind"), "doc_id", *[F.lit(0).cast("long").alias(c) for c in out_columns[2:5]], F.lit("").alias("container_id")).filter("false")
    each = items.select("doc_id", F.col("tokens").cast("long").alias("size"), F.explode(listed).alias("k")).select("doc_id", "size", "k.*")
    each = each.withColumn("full", F.floor(F.col("size") / F.col("capacity")).cast("long"))
    each = each.withColumn("rest", F.col("size") - F.col("full") * F.col("capacity"))
    whole = (
        each.filter("full > 0")
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
        .select(
            "container_kind", "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("token_from"), F.col("capacity").alias("tokens"),
            F.concat_ws("/", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string")).alias("container_id"),
        )
    )
    none = each.filter("size = 0").select("container_kind", "doc_id", F.lit(0).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("token_from"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("string").alias("container_id"))
    loose = each.filter("rest > 0").select("container_kind", "capacity", "doc_id", F.col("full").alias("piece_no"), (F.col("full") * F.col("capacity")).alias("token_from"), F.col("rest").alias("tokens"))
    is_large = F.col("tokens") > F.col("capacity") * F.lit(SMALL_SHARE)

    # at most one row a size and kind: bounded by the capacities
    histogram = loose.groupBy("container_kind", "tokens").agg(F.count("*").alias("n")).collect()
    by_kind: dict[str, dict[int, int]] = {k: {} for k in kinds}
    n_small = {k: 0 for k in kinds}
    for r in histogram:
        if r["tokens"] > kinds[r["container_kind"]] * SMALL_SHARE:
            by_kind[r["container_kind"]][r["tokens"]] = r["n"]
        else:
            n_small[r["container_kind"]] += r["n"]
    plans, above, shards = {}, {}, {}
    for k, c in kinds.items():
        starts, places, n = plan(by_kind[k], c, groups)
        plans[k] = (np.array([s for s, _ in starts]), {g: sorted(p for p in places if p[0] == g) for g in range(len(starts))}, n)
        bigger, at = {}, 0
        for s in sorted(by_kind[k], reverse=True):
            bigger[s], at = at, at + by_kind[k][s]
        above[k] = bigger
        shards[k] = max(1, -(-max(n, n_small[k]) // SHARD_CONTAINERS))

    # rank of a large item: larger ones (known), earlier salts of its size (a short window), earlier ids of its salt
    salted = loose.filter(is_large).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    cells = salted.groupBy("container_kind", "tokens", "salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("container_kind", "tokens").orderBy("salt")
    offsets = cells.select("container_kind", "tokens", "salt", (F.sum("n").over(earlier) - F.col("n")).alias("before"))
    inside = Window.partitionBy("container_kind", "tokens", "salt").orderBy("doc_id", "piece_no")
    ranked = salted.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, ["container_kind", "tokens", "salt"])
    shared = spark.sparkContext.broadcast((plans, above))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_plan, bigger = shared.value
        for pdf in frames:
            number = np.zeros(len(pdf), dtype=np.int64)
            for kind, rows in pdf.groupby("container_kind").indices.items():
                firsts, places, _ = by_plan[kind]
                part = pdf.iloc[rows]
                rank = part["tokens"].map(bigger[kind]).to_numpy(np.int64) + part["before"].to_numpy(np.int64) + part["inside"].to_numpy(np.int64)
                group = np.searchsorted(firsts, rank, "right") - 1
                mine = np.zeros(len(part), dtype=np.int64)
                for g in np.unique(group):
                    here = np.flatnonzero(group == g)
                    table = np.array(places[int(g)])
                    r = rank[here] - firsts[g]
                    row = table[np.searchsorted(table[:, 1], r, "right") - 1]
                    mine[here] = row[:, 3] + (r - row[:, 1]) // row[:, 4]
                number[rows] = mine
            yield pd.DataFrame({c: pdf[c] for c in ("container_kind", "doc_id", "piece_no", "token_from", "tokens")} | {"number": number})

    typed = "container_kind string, doc_id long, piece_no long, token_from long, tokens long"
    placed = ranked.select("container_kind", "doc_id", "piece_no", "token_from", "tokens", "before", "inside").mapInPandas(place, f"{typed}, number long")
    name = F.concat(F.lit("mix/"), F.col("number").cast("string"))
    large = placed.select(*out_columns[:-1], name.alias("container_id"))

    shard_of = F.create_map(*[F.lit(x) for k in sorted(kinds) for x in (k, shards[k])])
    capacity_of = F.create_map(*[F.lit(x) for k in sorted(kinds) for x in (k, int(kinds[k]))])
    loads = placed.groupBy("container_kind", "number").agg(F.sum("tokens").alias("load"))
    rooms = loads.select(
        "container_kind", F.pmod(F.col("number"), shard_of[F.col("container_kind")]).cast("int").alias("shard"),
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("piece_no"), F.lit(None).cast("long").alias("token_from"),
        (capacity_of[F.col("container_kind")] - F.col("load")).alias("tokens"), name.alias("container_id"),
    ).filter("tokens > 0")
    small = loose.filter(~is_large).select(
        "container_kind", F.pmod(F.xxhash64("doc_id"), shard_of[F.col("container_kind")]).cast("int").alias("shard"),
        "doc_id", "piece_no", "token_from", "tokens", F.lit(None).cast("string").alias("container_id"),
    )
    capacities = {k: int(c) for k, c in kinds.items()}

    def fit_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, shard = key
        is_item = pdf["container_id"].isna().to_numpy()
        items_here = pdf[is_item].sort_values(["doc_id", "piece_no"])
        rooms_here = list(zip(pdf.loc[~is_item, "tokens"].astype(int), pdf.loc[~is_item, "container_id"], strict=True))
        sizes = items_here["tokens"].astype(int).tolist()
        found = best_fit([(s, i) for i, s in enumerate(sizes)], rooms_here, capacities[kind], lambda n: f"rest/{shard}/{n}")
        names = [""] * len(sizes)
        for i, c in found:
            names[i] = c
        return items_here[["container_kind", "doc_id", "piece_no", "token_from", "tokens"]].assign(container_id=names).astype({"doc_id": "int64", "piece_no": "int64", "token_from": "int64", "tokens": "int64"})

    fitted = small.unionByName(rooms).groupBy("container_kind", "shard").applyInPandas(fit_shard, f"{typed}, container_id string")
    parts = [whole.select(out_columns), none.select(out_columns), large.select(out_columns), fitted.select(out_columns)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def filling(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """container_kind, containers, tokens, unused_share: how well the containers of each kind are filled."""
    used = packed.filter(F.col("container_id").isNotNull()).groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("load"))
    totals = used.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("load").alias("tokens"))
    return totals.join(F.broadcast(containers.select("container_kind", "capacity_tokens")), "container_kind").select(
        "container_kind", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused_share")
    )
