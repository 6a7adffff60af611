"""Problem 7: filling containers of fixed capacity with items of varying length.

Method: Karmarkar-Karp multiway differencing. Every item begins as a partial partition of its own; the two
with the largest imbalance are merged, the fullest window of one with the emptiest of the other, until one
partition is left. Windows that exceed the capacity then give items to windows with room, by moves and by
exchanges for smaller items; the number of windows begins at a lower bound and rises as long as one exceeds the
capacity. Should a single run of first-fit decreasing need fewer windows, all windows are dissolved and its are taken.

Texts are spread by hash over groups of bounded size which are packed independently, so that no task and
no group grows with the data. Only a text that overfills a window alone, however many there are, is split by the
packing: into full windows and one rest, which is an item like others. Texts of no tokens take no room and get no
window. Rows with equal doc_id are items of their own.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that are packed together at most, about; a group leaves less than one window of room more than a single run would.
GROUP_ITEMS = 1500


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """The positions of ``sizes`` in each of ``windows`` near-equal windows."""
    if windows == 1:
        return [list(range(len(sizes)))]
    heap: list[tuple[int, int, list[tuple[int, list]]]] = []
    # a partial partition: its windows that hold more than its emptiest, largest first, as (excess, members);
    # the other windows are given by their members only
    for at, size in enumerate(sizes):
        heap.append((-size, at, [(size, [at])]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, left = heapq.heappop(heap)
        _, _, right = heapq.heappop(heap)
        merged = _merge(left, right, windows)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    parts = heap[0][2] if heap else []
    out = [_flat(members) for _, members in parts]
    return out + [[] for _ in range(windows - len(out))]


def _merge(left: list, right: list, windows: int) -> list:
    """Two partial partitions in one, the fullest windows of one on the emptiest of the other."""
    free_left = windows - len(left)
    # right's windows, fullest first, go on left's emptiest: first the free ones, then from the least filled up
    result = []
    taken = min(len(right), free_left)
    result.extend(right[:taken])
    rest = right[taken:]
    keep = len(left) - len(rest)
    result.extend(left[:keep])
    for (a, members_a), (b, members_b) in zip(reversed(left[keep:]), rest, strict=True):
        result.append((a + b, [members_a, members_b]))
    result.sort(key=lambda part: -part[0])
    return result


def _flat(members: list) -> list[int]:
    out: list[int] = []
    stack = [members]
    while stack:
        top = stack.pop()
        if isinstance(top, list):
            stack.extend(top)
        else:
            out.append(top)
    return out


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Windows that any packing needs: for each small size, how much room the large items leave for the middle ones."""
    ordered = np.sort(np.asarray(sizes, np.int64))
    sums = np.concatenate([[0], np.cumsum(ordered)])
    half = int(np.searchsorted(ordered, capacity // 2, "right"))
    best = -(-int(sums[-1]) // capacity)
    for k in {0, *ordered[:half].tolist()}:
        large, first = int(np.searchsorted(ordered, capacity - k, "right")), int(np.searchsorted(ordered, k, "left"))
        room = (large - half) * capacity - int(sums[large] - sums[half])
        best = max(best, len(ordered) - half + max(0, -(-(int(sums[half] - sums[min(first, half)]) - room) // capacity)))
    return best


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    windows: list[list[int]] = []
    rooms = np.zeros(len(sizes), np.int64)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = rooms[: len(windows)] >= sizes[i]
        at = int(fits.argmax()) if fits.any() else len(windows)
        if at == len(windows):
            windows.append([])
            rooms[at] = capacity
        windows[at].append(i)
        rooms[at] -= sizes[i]
    return windows


def repaired(parts: list[list[int]], sizes: list[int], capacity: int) -> bool:
    """Moves items of windows over ``capacity`` to others, in place; False if some are left without room."""
    rooms = [capacity - sum(sizes[i] for i in part) for part in parts]
    loose: list[int] = []
    for w, part in enumerate(parts):
        if rooms[w] < 0:
            part.sort(key=lambda i: sizes[i])
        while rooms[w] < 0:
            # the smallest item that brings the window under the capacity, else the largest
            at = next((k for k, i in enumerate(part) if sizes[i] >= -rooms[w]), len(part) - 1)
            loose.append(part.pop(at))
            rooms[w] += sizes[loose[-1]]
    heap = [(-sizes[i], i) for i in loose]
    heapq.heapify(heap)
    order = sorted((room, w) for w, room in enumerate(rooms))
    while heap:
        size, i = heapq.heappop(heap)
        size = -size
        at = bisect.bisect_left(order, (size, -1))
        if at < len(order):
            room, w = order.pop(at)
        else:
            # the exchange that leaves the least room, for a smaller item
            least, w, out = None, -1, -1
            for room, v in order:
                for j in parts[v]:
                    left = room + sizes[j] - size
                    if 0 <= left and sizes[j] < size and (least is None or left < least):
                        least, w, out = left, v, j
                if least == 0:
                    break
            if least is None:
                return False
            room = rooms[w] + sizes[out]
            order.remove((rooms[w], w))
            parts[w].remove(out)
            heapq.heappush(heap, (-sizes[out], out))
        parts[w].append(i)
        rooms[w] = room - size
        bisect.insort(order, (rooms[w], w))
    return True


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of positions, none over ``capacity``; every size lies between 1 and ``capacity``."""
    if not sizes:
        return []
    windows = lower_bound(sizes, capacity)
    plain = first_fit_decreasing(sizes, capacity)
    while windows <= len(plain):
        parts = differencing(sizes, windows)
        if repaired(parts, sizes, capacity):
            return [part for part in parts if part]
        windows += 1
    return plain


def packed_texts(tokens: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(text, piece, pieces, tokens, window) of one group: a text that overfills a window alone is taken apart."""
    pieces = [max(1, -(-n // capacity)) for n in tokens]
    rows: list[tuple[int, int, int, int, int]] = []
    items: list[tuple[int, int, int]] = []
    window = 0
    for text, (n, k) in enumerate(zip(tokens, pieces, strict=True)):
        for piece in range(k - 1):
            rows.append((text, piece, k, capacity, window))
            window += 1
        if n > 0:
            items.append((text, k - 1, n - (k - 1) * capacity))
    for number, part in enumerate(pack([n for _, _, n in items], capacity)):
        rows += [(items[i][0], items[i][1], pieces[items[i][0]], items[i][2], window + number) for i in part]
    return rows


def packed(sizes: DataFrame, capacity: int, group_items: int = GROUP_ITEMS, seed: int = 7) -> DataFrame:
    """(doc_id, piece, n_pieces, tokens, group_no, window_no): a window for every piece; ``sizes`` is materialised.

    A window is known by group_no and window_no. piece counts from 0; all but the last of a text are full.
    """
    groups = max(1, -(-sizes.count() // group_items))
    spread = sizes.where("tokens > 0").select("doc_id", "tokens", F.pmod(F.xxhash64("doc_id", "tokens", F.lit(seed)), F.lit(groups)).cast("int").alias("group_no"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "doc_id"], ascending=[False, True], ignore_index=True)
        out = packed_texts(rows["tokens"].tolist(), capacity)
        text, piece, n_pieces, tokens, window = (np.array(c, np.int64) for c in zip(*out, strict=True))
        return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[text], "piece": piece, "n_pieces": n_pieces, "tokens": tokens, "group_no": int(rows["group_no"].iloc[0]), "window_no": window})

    return spread.groupBy("group_no").applyInPandas(run, "doc_id long, piece int, n_pieces int, tokens long, group_no int, window_no long")


def split_texts(packing: DataFrame) -> DataFrame:
    """(doc_id): the texts that the packing had to split, as they lie in more than one window."""
    return packing.where("n_pieces > 1").select("doc_id").distinct()


def fill_report(packing: DataFrame, capacity: int) -> DataFrame:
    """(n_windows, n_items, tokens, fill, least_windows): one row on how full the windows are, and the windows that the tokens need at least."""
    windows = packing.groupBy("group_no", "window_no").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_items"))
    sums = windows.agg(F.count(F.lit(1)).alias("n_windows"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return sums.withColumn("fill", F.when(F.col("n_windows") > 0, F.col("tokens") / (F.col("n_windows") * capacity))).withColumn("least_windows", F.ceil(F.col("tokens") / F.lit(capacity)))
