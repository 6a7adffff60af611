"""Problem 8: mixing sources to target weights.

Method: documents are aggregated by membership pattern (the set of target sources that hold their text), and a
min-cost flow routes token capacity from patterns to source quotas. A further use of a text costs more than the
one before (convex), and a source's max_repeats bounds its uses. Then seeded documents fill the flow.

Exact copies of one text within the target sources are one text, known by its smallest doc_id, so that none is
used more often than allowed. Texts of no tokens and null sources take no part in the mix, but the size aimed at
counts all documents. Targets with a null share or repeats take no part; a source named twice counts once, with its largest values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_broadcast, materialise

#: Membership patterns beyond which the driver's flow would be too large; with n targets there are at most 2^n - 1.
MAX_PATTERNS = 20_000
#: Documents of a pattern that are ordered together by one task, about.
BUCKET_ROWS = 2_000


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The flow on each arc (from, to, capacity, cost) of a maximum flow of least cost: successive shortest paths."""
    to: list[int] = []
    left: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, capacity, price in arcs:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            left.append(c)
            cost.append(p)
    while True:
        far = [float("inf")] * n
        far[source] = 0
        via = [-1] * n
        queue, queued = [source], [False] * n
        while queue:
            x = queue.pop(0)
            queued[x] = False
            for e in out[x]:
                if left[e] > 0 and far[x] + cost[e] < far[to[e]]:
                    far[to[e]] = far[x] + cost[e]
                    via[to[e]] = e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        queue.append(to[e])
        if via[sink] < 0:
            return [arcs[i][2] - left[2 * i] for i in range(len(arcs))]
        amount, x = None, sink
        while x != source:
            e = via[x]
            amount = left[e] if amount is None else min(amount, left[e])
            x = to[e ^ 1]
        x = sink
        while x != source:
            left[via[x]] -= amount
            left[via[x] ^ 1] += amount
            x = to[via[x] ^ 1]


def texts_by_pattern(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, tokens, pattern): one row per distinct text of the target sources; documents have doc_id, source, text_key, tokens.

    A text held by very many rows is combined before it is shuffled.
    """
    wanted = documents.join(bounded_broadcast(targets.select("source").distinct()), "source").where("tokens > 0")
    return wanted.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"), F.array_join(F.array_sort(F.collect_set("source")), "\x1f").alias("pattern")).drop("text_key")


def clean_targets(targets: DataFrame) -> DataFrame:
    valid = targets.where("source is not null and target_share is not null and max_repeats is not null")
    return valid.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def plan(texts: DataFrame, targets: DataFrame, total_tokens: int) -> list[dict]:
    """The flow from each pattern to each source, with the uses it takes; rows of pattern, source, tokens, quota and offset.

    Only pattern totals reach the driver, counted first against ``MAX_PATTERNS``.
    """
    wanted = [row for row in targets.collect() if row.max_repeats >= 0 and row.target_share > 0]
    sizes = texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).limit(MAX_PATTERNS + 1).collect()
    if len(sizes) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sizes.sort()
    place = {row.source: 2 + len(sizes) + i for i, row in enumerate(wanted)}
    arcs: list[tuple[int, int, int, int]] = []
    links: list[tuple[int, str, str]] = []
    for i, (pattern, tokens) in enumerate(sizes):
        members = [row for row in wanted if row.source in pattern.split("\x1f")]
        for use in range(max((row.max_repeats for row in members), default=0)):
            arcs.append((0, 2 + i, tokens, use))
        for row in members:
            links.append((len(arcs), pattern, row.source))
            arcs.append((2 + i, place[row.source], tokens * row.max_repeats, 0))
    quotas = {row.source: int(row.target_share * total_tokens) for row in wanted}
    for source, node in place.items():
        arcs.append((node, 1, quotas[source], 0))
    flow = min_cost_flow(2 + len(sizes) + len(wanted), arcs, 0, 1)
    offsets: dict[str, int] = {}
    size_of = dict(sizes)
    rows = []
    for arc, pattern, source in links:
        start = offsets.get(pattern, 0)
        rows.append({"pattern": pattern, "source": source, "tokens": size_of[pattern], "start": start, "flow": flow[arc], "quota": quotas[source]})
        offsets[pattern] = start + flow[arc]
    for source in set(quotas) - {r["source"] for r in rows}:
        rows.append({"pattern": "", "source": source, "tokens": 0, "start": 0, "flow": 0, "quota": quotas[source]})
    return rows


_PLAN = "pattern string, source string, tokens long, start long, flow long, quota long"


def plan_frame(texts: DataFrame, targets: DataFrame, total_tokens: int) -> DataFrame:
    return texts.sparkSession.createDataFrame(plan(texts, targets, total_tokens), _PLAN)


def short_sources(planned: DataFrame) -> DataFrame:
    """(source): the targets whose texts, used as often as allowed, stay under their quota."""
    return planned.groupBy("source").agg(F.sum("flow").alias("flow"), F.max("quota").alias("quota")).where("flow < quota").select("source")


def selection(texts: DataFrame, planned: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, uses): how often each text is used for each source.

    The texts of a pattern lie in seeded order on a line as long as their tokens, laid out once per use; each source
    takes the stretch of the line that its flow fills. Positions come from sums over buckets of the seeded order, then
    within a bucket, so that no task orders a whole pattern. ``texts`` is materialised.
    """
    rows = texts.count()
    buckets = max(16, rows // BUCKET_ROWS)
    step = max(1, round(buckets**0.5))
    order = F.xxhash64("doc_id", F.lit(seed))
    placed = texts.withColumn("at", order).withColumn("bucket", F.pmod("at", F.lit(buckets)))
    sums = materialise(placed.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("bucket_tokens")).withColumn("row", F.expr(f"bucket div {step}")), "bucket-sums")
    # buckets stand in rows of buckets, so that not even those of a whole pattern are ordered by one task
    before_row = Window.partitionBy("pattern").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    row_starts = sums.groupBy("pattern", "row").agg(F.sum("bucket_tokens").alias("row_tokens")).withColumn("row_start", F.coalesce(F.sum("row_tokens").over(before_row), F.lit(0))).drop("row_tokens")
    before = Window.partitionBy("pattern", "row").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("in_row", F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0))).join(row_starts, ["pattern", "row"])
    starts = starts.select("pattern", "bucket", (F.col("row_start") + F.col("in_row")).alias("bucket_start"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    lined = placed.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(bounded_broadcast(starts), ["pattern", "bucket"])
    x = F.col("bucket_start") + F.col("within")
    lanes = planned.where("flow > 0").select("pattern", "source", F.col("tokens").alias("lap"), "start", "flow")
    joined = lined.withColumn("x", x).join(F.broadcast(lanes), "pattern")
    uses = F.expr("cast(floor((start + flow - x - 1) / lap) - floor((start - x - 1) / lap) as int)")
    return joined.select("doc_id", "source", "tokens", uses.alias("uses")).where("uses > 0")


def reached_shares(chosen_texts: DataFrame, targets: DataFrame, total_tokens: int) -> DataFrame:
    """(source, target_share, tokens, share, mix_share): what each target reached of the size aimed at, and of the mix as it is."""
    by_source = chosen_texts.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"))
    by_source = materialise(by_source, "mix-tokens")
    mix_tokens = by_source.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    rows = targets.join(by_source, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    share = [(F.col("tokens") / F.lit(n) if n else F.lit(None).cast("double")).alias(name) for n, name in ((total_tokens, "share"), (mix_tokens, "mix_share"))]
    return rows.select("source", "target_share", "tokens", *share)
