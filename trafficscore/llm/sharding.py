"""Sharding by balanced label propagation.

``propagate``: any links.  Nodes start in shards of equal counts, dealt by a hash.  In each
round every node tallies the shards of its linked neighbours (joins over the link table);
nodes that would cut fewer links elsewhere ask to move, and quotas decide how
many may: from shard i to j as many as come the other way, and beyond that as
many as j has nodes without links to send back ("fillers").  So every round
keeps the counts as they were, at most one apart, whatever the links.  Movers of
highest gain go first.  Every linked node may ask, but two linked nodes shouldn't at
the same turn, or they would swap shards for ever: a coin per node and turn decides.  A leaf
(one neighbour) asks on the tails of its neighbour's coin, all others on the heads of
their own.  Rounds end when the quotas could let none in even if all that
wish to move asked, or none was let in for ``QUIET`` turns (so other coins came up too).

``propagate_groups``: links that join all members of a group to each other (equal texts).  What a
member hears of its neighbours' shards is then the same for all, the group's counts per
shard, so these joins are made once: a group is one row with its counts, a round is a
projection of the table of groups and one aggregation, and no document is touched before the rounds are
over.  On even turns members ask for the shard that holds most of their group, on odd
turns for another that holds some of it (so a group beside a full shard leaves it); asks of
one group for one shard are cut into pieces of ``1 / PIECES`` of a shard, so that a group
larger than what is free moves in part.  The asks are summed per pair of shards,
gain and a hash (``SUBS``), and the quotas are met by a prefix of these sums.  Rounds end when
no group is split, or the number of members beside their group's largest part has had no new
minimum for ``QUIET`` turns.

A shard's count is its quota, so of a group larger than a shard the rest stays
where it is.  What reaches the driver is a bounded number of sums a round.

``documents``: groups are documents of equal text.  Null text counts as the empty text with
size 1.  Repeated rows are rows of their own; equal rows are alike, so theirs may be any of
their group's places.  Only doc_id and text are read, so other columns may have any names.  Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficscore.llm.common import cut, number_rows, partitions

SHARDS = 8
QUIET = 6            # turns in a row without a move (or a gain), after which none is expected
PIECES = 64          # pieces of a shard's count that a group's move is cut into
SUBS = 64            # parts of the asks of one gain


def quotas(asked: dict[tuple[int, int], int], fillers: dict[int, int], shards: int) \
        -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """(movers let from i to j, fillers sent from i to j): every shard lets as many in as out."""
    left = dict(fillers)
    moved, filled = {}, {}
    for i in range(shards):
        for j in range(i + 1, shards):
            a, b = asked.get((i, j), 0), asked.get((j, i), 0)
            source, target = (i, j) if a >= b else (j, i)
            sent = min(abs(a - b), left.get(target, 0))
            left[target] = left.get(target, 0) - sent
            moved[source, target], moved[target, source] = min(a, b) + sent, min(a, b)
            filled[target, source] = sent
    return {k: v for k, v in moved.items() if v}, {k: v for k, v in filled.items() if v}


def _ranges(moved: dict, filled: dict) -> list[tuple[int, int, int, int, int]]:
    """(from, asked, first, last, to): of those in ``from`` that asked for shard
    ``asked`` (-1: fillers), the places first to last move to ``to``."""
    rows = [(i, j, 0, n - 1, j) for (i, j), n in moved.items()]
    ends: dict[int, int] = {}
    for (i, j), n in sorted(filled.items()):
        rows.append((i, -1, ends.get(i, 0), ends.get(i, 0) + n - 1, j))
        ends[i] = ends.get(i, 0) + n
    return rows


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """(id, shard) for ``nodes`` (id: 0 to n - 1, each once), given ``links`` (a, b, weight).

    ``rounds``: at most so many; by default until settled, which stars always come to."""
    spark = nodes.sparkSession
    both = cut(links.where("a <> b").select("a", "b", "weight")
               .unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
               .groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    degrees = both.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    # of two that have only each other, the larger id is the leaf
    met = (both.join(degrees, "a").join(degrees.select(F.col("a").alias("b"), F.col("degree").alias("other")), "b")
           .groupBy("a").agg((F.max("degree") == 1).alias("alone"), F.max("other").alias("other"), F.max("b").alias("b")))
    leaf = F.col("alone") & ((F.col("other") > 1) | (F.col("b") < F.col("a")))
    linked = met.select(F.col("a").alias("id"), F.lit(True).alias("linked"), leaf.alias("leaf"),
                        F.xxhash64(F.when(leaf, F.col("b")).otherwise(F.col("a"))).alias("coin"))
    labels = cut(nodes.select("id").join(linked, "id", "left")
                 .select("id", F.pmod("id", F.lit(shards)).cast("int").alias("shard"),
                         *(F.coalesce(c, F.lit(False)).alias(c) for c in ("linked", "leaf")), "coin"))
    if shards < 2 or both.isEmpty():
        return labels.select("id", "shard")
    turn = quiet = 0
    while quiet < QUIET and (rounds is None or turn < rounds):
        turn += 1
        # merge joins: tables of nodes would else be collected by the driver, anew every turn
        tally = (both.join(labels.select(F.col("id").alias("b"), "shard").hint("merge"), "b")
                 .groupBy("a", "shard").agg(F.sum("weight").alias("weight")))
        # the coins are data, hashed anew every turn, so that all turns share their compiled code
        own = labels.where("linked").select(F.col("id").alias("a"), F.col("shard").alias("from"),
                                            ((F.pmod("coin", F.lit(2)) == 1) == F.col("leaf")).alias("asks"))
        wish = (tally.join(own.hint("merge"), "a").groupBy("a", "from", "asks")
                .agg(F.max(F.struct("weight", (-F.col("shard")).alias("minus"))).alias("best"),
                     F.max(F.when(F.col("shard") == F.col("from"), F.col("weight"))).alias("stay")))
        gain = F.col("best.weight") - F.coalesce("stay", F.lit(0))
        movers = (wish.select(F.col("a").alias("id"), "from", (-F.col("best.minus")).cast("int").alias("asked"),
                              gain.alias("gain"), "asks")
                  .where("gain > 0 and from <> asked")
                  .select("id", "from", F.when(F.col("asks"), F.col("asked")).otherwise(-2 - F.col("asked")).alias("asked"),
                          (-F.least(F.floor(F.log2("gain")), F.lit(15))).cast("int").alias("low")))
        free = labels.where("not linked").select("id", F.col("shard").alias("from"), F.lit(-1).alias("asked"),
                                                 F.lit(0).alias("low"))
        queue = cut(number_rows(movers.unionByName(free), ["from", "asked"], "id", "place", ["low"]))
        counts = {(r["from"], r["asked"]): r["n"] for r in          # a number per pair of shards
                  queue.groupBy("from", "asked").agg(F.count(F.lit(1)).alias("n")).collect()}
        free_of = {i: n for (i, j), n in counts.items() if j == -1}
        moved, filled = quotas({k: n for k, n in counts.items() if k[1] >= 0}, free_of, shards)
        wished: dict[tuple[int, int], int] = {}                     # -2 - j: wishes for j, but its coin is against it
        for (i, j), n in counts.items():
            if j != -1:
                wished[i, max(j, -2 - j)] = wished.get((i, max(j, -2 - j)), 0) + n
        if not quotas(wished, free_of, shards)[0]:                  # whatever the coins
            break
        quiet = 0 if moved else quiet + 1
        labels = labels.withColumn("coin", F.xxhash64("coin"))
        if not moved:
            continue
        let = spark.createDataFrame(_ranges(moved, filled), "`from` int, asked int, first long, last long, `to` int")
        let = (queue.join(F.broadcast(let), ["from", "asked"]).where("place between first and last").select("id", "to"))
        labels = cut(labels.join(let.hint("merge"), "id", "left").select("id", F.coalesce("to", "shard").alias("shard"), "linked", "leaf", "coin"))
    return labels.select("id", "shard")


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def deal(groups: DataFrame, shards: int) -> DataFrame:
    """(group, n, counts): members of ``groups`` (group, n) dealt over the shards in turn, so that
    the shards' totals are at most one apart."""
    rows = groups.withColumn("part", F.pmod(F.xxhash64("group"), F.lit(partitions(groups))).cast("int"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    offsets = rows.groupBy("part").agg(F.sum("n").alias("m")).select("part", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("off"))
    inside = Window.partitionBy("part").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    first = F.pmod(F.col("off") + F.coalesce(F.sum("n").over(inside), F.lit(0)), F.lit(shards))
    share = [F.floor((F.col("n") + F.lit(shards) - 1 - F.pmod(F.lit(s) - F.col("first"), F.lit(shards))) / shards).cast("long")
             for s in range(shards)]
    return (rows.join(F.broadcast(offsets), "part").withColumn("first", first)
            .select("group", "n", F.array(*share).alias("counts")))


def grants(sums: dict[tuple[int, int], dict[int, int]], free: list[int], shards: int) -> list[int]:
    """Per pair (i * shards + j) the last key of asks that is granted (-1: none).

    ``sums``: members that ask, per pair and key.  The quotas are met by whole keys; then keys are taken
    back where a shard would let in more than leave it and ``free`` has room for."""
    asked = {pair: sum(keys.values()) for pair, keys in sums.items()}
    moved, _ = quotas(asked, dict(enumerate(free)), shards)
    granted: dict[tuple[int, int], list[int]] = {}
    for pair, quota in moved.items():
        keys, left = granted.setdefault(pair, []), quota
        for key in sorted(sums[pair]):
            left -= sums[pair][key]
            if left < 0:
                break
            keys.append(key)
    total = {pair: sum(sums[pair][k] for k in keys) for pair, keys in granted.items()}
    while True:
        over = [s for s in range(shards)
                if sum(n * ((j == s) - (i == s)) for (i, j), n in total.items()) > free[s]]
        if not over:
            break
        pair = max((p for p in total if p[1] == over[0] and total[p]), key=lambda p: total[p])
        total[pair] -= sums[pair][granted[pair].pop()]
    last = [-1] * (shards * shards)
    for (i, j), keys in granted.items():
        last[i * shards + j] = keys[-1] if keys else -1
    return last


def _turn(turn: int, most: int, shards: int) -> tuple[str, str, str]:
    """SQL texts over a group's row: the shard it asks for, and for a shard ``s`` and piece ``k`` the
    key of its ask and the size of a piece."""
    u = max(1, most // PIECES)
    coin = f"xxhash64(group, {turn}, s)"
    largest = f"array_max(transform(sequence(0, {shards - 1}), s -> struct(counts[s] AS c, {coin} AS h, s AS s))).s"
    other = (f"array_max(transform(sequence(0, {shards - 1}), s -> struct(if(counts[s] > 0, 1, 0) AS c, {coin} AS h, s AS s))).s")
    target = largest if turn % 2 == 0 else f"if(n <= {u}, {other}, {largest})"
    gain = "greatest(counts[target] - counts[s], 0)"
    key = f"((15 - least(15, cast(floor(log2(1 + {gain})) as int))) * {SUBS} + cast(pmod(xxhash64(group, {turn}, s, k), {SUBS}) as int))"
    return target, key, f"least({u}, counts[s] - k * {u})"


def propagate_groups(groups: DataFrame, total: int, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """(group, n, counts): how many members of each of ``groups`` (group, n) stand in each shard.

    ``total``: members and fillers together; the shards' counts are at most one apart."""
    room = capacities(total, shards)
    most = max(room)
    state = cut(deal(groups, shards))
    best, quiet, turn = None, 0, 0
    while quiet < QUIET and (rounds is None or turn < rounds):
        target, key, size = _turn(turn, most, shards)
        pieces = f"sequence(0, cast((counts[s] - 1) div {max(1, most // PIECES)} as int))"
        aimed = state.withColumn("target", F.expr(target))
        asks = (f"flatten(transform(sequence(0, {shards - 1}), s -> if(s = target OR counts[s] = 0, array(),"
                f" transform({pieces}, k -> struct(s AS i, target AS j, {key} AS key, {size} AS n)))))")
        # at most SUBS * 16 sums a pair of shards, and the shards' own
        own = F.array(*[F.struct(F.lit(s).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("key"), F.col("counts")[s].alias("n"))
                        for s in range(shards)])
        beside = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("key"), (F.col("n") - F.array_max("counts")).alias("n"))
        told = (aimed.select(F.inline(F.concat(F.expr(asks), own, F.array(beside)))).groupBy("i", "j", "key")
                .agg(F.sum("n").alias("n")).where("n > 0").collect())
        free, sums, split = list(room), {}, 0
        for r in told:
            if r["i"] < 0:
                split = r["n"]
            elif r["j"] < 0:
                free[r["i"]] -= r["n"]
            else:
                sums.setdefault((r["i"], r["j"]), {})[r["key"]] = r["n"]
        if not split:
            break
        best, quiet = (split, 0) if best is None or split < best else (best, quiet + 1)
        last = grants(sums, free, shards)
        turn += 1
        if max(last) < 0:
            continue
        granted = f"element_at(array({', '.join(map(str, last))}), s * {shards} + target + 1)"
        moves = (f"transform(sequence(0, {shards - 1}), s -> if(s = target OR counts[s] = 0, 0L, aggregate({pieces}, 0L,"
                 f" (sum, k) -> sum + if({key} <= {granted}, {size}, 0L))))")
        state = cut(aimed.withColumn("moves", F.expr(moves)).select(
            "group", "n", F.expr("transform(counts, (c, s) -> c - moves[s] + if(s = target, aggregate(moves, 0L, (a, m) -> a + m), 0L))")
            .alias("counts")))
    return state


def _shard_of(place: Column, counts: Column, shards: int) -> Column:
    """The shard of a group's member number ``place``: its counts' running sums cut the numbers."""
    sums = F.lit(0).cast("long")
    passed = F.lit(0)
    for s in range(shards - 1):
        sums = sums + counts[s]
        passed = passed + F.when(place >= sums, 1).otherwise(0)
    return passed.cast("int")


def documents(df: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    rows = df.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                     F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("group"))
    rows = cut(rows.withColumn("key", F.xxhash64("doc_id", "group")))
    # parts of groups: a group of any size is counted and numbered by as many tasks as there are parts
    part = F.pmod("key", F.lit(partitions(df))).cast("int")
    parts = cut(rows.groupBy("group", part.alias("part")).agg(F.count(F.lit(1)).alias("m")))
    groups = parts.groupBy("group").agg(F.sum("m").alias("n"))
    total = parts.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    state = propagate_groups(groups.where("n > 1"), total, shards, rounds)
    held = state.agg(*[F.coalesce(F.sum(F.col("counts")[s]), F.lit(0)).alias(f"s{s}") for s in range(shards)]).first()
    left = [room - own for room, own in zip(capacities(total, shards), held, strict=True)]
    ahead = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spots = (parts.join(state, "group", "left")
             .select("group", "part", "counts", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("off")))
    met = rows.withColumn("part", part).join(spots, ["group", "part"])
    place = F.col("off") + F.row_number().over(Window.partitionBy("group", "part").orderBy("key")) - 1
    columns = ["doc_id", "size", "text_crc32", "key"]
    grouped = (met.where("counts is not null").withColumn("place", place)
               .select(*columns, _shard_of(F.col("place"), F.col("counts"), shards).alias("shard")))
    # texts of their own fill what the groups leave
    single = number_rows(met.where("counts is null").select(*columns), [], "key", "place")
    single = single.select(*columns, _shard_of(F.col("place"), F.array(*[F.lit(n) for n in left]), shards).alias("shard"))
    out = number_rows(cut(grouped.unionByName(single)), ["shard"], "key", "slot")
    return out.select("doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("rows").alias("law"),
                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_links(placed: DataFrame, links: DataFrame) -> int:
    """Number of links whose ends are in different shards."""
    a = placed.select(F.col("id").alias("a"), F.col("shard").alias("shard_a"))
    b = placed.select(F.col("id").alias("b"), F.col("shard").alias("shard_b"))
    return links.where("a <> b").join(a, "a").join(b, "b").where("shard_a <> shard_b").count()
