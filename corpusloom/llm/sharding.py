"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Links are given as hubs: documents that share a hub are neighbours (an ordinary edge is a hub of two
members), so a group of n equal texts costs n rows and not n * n links. Propagation starts from labels that
know nothing of the links, and goes on until no move that the quotas allow lessens the number of cut links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import positioned, table, written

SHARDS = 8
#: Rounds of moves at most; they end before when no round lessens the cut any more.
ROUNDS = 24
#: A round that would not lessen the cut is tried again with this share of its moves at the least (chosen by hash).
LEAST_SHARE = 8
#: While nodes move, a shard may hold this share more than its part; evening out then takes the surplus off, group by group.
SLACK = 0.5


def quotas(want: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many may move from shard a to b: exchanges of equal numbers first, then what b has room for."""
    n = len(room)
    q = [[min(want[a][b], want[b][a]) if a != b else 0 for b in range(n)] for a in range(n)]
    for b in range(n):
        left = max(room[b], 0)
        for a in sorted((a for a in range(n) if a != b), key=lambda a: (q[a][b] - want[a][b], a)):
            more = min(want[a][b] - q[a][b], left)
            q[a][b] += more
            left -= more
    return q


def circulated(want: list[list[int]], room: list[int]) -> list[list[int]]:
    """`quotas`, and of what they leave as much as flows round: what comes to a shard is at most its room and what leaves it."""
    n, q = len(room), quotas(want, room)
    rest = [[want[a][b] - q[a][b] if a != b else 0 for b in range(n)] for a in range(n)]
    left = [room[b] - sum(q[a][b] for a in range(n)) + sum(q[b]) for b in range(n)]
    left = [max(x, 0) for x in left]
    changed = True
    while changed:
        changed = False
        for b in range(n):
            excess = sum(rest[a][b] for a in range(n)) - sum(rest[b]) - left[b]
            for a in sorted(range(n), key=lambda a: (-rest[a][b], a)):
                less = min(max(excess, 0), rest[a][b])
                rest[a][b], excess, changed = rest[a][b] - less, excess - less, changed or less > 0
    return [[q[a][b] + rest[a][b] for b in range(n)] for a in range(n)]


def _at(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index.cast("int") + 1)


def _hubs(members: DataFrame, shards: int) -> DataFrame:
    """(hub, n0, n1, ...) with the numbers of a hub's members in each shard, written down."""
    return written(members.groupBy("hub").agg(*[F.count_if(F.col("label") == b).alias(f"n{b}") for b in range(shards)]), "hubs")


def cut_links(hubs: DataFrame, shards: int) -> int:
    """The links that shards cut: pairs of a hub's members that are not in the same shard."""
    n = [F.col(f"n{b}").cast("decimal(19,0)") for b in range(shards)]
    pairs = lambda x: x * (x - 1) / 2
    return int(hubs.agg(F.sum(pairs(sum(n[1:], n[0])) - sum((pairs(x) for x in n[1:]), pairs(n[0])))).first()[0] or 0)


def _wanted(members: DataFrame, hubs: DataFrame, shards: int, free: list[int]) -> DataFrame:
    """(node, label, hub, to, gain): of the free shards and a node's own, that which holds most of its neighbours.

    A node counts itself once, and ties go by an order that its hub fixes, so that two neighbours never just swap.
    """
    scores = members.join(hubs, "hub").groupBy("node", "label").agg(F.min("hub").alias("hub"), F.count("*").alias("hubs"), *[F.sum(f"n{b}").alias(f"n{b}") for b in range(shards)])
    scores = scores.withColumns({f"n{b}": F.col(f"n{b}") - F.when(F.col("label") == b, F.col("hubs") - 1).otherwise(0) for b in range(shards)})
    first = F.pmod(F.xxhash64("hub"), F.lit(shards))
    may = lambda b: F.lit(True) if b in free else F.col("label") == b
    best = F.array_max(F.array(*[F.struct(F.when(may(b), F.col(f"n{b}")).otherwise(-1).alias("n"), (-F.pmod(F.lit(b) - first, F.lit(shards))).alias("turn"), F.lit(b).alias("to")) for b in range(shards)]))
    here = F.element_at(F.array(*[F.col(f"n{b}") for b in range(shards)]), F.col("label").cast("int") + 1)
    return scores.withColumns({"best": best, "here": here}).select("node", "hub", "label", F.col("best.to").alias("to"), (F.col("best.n") - F.col("here")).alias("gain"))


def propagate(nodes: DataFrame, members: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK, log: list | None = None) -> DataFrame:
    """(node, label, hub) of the nodes (node, label) that have hubs, after label propagation.

    members has (node, hub) for every hub of a node. In each round every node names the shard it wants; the
    numbers of such wishes (shards * shards of them) go to the driver, which answers with quotas that keep
    each shard's load within its part and `slack` of it, and in each pair of shards the largest gains move. Once full shards
    can only be wished for in vain, wishes are for the others. A round counts only if it lessens the cut; else
    half of its moves are tried, and so on. log gets (links cut, nodes that moved) before the first and of every round.
    """
    labels = written(members.join(nodes, "node").select("node", "hub", "label"), "labels")
    several = not labels.groupBy("node").count().where("count > 1").isEmpty()
    hubs, free, part, seen = _hubs(labels, shards), list(range(shards)), 1, [] if log is None else log
    cut = cut_links(hubs, shards)
    seen.append((cut, 0))
    for turn in range(rounds):
        wishes = written(_wanted(labels, hubs, shards, free), "wishes")
        load, want = [0] * shards, [[0] * shards for _ in range(shards)]
        goes = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(part)) == 0
        for r in wishes.withColumn("to", F.when(goes, F.col("to")).otherwise(F.col("label"))).groupBy("label", "to").count().collect():
            load[r["label"]] += r["count"]
            if r["label"] != r["to"]:
                want[r["label"]][r["to"]] = r["count"]
        room = [int(total / shards * (1 + slack)) - x for x in load]
        allowed = circulated(want, room)
        n_moves = sum(map(sum, allowed))
        if not n_moves:
            left = [b for b in range(shards) if room[b] > 0]
            if part > 1 or not left or left == free:
                break
            free = left
            continue
        starts, at = [], 0
        for a in range(shards):
            for b in range(shards):
                starts.append(at)
                at += want[a][b]
        movers = positioned(wishes.where((F.col("label") != F.col("to")) & goes), [F.col("label"), F.col("to"), F.col("gain").desc(), F.col("hub"), F.col("node")], "_pos")
        pair = F.col("label") * shards + F.col("to")
        chosen = movers.where(F.col("_pos") - _at(starts, pair) < _at([q for row in allowed for q in row], pair)).select("node", F.col("to").cast("int").alias("to"))
        now = written(labels.join(written(chosen, "moves"), "node", "left").select("node", "hub", F.coalesce("to", "label").alias("label")), "labels")
        after = _hubs(now, shards)
        new_cut = cut_links(after, shards)
        if new_cut < cut:
            labels, hubs, cut, part = now, after, new_cut, 1
            seen.append((cut, n_moves))
            if len(free) < shards:
                free = [b for b in range(shards) if room[b] > 0]
        elif part >= LEAST_SHARE:
            break
        else:
            part *= 2
    return labels.groupBy("node", "label").agg(F.min("hub").alias("hub")) if several else labels.select("node", "label", "hub")


def gathered(labelled: DataFrame, members: DataFrame, total: int, shards: int = SHARDS, log: list | None = None) -> DataFrame:
    """labelled (node, label, hub) with each group that a shard can hold gathered where most of it is, without quotas, if that lessens the cut.

    Few rows are left to move after propagation, and `evened` takes what is too much off by whole groups. log gets what `propagate` writes in it.
    """
    labels = written(members.join(labelled.select("node", "label"), "node").select("node", "hub", "label"), "labels")
    hubs = _hubs(labels, shards)
    fits = hubs.where(sum((F.col(f"n{b}") for b in range(1, shards)), F.col("n0")) <= total // shards).select("hub")
    wishes = _wanted(labels, hubs, shards, list(range(shards))).where(F.col("label") != F.col("to"))
    moves = written(wishes.join(fits, "hub", "left_semi").select("node", F.col("to").cast("int").alias("to")), "moves")
    n_moves = moves.count()
    moved = lambda df: df.join(moves, "node", "left").select("node", F.coalesce("to", "label").alias("label"), "hub")
    cut = cut_links(_hubs(moved(labels), shards), shards) if n_moves else None
    if cut is None or cut >= cut_links(hubs, shards):
        return labelled
    if log is not None:
        log.append((cut, n_moves))
    return moved(labelled)


def evened(labelled: DataFrame, total: int, shards: int = SHARDS) -> DataFrame:
    """labelled (node, label, hub) with shard and slot: counts at most one apart, slots gapless from 0.

    A shard keeps the first total / shards nodes of its label, those with hubs first; the others fill up the
    shards that lack some.
    """
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    have = [counts.get(b, 0) for b in range(shards)]
    quota = [total // shards + (b < total % shards) for b in range(shards)]
    starts = [sum(have[:b]) for b in range(shards)]
    over = [max(h - q, 0) for h, q in zip(have, quota)]
    lack = [max(q - h, 0) for h, q in zip(have, quota)]
    placed = positioned(labelled, [F.col("label"), F.col("hub").isNull(), F.col("hub"), F.col("node")], "_pos")
    rank = F.col("_pos") - _at(starts, F.col("label"))
    spare = _at([sum(over[:b]) for b in range(shards)], F.col("label")) + rank - _at(quota, F.col("label"))
    filled = [sum(lack[: b + 1]) for b in range(shards)]
    to = sum((F.when(F.col("_spare") >= x, 1).otherwise(0) for x in filled), F.lit(0))
    rows = placed.withColumns({"_rank": rank, "_spare": F.when(rank >= _at(quota, F.col("label")), spare)}).withColumn("_to", to)
    stays = F.col("_spare").isNull()
    shard = F.when(stays, F.col("label")).otherwise(F.col("_to")).cast("int")
    slot = F.when(stays, F.col("_rank")).otherwise(_at(have, F.col("_to")) + F.col("_spare") - _at([0, *filled[:-1]], F.col("_to")))
    return rows.select("node", shard.alias("shard"), slot.alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", log: list | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row; equal texts are linked.

    The law is `rows`: the shards' counts are at most one apart. A null text counts as empty; repeated rows and
    null ids are rows like any other; of a text only its digest and size move, however long it is. An empty table gives
    an empty result. Columns other than the two named are not read. log gets what `propagate` writes in it.
    """
    held = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(held) + 1).cast("long").alias("size"), F.crc32(held).alias("text_crc32"), F.md5(held).alias("hub"))
    # Propagation starts from equal runs of rows in the order of their ids' hashes, which tells nothing of their texts.
    nodes = written(positioned(narrow, [F.xxhash64("doc_id"), F.col("doc_id"), F.col("hub")], "node"), "nodes")
    total = nodes.count()
    nodes = nodes.withColumn("label", F.floor(F.col("node") * shards / max(total, 1)).cast("int"))
    groups = written(nodes.groupBy("hub").count().where("count > 1").select("hub"), "groups")
    members = written(nodes.join(groups, "hub", "left_semi").select("node", "hub"), "members")
    linked = written(propagate(nodes.select("node", "label"), members, total, shards, log=log), "linked")
    linked = written(gathered(linked, members, total, shards, log), "gathered")
    alone = nodes.join(groups, "hub", "left_anti").select("node", "label", F.lit(None).cast("string").alias("hub"))
    placed = written(evened(linked.select("node", "label", "hub").unionByName(alone), total, shards), "placed")
    return nodes.join(placed, "node").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, their numbers at most one apart, equal texts together as far as that allows."""
    return shard_documents(table(spark, sf_dir, "documents"))
