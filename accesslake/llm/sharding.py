"""Sharding documents evenly while linked documents stay together, by balanced label propagation.

Documents start in shards by hash. In every round each linked document asks for the shard that holds most of its neighbours;
requests from shard a to shard b are granted up to the quota that the counter-requests and the free room of b allow, so shards
stay even while they trade. At the end the shards are laid out one after the other, linked documents side by side, and the row of
all documents is cut into equal parts: counts differ by one at most and only links across a cut, or in groups larger than a shard,
are lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from accesslake.session import materialise
from .common import refuse_clash

#: Salts of the sort keys below, any fixed values.
_START, _DRAW = 11, 17


def _uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the given values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def gapless(df: DataFrame, *keys: str, name: str = "position") -> DataFrame:
    """``df`` in the order of its unique keys with gapless positions from 0, without a window over all rows.

    Rows are sorted by ranges and written; a row's position is its number within its part plus the sizes of the parts before it.
    The table of part sizes has one row for each part, so it stays small whatever the rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialise(
        df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, at = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return (ordered.withColumn("_part", part).join(F.broadcast(before), "_part")
            .select(*df.columns, (F.col("_before") + at).alias(name)))


def propagate(nodes: DataFrame, shards: int, rounds: int = 4) -> DataFrame:
    """(node, grp, shard) after rounds of label propagation under quotas; ``nodes`` has (node, grp), a null grp has no links.

    The neighbours of a document are the others of its group, so votes are counted for each group and shard, never gathered.
    A group larger than a shard asks for as many shards as it fills, its members are spread over those by hash.
    """
    room = max(1, -(-nodes.count() // shards))
    state = materialise(nodes.filter("grp IS NOT NULL").withColumn(
        "shard", F.pmod(F.xxhash64("node", F.lit(_START)), F.lit(shards)).cast("int")), "labels")
    for step in range(rounds):
        votes = state.groupBy("grp", "shard").agg(F.count("*").alias("votes"))
        best = materialise(votes.groupBy("grp").agg(
            F.sum("votes").alias("size"), F.max(F.struct("votes", (-F.col("shard")).alias("least"))).alias("top")).select(
                "grp", F.ceil(F.col("size") / room).cast("int").alias("wide"), (-F.col("top.least")).alias("home")), "wishes")
        wish = materialise(state.join(best, "grp").select("node", "grp", "shard", F.pmod(
            F.col("home") + F.floor(_uniform("node", F.lit(_DRAW)) * F.col("wide")).cast("int"), F.lit(shards)).alias("wish")), "asked")
        # shards x shards rows at most
        asked = wish.filter("wish != shard").groupBy("shard", "wish").agg(F.count("*").alias("n"))
        back = asked.select(F.col("wish").alias("shard"), F.col("shard").alias("wish"), F.col("n").alias("back"))
        held = wish.groupBy(F.col("shard").alias("wish")).agg(F.count("*").alias("held"))
        surplus = F.greatest(F.lit(0), F.col("n") - F.col("back"))
        space = F.greatest(F.lit(0), F.lit(room) - F.col("held"))  # unlinked documents make way
        quota = (asked.join(back, ["shard", "wish"], "left").fillna(0, ["back"]).join(held, "wish", "left").fillna(0, ["held"])
                 .withColumn("over", F.sum(surplus).over(Window.partitionBy("wish")))
                 .withColumn("granted", F.least("n", "back") + surplus * F.least(F.lit(1.0), space / F.greatest(F.lit(1), F.col("over"))))
                 .select("shard", "wish", (F.col("granted") / F.col("n")).alias("share")))
        moves = _uniform("node", F.lit(step)) < F.col("share")
        state = materialise(wish.join(F.broadcast(quota), ["shard", "wish"], "left").select(
            "node", "grp", F.when(moves, F.col("wish")).otherwise(F.col("shard")).cast("int").alias("shard")), "labels")
    # unlinked documents fill what room is left: one number for each shard
    linked = {r.shard: r.n for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    left = [max(0, room - linked.get(k, 0)) for k in range(shards)]
    upto = [sum(left[: k + 1]) / max(1, sum(left)) for k in range(shards - 1)]
    draw = _uniform("node", F.lit(_START))
    filled = F.size(F.filter(F.array(*map(F.lit, upto)), lambda x: x <= draw)) if upto else F.lit(0)
    return state.union(nodes.filter("grp IS NULL").select("node", "grp", filled.cast("int").alias("shard")))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text: str = "text", rounds: int = 4) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document: ``shards`` shards with counts at most one apart.

    Linked are documents of equal text. ``size`` is the text's bytes in UTF-8 (null: none) plus 16; ``text_crc32`` is that of the
    text (null: 0). ``slot`` counts from 0 within each shard. The law is ``rows``, ``grown_shard`` is null. Null texts have no links.
    Rows with equal or null ids are rows of their own, in any order among themselves. No rows give no rows; with fewer rows than
    shards the first shards hold one each. Columns other than the two named are not read.
    """
    refuse_clash(docs.select(id_col), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    rows = materialise(docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.md5(F.encode(text, "UTF-8")).alias("digest"), F.monotonically_increasing_id().alias("node")), "rows")
    groups = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("n"), F.min("node").alias("grp")).filter("n > 1")
    linked = materialise(groups.select("digest", "grp"), "groups")
    nodes = materialise(rows.join(linked, "digest", "left").select("node", "grp", "doc_id", "size", "text_crc32"), "nodes")
    labels = propagate(nodes.select("node", "grp"), shards, rounds).drop("grp")
    total = nodes.count()
    placed = nodes.join(labels, "node")
    # whole groups side by side within a shard; unlinked documents last
    laid = gapless(placed, "shard", "grp", "doc_id", "node") if total else placed.withColumn("position", F.lit(0).cast("long"))
    low, extra = divmod(total, shards)
    wide = extra * (low + 1)  # the first ``extra`` shards hold one more
    position = F.col("position")
    first = position < wide
    shard = F.when(first, F.floor(position / (low + 1))).otherwise(extra + F.floor((position - wide) / max(low, 1))).cast("int")
    start = F.when(first, F.pmod(position, F.lit(low + 1))).otherwise(F.pmod(position - wide, F.lit(max(low, 1))))
    return laid.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"),
                       start.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
