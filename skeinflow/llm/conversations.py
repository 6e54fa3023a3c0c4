"""Ordered conversations from message rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinflow.functions.text import is_blank, trimmed
from skeinflow.operators.skew import hot_keys, lookup_join
from skeinflow.plans.messages import MESSAGES, config_in_force
from skeinflow.runtime import Scratch, table


def reply_paths(nodes: DataFrame, node: str, parent: str, unique: bool = False) -> DataFrame:
    """Resolve parent pointers by pointer jumping.

    Returns ``node, root, depth, state`` for each distinct ``node``; null nodes have no row, and of
    several parents of one node the smallest counts (``unique`` says that there are none of either):
    ``state`` is ``ok`` for nodes that reach a root (a node with null parent, depth 0), ``orphan``
    for nodes whose chain ends in a parent that isn't there, and ``cycle`` for nodes whose chain
    ends in a cycle; ``root`` and ``depth`` are null for the latter two. An empty table gives no rows.

    In each round every unfinished node replaces its pointer by its pointer's pointer and adds up
    the distances, so a chain of length n takes log2(n) rounds. A round is one join of the
    unfinished nodes with the nodes they point at; pointers that many nodes share (a root with most of the replies) are split off by
    ``lookup_join``. After log2(rows) + 1 rounds whatever is unfinished runs in a cycle. Each
    round's table goes to the shared folder. Nodes are best numbers: pointers are all that moves.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "paths")
    base = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    if not unique:
        base = base.where("node IS NOT NULL").groupBy("node").agg(F.min("parent").alias("parent"))
    base = scratch.save(base)
    rows = base.count()
    here = base.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    ok, orphan = F.lit(0).cast("tinyint"), F.lit(1).cast("tinyint")
    # A root points at itself; a node whose parent isn't there points nowhere.
    state = lookup_join(base, here, "parent", "left", hot=hot_keys(base, "parent", rows=rows)).select(
        "node",
        F.when(F.col("parent").isNull(), F.col("node")).when(F.col("there"), F.col("parent")).alias("ptr"),
        F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth"),
        F.when(F.col("parent").isNull(), ok).when(F.col("there").isNull(), orphan).alias("state"),
    )
    state = scratch.save(state)
    finished = [state.where("state IS NOT NULL")]
    active = state.where("state IS NULL")
    for _ in range(int(math.log2(max(rows, 2))) + 2):
        left = active.count()
        if not left:
            break
        everything = active
        for part in finished:
            everything = everything.unionByName(part)
        target = everything.select(F.col("node").alias("ptr"), F.col("ptr").alias("up"), F.col("depth").alias("more"), F.col("state").alias("ends"))
        jumped = lookup_join(active.select("node", "ptr", "depth"), target, "ptr", hot=hot_keys(active, "ptr", rows=left)).select(
            "node",
            F.coalesce("up", "ptr").alias("ptr"),
            (F.col("depth") + F.col("more")).alias("depth"),
            F.col("ends").alias("state"),
        )
        jumped = scratch.save(jumped)
        finished.append(jumped.where("state IS NOT NULL"))
        active = jumped.where("state IS NULL")
    out = active
    for part in finished:
        out = out.unionByName(part)
    done = F.col("state") == 0
    name = F.when(done, F.lit("ok")).when(F.col("state") == 1, F.lit("orphan")).otherwise(F.lit("cycle"))
    return out.select("node", F.when(done, F.col("ptr")).alias("root"), F.when(done, F.col("depth")).alias("depth"), name.alias("state"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of every whole conversation: ``conversation_id, turn_no, message_id, role``.

    Kept are conversations whose messages are exactly those that their segment lists, each with a
    time and a role (bot, owner, partner), with a text of the owner and one of the partner that
    aren't blank. A null or repeated id in a list counts as missing or once.

    Messages are first reduced to one row each, then each conversation to a few numbers (with
    map-side combining, so a conversation with most of the rows is harmless): its size, partner and
    speakers. A conversation of another size than its list, or without a partner or a text of both,
    goes no further, so one that does is no larger than the list in one input row.

    The rest meet the listed ids in an outer join. In time order a message's parent is the one
    before it; what is wrong comes first in its conversation and isn't a node: a listed id without
    message, a message that isn't listed, one without time or role. ``reply_paths`` then finds
    every message after it an orphan, and what reaches a root is a whole conversation. Its depth is
    the place of the turn.
    """
    owner = F.lit(config_in_force(spark, sf_dir)["self_user_id"])
    scratch = Scratch(spark, "turns")
    partner = F.when((trimmed(F.col("partner_id")) != "") & (F.col("partner_id") != "unknown") & ~F.col("partner_id").eqNullSafe(owner), F.col("partner_id"))
    messages = (
        table(spark, sf_dir, MESSAGES)
        .where(F.col("conversation_id").isNotNull())
        .groupBy("conversation_id", trimmed(F.col("message_id")).alias("message_id"))
        .agg(
            F.max(F.unix_micros("timestamp_utc")).alias("us"),
            F.max("author_id").alias("author_id"),
            F.coalesce(F.max("is_bot_or_application"), F.lit(False)).alias("bot"),
            F.min(partner).alias("partner_lo"),
            F.max(partner).alias("partner_hi"),
            F.max(~is_blank(F.col("content_raw"))).alias("spoken"),
            # One id in two threads is two messages, of which the list can name but one.
            (F.min("thread_id") != F.max("thread_id")).alias("twice"),
        )
    )
    messages = scratch.save(messages)
    by_owner = ~F.col("bot") & F.col("author_id").eqNullSafe(owner)
    by_other = ~F.col("bot") & ~F.col("author_id").eqNullSafe(owner)
    other = F.when(by_other, F.col("author_id"))
    whole = (
        messages.groupBy("conversation_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("partner_lo").alias("p_lo"),
            F.max("partner_hi").alias("p_hi"),
            F.min(other).alias("o_lo"),
            F.max(other).alias("o_hi"),
            F.max(by_owner & F.col("spoken")).alias("owner_spoke"),
            F.max(by_other & F.col("spoken")).alias("partner_spoke"),
        )
        .where("p_lo = p_hi AND o_lo = p_lo AND o_hi = p_lo AND owner_spoke AND partner_spoke")
    )
    ids = F.filter(F.array_distinct("message_ids"), lambda x: x.isNotNull())
    segments = table(spark, sf_dir, "conversation_segments").where(F.col("conversation_id").isNotNull() & F.col("message_ids").isNotNull())
    sized = segments.select("conversation_id", F.size(F.array_distinct("message_ids")).cast("long").alias("n"))
    kept = scratch.save(whole.select("conversation_id", "n").join(sized, ["conversation_id", "n"], "left_semi").select("conversation_id"))
    listed = segments.select("conversation_id", F.explode(ids).alias("message_id"), F.lit(True).alias("listed"))
    role = F.when(F.col("bot"), F.lit("bot")).when(by_owner, F.lit("owner")).when(F.col("author_id").isNotNull(), F.lit("partner"))
    said = messages.select("conversation_id", "message_id", "us", F.when(~F.col("twice"), role).alias("role"))
    # The ids meet the messages first: the outer join keeps the distribution of the aggregate, and what is dropped goes after it.
    faced = said.join(listed, ["conversation_id", "message_id"], "full_outer").join(kept, "conversation_id", "left_semi")
    wrong = F.col("listed").isNull() | F.col("us").isNull() | F.col("role").isNull()
    ordered = Window.partitionBy("conversation_id").orderBy(F.desc("wrong"), "us", "message_id")
    # Rows come out of the window in order, so the row before has the number before.
    chained = faced.withColumn("wrong", wrong).withColumn("opens", F.row_number().over(ordered) == 1).withColumn("node", F.monotonically_increasing_id())
    chained = scratch.save(chained.where("NOT wrong").select("node", F.when(~F.col("opens"), F.col("node") - 1).alias("parent"), "conversation_id", "message_id", "role"))
    paths = reply_paths(chained, "node", "parent", unique=True).where("state = 'ok'").select("node", "depth")
    return chained.join(paths, "node").select("conversation_id", (F.col("depth") + 1).alias("turn_no"), "message_id", "role")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_turns(spark, sf_dir)
