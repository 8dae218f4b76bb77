"""Log and time-series operators: intervals, rings, windows, pages and samples. Times are microseconds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.runtime import cut

SECOND = 1_000_000


def search_memory(log: DataFrame, frm: float | None = None, to: float | None = None, source: int | None = None, target: int | None = None, channel: int | None = None, limit: int = 100) -> DataFrame:
    """Newest messages that fulfil the given conditions; bounds are inclusive epoch seconds."""
    if frm is not None:
        log = log.where(F.col("us") >= int(frm * SECOND))
    if to is not None:
        log = log.where(F.col("us") <= int(to * SECOND))
    for column, value in (("source_id", source), ("target_id", target), ("channel", channel)):
        if value is not None:
            log = log.where(F.col(column) == value)
    return log.orderBy(F.desc("us"), "id").limit(limit)


def open_exchange(messages: DataFrame, window: int = 600, floor: float = 0.9, me: int = 0) -> DataFrame:
    """(id, open): within the window before it, in its channel, the author addressed the agent or the agent spoke to the author.

    messages (id, us, channel, source_id, target_id, directedness). A row counts for its author, and one of the agent's for its target too, so
    both ways are one window by channel and person.
    """
    addressed = F.col("directedness") >= floor
    own = messages.select("id", "us", "channel", F.col("source_id").alias("person"), addressed.alias("opens"), F.lit(True).alias("asked"))
    told = messages.where(F.col("source_id") == me).select("id", "us", "channel", F.col("target_id").alias("person"), F.lit(True).alias("opens"), F.lit(False).alias("asked"))
    before = Window.partitionBy("channel", "person").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("opens"), F.col("us"))).over(before)
    return own.unionByName(told).withColumn("last", last).where("asked").select("id", F.coalesce(F.col("us") - F.col("last") <= window * SECOND, F.lit(False)).alias("open"))


def reply_context(turns: DataFrame, window: int = 900) -> DataFrame:
    """(conv_id, turn, question_turn): what each user turn answers: the agent's message that it names, else the agent's newest message before it,
    if that is a question of the last `window` seconds and the user said nothing between.

    turns (conv_id, turn, role, question); optional us (always within the window without it), message_id and reply_to.
    """
    has = lambda c, kind: F.col(c) if c in turns.columns else F.lit(None).cast(kind)
    rows = turns.select("conv_id", "turn", "role", "question", has("us", "long").alias("us"), has("message_id", "string").alias("message_id"), has("reply_to", "string").alias("reply_to"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max(F.when(F.col("role") == "assistant", F.struct("turn", "question", "us"))).over(w)
    rows = rows.withColumns({"newest": newest, "spoken": F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w)})
    named = rows.where("role = 'assistant' and message_id is not null").groupBy("conv_id", F.col("message_id").alias("reply_to")).agg(F.max("turn").alias("named"))
    rows = rows.where("role = 'user'").join(named, ["conv_id", "reply_to"], "left")
    near = F.coalesce(F.col("us") - F.col("newest.us") <= window * SECOND, F.lit(True))
    derived = F.when(F.col("newest.question") & near & (F.col("newest.turn") > F.coalesce("spoken", F.lit(-1))), F.col("newest.turn"))
    return rows.select("conv_id", "turn", F.coalesce("named", derived).alias("question_turn"))


def episode_near(picks: DataFrame, episodes: DataFrame, within: int = 1800) -> DataFrame:
    """Picks (stakeholder, us) with a positive episode of the same person within so many seconds.

    Both sides are dealt into time buckets as long as the window, so the interval join is an equi-join on three buckets.
    """
    size = within * SECOND
    bucket = F.floor(F.col("us") / size).cast("long")
    e = episodes.where("delta > 0").select("stakeholder", F.col("us").alias("e_us"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    p = picks.withColumn("bucket", bucket)
    near = (p["stakeholder"] == e["stakeholder"]) & (p["bucket"] == e["bucket"]) & (F.abs(p["us"] - e["e_us"]) <= size)
    return p.join(e, near, "left_semi").drop("bucket")


def recent_room(log: DataFrame, now: int, me: int, within: int = 3600) -> DataFrame:
    """The newest message by someone else inside the window (one row or none)."""
    return log.where((F.col("us") > now - within * SECOND) & (F.col("us") <= now) & (F.col("source_id") != me)).orderBy(F.desc("us"), "id").limit(1)


def pending_items(log: DataFrame, judged: DataFrame, me: int, n: int) -> DataFrame:
    """The oldest n inputs by others without a verdict."""
    return log.where(F.col("source_id") != me).join(judged, "id", "left_anti").orderBy("us", "id").limit(n)


def sense_overlap(log: DataFrame, delta: DataFrame, cap: int = 256) -> DataFrame:
    """Log rows that share a sense with new knowledge (sense), newest first."""
    hit = log.select("id", F.explode("senses").alias("sense")).join(delta, "sense", "left_semi").select("id").distinct()
    return log.join(hit, "id", "left_semi").orderBy(F.desc("us"), "id").limit(cap)


def metric_trend(snapshots: DataFrame) -> DataFrame:
    """(hour, metric, trend): sign of the change of each metric since the previous snapshot that has it, 0 for the first."""
    points = snapshots.select("hour", F.explode("metrics").alias("metric", "value"))
    before = F.lag("value").over(Window.partitionBy("metric").orderBy("hour"))
    return points.select("hour", "metric", F.coalesce(F.signum(F.col("value") - before), F.lit(0.0)).cast("int").alias("trend"))


def sparkline(snapshots: DataFrame, n: int = 12) -> DataFrame:
    """(hour, metric, values): the last n finite values of each metric, oldest first."""
    points = snapshots.select("hour", F.explode("metrics").alias("metric", "value")).where("value is not null and not isnan(value)")
    return points.select("hour", "metric", F.collect_list("value").over(Window.partitionBy("metric").orderBy("hour").rowsBetween(1 - n, 0)).alias("values"))


def _carry(rows: DataFrame, level: int, block: int) -> DataFrame:
    """(at, carried): the last value `own` that is not null up to and at each place, by blocks of places and blocks of blocks."""
    if level == 0:
        return rows.select("at", F.last("own", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).alias("carried"))
    rows = rows.withColumn("block", F.floor(F.col("at") / block))
    own = F.last("own", ignorenulls=True).over(Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.groupBy("block").agg(F.max(F.when(F.col("own").isNotNull(), F.struct("at", "own")))["own"].alias("own"))
    # What a block ends with counts from the next block on.
    later = ends.select((F.col("block") + 1).alias("at"), "own").unionByName(ends.select(F.col("block").alias("at"), F.lit(None).cast("string").alias("own")))
    before = _carry(later.groupBy("at").agg(F.max("own").alias("own")), level - 1, block).select(F.col("at").alias("block"), F.col("carried").alias("before"))
    return rows.withColumn("carried", own).join(before, "block", "left").select("at", F.coalesce("carried", "before").alias("carried"))


def sticky_version(snapshots: DataFrame, block: int = 1000) -> DataFrame:
    """(hour, version): the last non-empty version carried forward.

    Rows are carried inside blocks of hours, and from block to block in the same way, three levels up; only the blocks of the last
    level, one for block^3 hours, are sorted in one task.
    """
    rows = snapshots.select(F.col("hour").alias("at"), F.when(F.col("version") != "", F.col("version")).alias("own"))
    return _carry(rows, 3, block).select(F.col("at").alias("hour"), F.col("carried").alias("version"))


def latency_gaps(events: DataFrame, by: str) -> DataFrame:
    """(by, least, mean, most): seconds between consecutive events."""
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy(by).orderBy("us", "event_id"))) / SECOND
    return events.select(by, gap.alias("gap")).where("gap is not null").groupBy(by).agg(F.min("gap").alias("least"), F.round(F.avg("gap"), 4).alias("mean"), F.max("gap").alias("most"))


def _ringed(log: DataFrame, seconds: int, *columns: str) -> DataFrame:
    """Rows of a channel with those of the time before: dealt by channel and time, each row to its own bucket and to the next one, so
    that a busy channel is many tasks and every row finds what is at most so many seconds older."""
    own = F.floor(F.col("us") / (seconds * SECOND)).cast("long")
    return log.select("id", "us", "channel", *columns, own.alias("own"), F.explode(F.array(own, own + 1)).alias("bucket"))


def context_ring(log: DataFrame, rows: int = 30, seconds: int = 1800) -> DataFrame:
    """(id, ring): ids of the channel's last rows, this one included, within both caps."""
    w = Window.partitionBy("channel", "bucket").orderBy("us", "id").rowsBetween(1 - rows, 0)
    seen = _ringed(log, seconds).withColumn("ring", F.collect_list(F.struct("us", "id")).over(w)).where("own = bucket")
    return seen.select("id", F.transform(F.filter("ring", lambda x: x["us"] >= F.col("us") - seconds * SECOND), lambda x: x["id"]).alias("ring"))


def talker_depth(log: DataFrame, rows: int = 30, seconds: int = 1800, momentum: int = 3) -> DataFrame:
    """(id, depth, momentum): earlier rows of the same speaker in the ring."""
    w = Window.partitionBy("channel", "bucket").orderBy("us", "id").rowsBetween(1 - rows, -1)
    seen = _ringed(log, seconds, "source_id").withColumn("ring", F.collect_list(F.struct("us", "source_id")).over(w)).where("own = bucket")
    depth = F.size(F.filter("ring", lambda x: (x["us"] >= F.col("us") - seconds * SECOND) & (x["source_id"] == F.col("source_id"))))
    return seen.select("id", depth.alias("depth"), (depth >= momentum).alias("momentum"))


def awake_ledger(marks: DataFrame) -> DataFrame:
    """(user_id, seconds): awake time from opening and closing marks; an unclosed stretch counts to the last event seen."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    end = F.least(F.lead("us").over(w), F.max("us").over(Window.partitionBy("user_id")))
    spans = marks.select("user_id", "opens", (F.coalesce(end, F.col("us")) - F.col("us")).alias("d"))
    return spans.groupBy("user_id").agg((F.sum(F.when(F.col("opens"), F.greatest(F.lit(0), F.col("d"))).otherwise(0)) / SECOND).alias("seconds"))


def scene_normalise(rows: DataFrame) -> DataFrame:
    """Points (scene, id, x, y, z, size) mapped to [-1, 1] by the scene's widest axis; a flat axis is 0, sizes are scaled only.

    Extents are one row a scene, aggregated before they are shuffled, so a scene of any size is many tasks.
    """
    extent = rows.groupBy(F.col("scene").alias("_scene")).agg(*[f(c).alias(f"_{c}{i}") for c in "xyz" for i, f in enumerate((F.min, F.max))])
    span = F.greatest(*[F.col(f"_{c}1") - F.col(f"_{c}0") for c in "xyz"])
    mid = lambda c: (F.col(f"_{c}1") + F.col(f"_{c}0")) / 2
    flat = lambda c: F.col(f"_{c}1") == F.col(f"_{c}0")
    placed = rows.join(extent, F.col("scene").eqNullSafe(F.col("_scene"))).withColumn("_span", span)
    axes = [F.when(flat(c) | (F.col("_span") == 0), F.lit(0.0)).otherwise((F.col(c) - mid(c)) * 2 / F.col("_span")).alias(c) for c in "xyz"]
    return placed.select("scene", "id", *axes, F.when(F.col("_span") == 0, F.col("size")).otherwise(F.col("size") * 2 / F.col("_span")).alias("size"))


def velocity(track: DataFrame, axes: tuple[str, ...] = ("x",), routes: DataFrame | None = None) -> DataFrame:
    """(scene, entity, t, id, v_<axis>...): change per time to the next point, by axis; beyond 1 all are scaled by the scene's greatest.

    routes (scene, entity, d_<axis>...): a stated way from an origin to a destination, which is the entity's velocity at each of its points
    that has a next one. Points that are grounds (optional column `ground`), not things that move, have none.
    """
    w = Window.partitionBy("scene", "entity").orderBy("t", "id")
    rows = track.where(~F.coalesce("ground", F.lit(False))) if "ground" in track.columns else track
    span = F.nullif(F.lead("t").over(w) - F.col("t"), F.lit(0))
    rows = rows.select("scene", "entity", "t", "id", *[((F.lead(a).over(w) - F.col(a)) / span).alias(f"v_{a}") for a in axes]).where(F.col(f"v_{axes[0]}").isNotNull())
    if routes is not None:
        rows = rows.join(routes, ["scene", "entity"], "left").select("scene", "entity", "t", "id", *[F.coalesce(f"d_{a}", f"v_{a}").alias(f"v_{a}") for a in axes])
    greatest = F.array_max(F.array(*[F.abs(f"v_{a}") for a in axes]))
    most = rows.groupBy(F.col("scene").alias("_scene")).agg(F.max(greatest).alias("_most"))
    scaled = rows.join(most, F.col("scene").eqNullSafe(F.col("_scene")))
    return scaled.select("scene", "entity", "t", "id", *[(F.col(f"v_{a}") / F.greatest(F.lit(1.0), F.col("_most"))).alias(f"v_{a}") for a in axes])


def page_before(posts: DataFrame, before: int | None = None, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Newest page of posts before a time; the limit is clamped to 1..200; total counts the kind without the page."""
    chosen = posts if kind is None else posts.where(F.col("kind") == kind)
    total = chosen.agg(F.count("*").alias("total"))
    page = (chosen if before is None else chosen.where(F.col("date") < before)).orderBy(F.desc("date"), "slug").limit(min(200, max(1, limit)))
    return page.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k").drop("_k")


def history_range(snapshots: DataFrame, frm: int, to: int, limit: int = 200) -> DataFrame:
    """Snapshots between two hours, newest first; the limit is clamped to 1..1000."""
    return snapshots.where(F.col("hour").between(frm, to)).orderBy(F.desc("hour")).limit(min(1000, max(1, limit)))


def recent_activity(actions: DataFrame, n: int = 5) -> DataFrame:
    """Type and status of the newest n actions."""
    return actions.orderBy(F.desc("us"), "event_id").limit(n).select("event_id", "type", "status")


def feed_top(posts: DataFrame, n: int = 50) -> DataFrame:
    """The newest n posts with the time they last changed."""
    return posts.withColumn("modified", F.coalesce("updated", "date")).orderBy(F.desc("date"), "slug").limit(n)


def important_features(features: DataFrame, threshold: int = 10) -> DataFrame:
    """The feature with most alternative names of each (name, type) that has at least the threshold."""
    counted = features.withColumn("names", F.size(F.split("alternatives", ","))).where(F.col("names") >= threshold)
    best = F.row_number().over(Window.partitionBy("name", "type").orderBy(F.desc("names"), "id"))
    return counted.withColumn("_r", best).where("_r = 1").drop("_r", "alternatives")


def rings(rings: DataFrame, edge: DataFrame) -> DataFrame:
    """All rings by sequence, newest first, with the one current edge."""
    return rings.withColumn("_k", F.lit(1)).join(F.broadcast(edge.limit(1).withColumn("_k", F.lit(1))), "_k").drop("_k").orderBy(F.desc("seq"))


def drift_sample(log: DataFrame, n: int = 4, seed: str = "0") -> DataFrame:
    """n rows in the order of a seeded hash: repeatable anywhere."""
    return log.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(seed))), "id").limit(n)


def liveliest(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """(source_id, id): the speaker of the newest unread row, and that speaker's oldest unread row."""
    unread = log.join(cursors, "source_id", "left").where(F.col("us") > F.coalesce("cursor", F.lit(-1)))
    each = unread.groupBy("source_id").agg(F.max("us").alias("newest"), F.min(F.struct("us", "id")).alias("o"))
    return each.orderBy(F.desc("newest"), "source_id").limit(1).select("source_id", F.col("o.id").alias("id"))


def top_candidate(candidates: DataFrame) -> DataFrame:
    """Candidates with status `kept` for the highest urge of each (source, trigger), `superseded` for the rest."""
    r = F.row_number().over(Window.partitionBy("source", "trigger").orderBy(F.desc("urge"), "id"))
    return candidates.withColumn("status", F.when(r == 1, "kept").otherwise("superseded"))


def _at_or_after(actions: DataFrame, keys: list[str], seconds: int) -> tuple[DataFrame, DataFrame]:
    """(node, to) and (node): each action's first one of its key so many seconds later, and the first action of each key.

    actions: (keys, us, id, node). Actions and the times asked for are sorted together in ranges, so a key is as many tasks as it
    fills; what a range does not answer is looked up among the first actions that the key has in later ranges.
    """
    n = int(actions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    action = F.struct("us", "id", "node").alias("action")
    none = F.lit(None)
    both = actions.select(*keys, F.col("us").alias("at"), F.lit(1).alias("kind"), "id", action, none.cast("long").alias("asked"))
    both = both.unionByName(actions.select(*keys, (F.col("us") + seconds * SECOND).alias("at"), F.lit(0).alias("kind"), "id", none.cast(both.schema["action"].dataType).alias("action"), F.col("node").alias("asked")))
    order = ["at", "kind", "id"]
    spread = cut(both.repartitionByRange(n, *keys, *order).withColumn("part", F.spark_partition_id()))
    back = Window.partitionBy("part", *keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    seen = spread.withColumn("to", F.last("action", ignorenulls=True).over(back)).where("asked is not null").select("part", *keys, F.col("asked").alias("node"), F.col("to.node").alias("to"))
    seen = cut(seen)
    firsts = cut(spread.where("action is not null").groupBy("part", *keys).agg(F.min("action").alias("action")))
    later = firsts.select(F.col("part").alias("p"), *[F.col(k).alias(f"_{k}") for k in keys], F.col("action.node").alias("found"))
    open_ = seen.where("to is null").drop("to")
    same = reduce(lambda x, y: x & y, [open_[k].eqNullSafe(later[f"_{k}"]) for k in keys], F.col("p") > F.col("part"))
    answered = open_.join(later, same).groupBy("node").agg(F.min_by("found", "p").alias("to"))
    heads = firsts.groupBy(*keys).agg(F.min("action")["node"].alias("node")).select("node")
    return seen.where("to is not null").select("node", "to").unionByName(answered), heads


def throttle(actions: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """The actions (keys, id) that stay when each must be so many seconds after the last one kept of its key.

    Every action points to the first one of its key that may follow it; what is kept is the chain from each key's first action. Chains are
    followed by pointer doubling: after k rounds their first 2^k actions are known and pointers reach 2^k further, so
    rounds are few however long a chain is, and a key of any size is spread over many tasks. Repeated rows (equal keys, us and id) are one
    action; actions without time are all kept; without a wait all are.
    """
    if seconds <= 0:
        return actions.select(*keys, "id")
    timed = cut(actions.where("us is not null").select(*keys, "us", "id").distinct().withColumn("node", F.monotonically_increasing_id()))
    links, heads = _at_or_after(timed, keys, seconds)
    jump, chain = cut(links), heads
    while True:
        new = cut(chain.join(jump, "node").select(F.col("to").alias("node")))
        if new.isEmpty():
            break
        chain = chain.unionByName(new)
        jump = cut(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
    kept = timed.join(chain, "node", "left_semi").select(*keys, "id")
    return kept.unionByName(actions.where("us is null").select(*keys, "id"))


def session_state(events: DataFrame, tired: int = 7200, quiet: int = 60, fruitless: int = 600) -> DataFrame:
    """(user_id, event_id, state): sleeping after `quiet` seconds without events in a day longer than `tired`, wondering after `fruitless` seconds, else thinking."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    gap = (F.col("us") - F.lag("us").over(w)) / SECOND
    day = (F.col("us") - F.min("us").over(Window.partitionBy("user_id", F.floor(F.col("us") / (86400 * SECOND))).orderBy("us").rowsBetween(Window.unboundedPreceding, 0))) / SECOND
    state = F.when((day > tired) & (gap > quiet), "sleeping").when(gap > fruitless, "wondering").otherwise("thinking")
    return events.select("user_id", "event_id", state.alias("state"))


def grade_directedness(direct: Column, addressed: Column, other_thread: Column, open_exchange: Column) -> Column:
    return F.when(direct, 1.0).when(addressed, 0.9).when(other_thread, 0.15).when(open_exchange, 0.85).otherwise(0.6)


def effective_urge(urge: Column, directedness: Column, self_relevant: Column, exempt: Column) -> Column:
    """urge times directedness; self-relevant triggers count at least 0.9 from 0.6 on; internal and public ones are exempt."""
    d = F.when(self_relevant & (directedness >= 0.6), F.greatest(directedness, F.lit(0.9))).otherwise(directedness)
    return F.when(exempt, urge).otherwise(urge * d)


def feasible(family: Column, has_target: Column, has_material: Column, has_route: Column) -> Column:
    return F.when(family == "internal", 1).when(family == "ledger", has_target.cast("int")).when(family == "post", has_material.cast("int")).otherwise(has_route.cast("int"))


def keep_or_drop(candidates: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Candidates with decision keep, discard or drop: of those that are feasible and urgent enough the highest of a source is kept."""
    good = (F.col("urge") >= threshold) & (F.col("feasible") == 1)
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(good.cast("int")), F.desc("urge"), "id"))
    return candidates.withColumn("decision", F.when(good & (r == 1) & (F.col("action") != "ignore"), "keep").when(good & (r > 1), "discard").otherwise("drop"))


def rule_fanout(triggers: DataFrame, rules: DataFrame) -> DataFrame:
    """One candidate for each enabled rule of a trigger, urge times the trigger's scale."""
    return triggers.join(rules.where("enabled"), "trigger").select("id", "trigger", "action", (F.col("urge") * F.col("scale")).alias("urge"), "order")


def digest_key(premises: Column, rules: Column, teacher: Column) -> Column:
    """What makes conclusions alike: the rules among their premises, else who taught them."""
    shared = F.array_sort(F.array_distinct(F.array_intersect(premises, rules)))
    return F.when(F.size(shared) > 0, F.sha1(F.array_join(shared, "|"))).when(teacher.isNotNull(), F.sha1(F.concat(F.lit("teacher:"), teacher)))


def digest(theorems: DataFrame, cap: int = 40) -> DataFrame:
    """(id, key, role, chapter): the first conclusion of a key posts, repeats are buffered and flushed in chapters of `cap`.

    With a column `session` the end of a session flushes too: a chapter never goes on in the next one.
    """
    w = Window.partitionBy("key").orderBy("created", "id")
    rows = theorems.withColumn("n", F.row_number().over(w))
    role = F.when(F.col("n") == 1, "post").otherwise("buffer")
    if "session" not in theorems.columns:
        return rows.select("id", "key", role.alias("role"), F.when(F.col("n") > 1, F.floor((F.col("n") - 2) / cap).cast("int")).alias("chapter"))
    later = rows.where("n > 1").withColumn("m", F.row_number().over(Window.partitionBy("key", "session").orderBy("created", "id")))
    full = later.withColumn("part", F.floor((F.col("m") - 1) / cap))
    chapter = F.dense_rank().over(Window.partitionBy("key").orderBy("session", "part")) - 1
    return full.select("id", "key", F.lit("buffer").alias("role"), chapter.alias("chapter")).unionByName(rows.where("n = 1").select("id", "key", F.lit("post").alias("role"), F.lit(None).cast("int").alias("chapter")))


def new_turns(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows of the log (id, us, source_id) past the cursor (source_id, us, id) of their speaker; a speaker without one starts at the newest row: nothing is new."""
    c = cursors.select("source_id", F.col("us").alias("_us"), F.col("id").alias("_id"))
    return log.join(c, "source_id").where("us > _us or (us = _us and id > _id)").drop("_us", "_id")


def next_cursors(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """(source_id, us, id): every speaker's newest row, or the old cursor of one who is not in the log."""
    every = log.select("source_id", "us", "id").unionByName(cursors.select("source_id", "us", "id"))
    return every.groupBy("source_id").agg(F.max(F.struct("us", "id")).alias("m")).select("source_id", "m.us", "m.id")
