"""Edits of saved pages with a log and undo, as versions.

Edits and undos of a page follow each other; each makes a version.  An edit's version has as its parent the version that stood before it; an undo makes
no change of its own, it stands for the version before the edits of the action that it undoes.  What a version is differs from the page as first saved by the changes on
the way to it, put together: a later note, status, star or set of tags covers an earlier one, additions to a note follow it.  Between two undos that is a
running sum over the page's events.  Putting changes together is associative, so undos are led to earlier ones by doubling: as many rounds as the longest way of
undos has binary digits, and no such way is walked by one task.  Edits, which are most rows, are shuffled for their order and to meet their undo.

An action may hold several edits, which are undone together.  Only the first undo of an action counts, and only one that comes after it, by its own user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.texts import merge_note
from quire.functions.texts import tags as tag_list
from quire.sources.scratch import written

FIELDS = ("note", "status", "reference", "tags")
BASE = -1


def ordered(edits: DataFrame, undos: DataFrame) -> DataFrame:
    """(link_id, user_id, event_id, back_to, changes) of all that counts: ``back_to`` is the edit before which an undo goes back, null for edits."""
    own = edits.select("link_id", "user_id", "event_id", "action_id", "at", *FIELDS, "more")
    first = Window.partitionBy("action_id").orderBy("at", "event_id")
    begun = own.groupBy("action_id", "user_id").agg(F.max("at").alias("done"))
    valid = undos.join(begun, ["action_id", "user_id"]).where(F.col("at") > F.col("done")).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    # of several edits of a page in one action, the first is what its undo goes back before
    targets = own.groupBy("action_id", "link_id").agg(F.min_by("event_id", F.struct("at", "event_id")).alias("back_to"))
    back = valid.select("user_id", "event_id", "action_id", "at").join(targets, "action_id")
    return own.unionByName(back, allowMissingColumns=True)


def versions(rows: DataFrame) -> DataFrame:
    """(link_id, user_id, event_id, action_id, at, parent, back_to, head, run, parent_head, parent_run): parent is the event before, BASE for none.

    An edit goes on from the event before it, so the events from one undo (``head``, BASE for none) to the next are a run, and ``run`` is what the run's edits
    up to this one change together.  Later events only ever point to earlier ones.
    """
    before = Window.partitionBy("link_id").orderBy("at", "event_id")
    head = F.coalesce(F.last(F.when(F.col("back_to").isNotNull(), F.col("event_id")), True).over(before), F.lit(BASE))
    ran = Window.partitionBy("link_id", "head").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = Window.partitionBy("link_id", "head", "notes").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    more = F.collect_list(F.when(F.col("note").isNull(), F.col("more"))).over(since)
    run = F.struct(*[F.last(f, True).over(ran).alias(f) for f in FIELDS], more.alias("more"))
    told = rows.withColumn("head", head).withColumn("notes", F.count("note").over(ran)).withColumn("run", run)
    back = [F.lag(c).over(before) for c in ("event_id", "head", "run")]
    return told.select("link_id", "user_id", "event_id", "action_id", "at", F.coalesce(back[0], F.lit(BASE)).alias("parent"), "back_to", "head", "run", F.coalesce(back[1], F.lit(BASE)).alias("parent_head"), back[2].alias("parent_run"))


def after(first: Column, second: Column) -> Column:
    """Two changes as one."""
    fields = [F.coalesce(second[f], first[f]).alias(f) for f in FIELDS]
    more = F.when(second["note"].isNotNull(), second["more"]).otherwise(F.concat(first["more"], second["more"]))
    return F.struct(*fields, more.alias("more"))


def put_on(first: Column, second: Column) -> Column:
    """Two changes as one, where either may be null for none."""
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(after(first, second))


def resolved(known: DataFrame) -> DataFrame:
    """(link_id, head, change, change_before): what the page differs from its first version in after each undo, and just before it.

    An undo's way goes on from the parent of the edit that it goes back before, through that one's run to the undo at its head; so only undos are led
    to each other, and edits are put on by their runs.
    """
    undos = known.where("back_to is not null").select("link_id", "event_id", "back_to", "parent_head", "parent_run")
    parents = known.select("link_id", F.col("event_id").alias("back_to"), F.col("parent_head").alias("to"), F.col("parent_run").alias("change"))
    nodes = written(undos.join(parents, ["link_id", "back_to"], "left").withColumn("to", F.coalesce("to", F.lit(BASE))), "undos")
    way = written(nodes.select("link_id", "event_id", "to", "change"), "ways")
    while way.where(F.col("to") != BASE).limit(1).count():
        upper = way.select("link_id", F.col("event_id").alias("to"), F.col("to").alias("further"), F.col("change").alias("earlier"))
        joined = way.join(upper, ["link_id", "to"], "left")
        way = written(joined.select("link_id", "event_id", F.coalesce("further", F.lit(BASE)).alias("to"), put_on(F.col("earlier"), F.col("change")).alias("change")), "ways")
    upper = way.select("link_id", F.col("event_id").alias("parent_head"), F.col("change").alias("earlier"))
    until = nodes.select("link_id", "event_id", "parent_head", "parent_run").join(upper, ["link_id", "parent_head"], "left")
    until = until.select("link_id", "event_id", put_on(F.col("earlier"), F.col("parent_run")).alias("change_before"))
    return way.select("link_id", "event_id", "change").join(until, ["link_id", "event_id"]).withColumnRenamed("event_id", "head")


def image(change: Column) -> Column:
    """A page after a change: its own fields where the change has none."""
    note = F.aggregate(F.coalesce(change["more"], F.array().cast("array<string>")), F.coalesce(change["note"], F.col("old_note")), lambda held, new: merge_note(held, new))
    tags = F.when(change["tags"].isNotNull(), F.array_sort(tag_list(change["tags"]))).otherwise(F.col("old_tags"))
    return F.struct(
        F.nullif(note, F.lit("")).alias("note"), F.coalesce(change["status"], F.col("old_status")).alias("status"), F.coalesce(change["reference"], F.col("old_reference")).alias("reference"), F.array_join(tags, ",").alias("tags")
    )


def logged(pages: DataFrame, edits: DataFrame, undos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages as they stand after all edits and undos, and the log: a row an event with what stood before it and after it.

    pages (link_id, user_id, note, status, reference, tags as a sorted array); edits (event_id, action_id, link_id, user_id, at, note, more, status, reference, tags), where null leaves a
    field as it is and ``more`` is added to the note; undos (event_id, action_id, user_id, at).  Edits of pages of other users do not count.
    """
    own = edits.join(pages.select("link_id", "user_id"), ["link_id", "user_id"], "left_semi")
    known = written(versions(ordered(own, undos)), "versions")
    made = written(resolved(known), "changes")
    old = pages.select("link_id", F.col("note").alias("old_note"), F.col("status").alias("old_status"), F.col("reference").alias("old_reference"), F.col("tags").alias("old_tags"))
    # an edit's parent is in its run, only an undo's is not
    until = F.when(F.col("back_to").isNotNull(), F.col("change_before")).otherwise(put_on(F.col("change"), F.col("parent_run")))
    told = known.join(made, ["link_id", "head"], "left")
    rows = told.select("link_id", "user_id", "event_id", "action_id", "back_to", until.alias("until"), put_on(F.col("change"), F.col("run")).alias("so_far")).join(old, "link_id")
    undone = known.where("back_to is not null").select("action_id", F.lit(True).alias("undone")).distinct()
    log = rows.join(undone, "action_id", "left").select(
        "link_id", "user_id", "event_id", F.when(F.col("back_to").isNull(), "link.update").otherwise("undo").alias("action"), image(F.col("until")).alias("before"), image(F.col("so_far")).alias("after"),
        (F.col("back_to").isNull() & F.coalesce("undone", F.lit(False))).alias("undone"),
    )
    last = known.groupBy("link_id").agg(F.max_by(F.struct("head", "run"), F.struct("at", "event_id")).alias("last")).select("link_id", "last.*")
    end = last.join(made.select("link_id", "head", "change"), ["link_id", "head"], "left").select("link_id", put_on(F.col("change"), F.col("run")).alias("change"))
    now = old.join(end, "link_id", "left").select("link_id", image(F.col("change")).alias("state"))
    return now.select("link_id", "state.*"), log


def flat(log: DataFrame) -> DataFrame:
    """The log with its images as plain columns and the names of the fields that changed."""
    changed = F.array_compact(F.array(*[F.when(~F.equal_null(F.col(f"before.{f}"), F.col(f"after.{f}")), F.lit(f)) for f in FIELDS]))
    return log.select("event_id", "link_id", "action", "undone", *[F.col(f"{side}.{f}").alias(f"{f}_{side}") for side in ("before", "after") for f in FIELDS], F.array_join(changed, ", ").alias("changed"))
