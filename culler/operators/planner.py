"""Verification, planning, selection and execution of removals, as functions of DataFrames.

Nothing here touches a file store: states are snapshots, and applying a plan yields new memberships, an audit trail
and ledger rows. Joins are by id or group and may be split or broadcast by the engine as it sees fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from culler import schemas
from culler.functions.errors import is_global, is_not_found
from culler.functions.fields import missing, to_int
from culler.functions.render import created_key, owner_text, shown_name, status_label
from culler.operators.stage import stored

_yes = lambda c: F.coalesce(c, F.lit(False))
_PROTECTED = ("skip_asli", "skip_group_survivor", "skip_user_keep")


def dedup_entries(entries: DataFrame, protect_asli_ids: bool = False) -> DataFrame:
    """The first line of each (grp, id, parent); with protect_asli_ids, also no duplicate whose id is an original elsewhere."""
    key = F.struct("role", "match", "b3", "size", "w", "h", "name")
    one = entries.groupBy("grp", "id", "parent").agg(F.min("line_no").alias("line_no"), F.min_by(key, "line_no").alias("e")).select("line_no", "e.role", "grp", "id", "parent", *[f"e.{c}" for c in ("match", "b3", "size", "w", "h", "name")])
    if not protect_asli_ids:
        return one
    originals = entries.filter("role = 'ASLI'").select("id").distinct()
    return one.filter("role = 'ASLI'").unionByName(one.filter("role <> 'ASLI'").join(originals, "id", "left_anti").select(one.columns))


def with_state(entries: DataFrame, state: DataFrame) -> DataFrame:
    """Entries with the state of their file as struct `m`; null where the store told nothing."""
    s = state.select(F.col("id"), F.struct("err", "parents", "owned_by_me", "capabilities", "size", "trashed", "view_link", "created_time", "cur_b3").alias("m"))
    return entries.join(s, "id", "left")


def _has_meta() -> Column:
    return F.col("m").isNotNull() & F.col("m.err").isNull()


def _attached() -> Column:
    return _yes(F.array_contains("m.parents", F.col("parent")))


def _sizes_differ() -> Column:
    return _yes(to_int(F.col("size")) != to_int(F.col("m.size")))


def cascade(strict: bool) -> Column:
    """Status of an entry with state: the first condition that holds decides."""
    unknown = to_int(F.col("size")).isNull() | to_int(F.col("m.size")).isNull()
    caps = F.col("m.capabilities")
    c = (
        F.when(F.col("role") == "ASLI", "skip_asli")
        .when(missing(F.col("parent")).isNull(), "skip_no_parent_in_report")
        .when(~_has_meta() & is_not_found(F.col("m.err")), "skip_not_found")
        .when(~_has_meta(), F.concat(F.lit("error_meta:"), F.coalesce(F.col("m.err"), F.lit("fatal:no_state:"))))
        .when(_yes(F.col("m.trashed")), "skip_trashed")
        .when(~_attached(), "skip_already_out")
        .when(_sizes_differ(), "skip_changed_size")
    )
    if strict:
        c = c.when(missing(F.col("b3")).isNull(), "skip_strict_need_b3").when(F.col("m.cur_b3").isNull(), "skip_b3_unavailable").when(F.col("m.cur_b3") != F.col("b3"), "skip_changed_b3")
    else:
        c = c.when(unknown, "skip_unverifiable_need_strict")
    return c.when(~F.coalesce(caps["can_remove_children"], F.lit(True)) & ~F.coalesce(caps["can_edit"], F.lit(True)), "skip_no_permission").otherwise("ready")


def _anchor() -> Column:
    """An original that is still attached, not in the bin and not known to differ in size."""
    return (F.col("role") == "ASLI") & missing(F.col("parent")).isNotNull() & _has_meta() & ~_yes(F.col("m.trashed")) & _attached() & ~_sizes_differ()


def live_anchors(joined: DataFrame) -> DataFrame:
    """(grp, anchors): live originals of each group that has any."""
    return joined.filter(_anchor()).groupBy("grp").agg(F.count(F.lit(1)).alias("anchors"))


def verify(entries: DataFrame, state: DataFrame, strict: bool = False) -> DataFrame:
    """Entries with status, owned_by_me, view_link and created_time, before the survivor rule."""
    return with_state(entries, state).withColumn("status", cascade(strict))


def plan(entries: DataFrame, state: DataFrame, strict: bool = False, watch_abort: bool = True) -> DataFrame:
    """Every visible entry with its final status; `aborted` is true throughout if a failure for all cut the plan short.

    Entries meet the state once and are written with their first status; the rest reads that table. The survivor of a
    group without a live original is the oldest of its ready rows (created, id, line). It is found by an aggregation with
    map-side minima, so one group may hold any share of the rows.
    """
    asli = (F.col("role") == "ASLI") & missing(F.col("parent")).isNotNull() & is_global(F.col("m.err"))
    v = verify(entries, state, strict).select("line_no", "role", "grp", "id", "parent", "match", "b3", "size", "w", "h", "name", "status", _yes(F.col("m.owned_by_me")).alias("owned_by_me"), missing(F.col("m.view_link")).alias("view_link"), missing(F.col("m.created_time")).alias("created_time"), _anchor().alias("anchor"), F.when(asli, F.lit(-1)).when(F.col("status").startswith("error_meta:") & is_global(F.col("m.err")), F.col("line_no")).alias("stops"))
    v = stored(v)
    order = F.struct(created_key(F.col("created_time")), F.coalesce("id", F.lit("")), "line_no")
    ready = F.col("status") == "ready"
    oldest = v.filter(ready | F.col("anchor")).groupBy("grp").agg(F.max(F.col("anchor")).alias("anchored"), F.min_by("line_no", F.when(ready, order)).alias("kept_line")).filter("NOT anchored").select("grp", "kept_line")
    out = v.join(oldest, "grp", "left")
    stop = F.lit(None).cast("bigint")
    if watch_abort:
        out = out.crossJoin(F.broadcast(v.agg(F.min("stops").alias("stop"))))  # one row
        stop = F.col("stop")
    out = out.filter(stop.isNull() | (F.col("line_no") <= stop))
    status = F.when(stop.isNull() & (F.col("status") == "ready") & (F.col("line_no") == F.col("kept_line")), "skip_group_survivor").otherwise(F.col("status"))
    return out.select("line_no", "role", "grp", "id", "parent", "match", "b3", "size", "w", "h", "name", status.alias("status"), "owned_by_me", "view_link", "created_time", stop.isNotNull().alias("aborted"))


def select_all(plan_: DataFrame) -> DataFrame:
    """Rows to execute; none if the plan was cut short."""
    return plan_.filter("status = 'ready' AND NOT aborted")


def select_except(plan_: DataFrame, keep: DataFrame) -> DataFrame:
    """The plan with kept ids marked. A list with an original is refused whole; unknown ids do nothing."""
    k = keep.select("id").distinct()
    if not plan_.filter("role = 'ASLI'").join(k, "id", "left_semi").isEmpty():
        raise ValueError("the list names originals, which are never removed")
    marked = plan_.join(k.withColumn("kept", F.lit(True)), "id", "left")
    return marked.withColumn("status", F.when((F.col("status") == "ready") & F.col("kept"), "skip_user_keep").otherwise(F.col("status"))).select(plan_.columns)


def select_manual(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries of the ids named, with a parent; they bypass the plan, not the checks of the execution."""
    return entries.filter(missing(F.col("parent")).isNotNull()).join(ids.select("id").distinct(), "id", "left_semi").select(entries.columns)


def execute(rows: DataFrame, state: DataFrame, ledger: DataFrame | None = None, updates: DataFrame | None = None) -> DataFrame:
    """Result of applying rows (line_no, id, parent, ...) to a fresh state: status, parents_before, parents_after, orphan.

    With a ledger, ids in it come out as `resumed` and nothing is done. updates (id, parent, err) tells what the store
    said to the removal itself; no row or a null err is success. The second row of one (id, parent) finds the file already
    out. After the first failure for all, nothing further is tried. Rows meet the state once, in a table that is written.
    """
    j = with_state(rows, state)
    done, failed = F.lit(False), F.lit(None).cast("string")
    if ledger is not None:
        j = j.join(ledger.select("id").distinct().withColumn("in_ledger", F.lit(True)), "id", "left")
        done = _yes(F.col("in_ledger"))
    if updates is not None:
        j = j.join(updates.filter("err IS NOT NULL").groupBy("id", "parent").agg(F.min("err").alias("update_err")), ["id", "parent"], "left")
        failed = F.col("update_err")
    j = stored(j.select("line_no", "grp", "id", "parent", "name", done.alias("done"), failed.alias("failed"), _has_meta().alias("known"), F.coalesce("m.err", F.lit("fatal:no_state:")).alias("err"), _attached().alias("attached"), F.size(F.array_distinct("m.parents")).alias("n_parents"), "m.parents"))
    first = j.groupBy("id", "parent").agg(F.min("line_no").alias("first_line"))
    lost = F.concat(F.when(is_global(F.col("err")), "error_remove:").otherwise("error_remove:meta "), F.col("err"))
    later = (F.col("line_no") > F.col("first_line")) & (F.col("n_parents") == 1) & F.col("failed").isNull()
    status = (
        F.when(F.col("done"), "resumed")
        .when(~F.col("known"), lost)
        .when(~F.col("attached") | later, "skip_already_out")
        .when(F.col("n_parents") > 1, "skip_multi_parent")
        .when(F.col("failed").isNotNull(), F.concat(F.lit("error_remove:"), F.col("failed")))
        .otherwise("removed")
    )
    out = j.join(first, ["id", "parent"], "left").withColumn("status", status)
    # a failure for all is told by the row alone: its state is unknown, or it was to be removed and the store refused
    refused = F.col("known") & F.col("attached") & (F.col("n_parents") == 1) & is_global(F.col("failed"))
    stop = j.filter(~F.col("done") & (~F.col("known") & is_global(F.col("err")) | refused)).agg(F.min("line_no").alias("stop"))
    out = out.crossJoin(F.broadcast(stop)).filter("stop IS NULL OR line_no <= stop")
    after = F.when(F.col("status") == "removed", F.filter("parents", lambda x: x != F.col("parent")))
    return out.select("line_no", "grp", "id", "parent", "name", "status", F.when(F.col("status") == "removed", F.col("parents")).alias("parents_before"), after.alias("parents_after"), (F.size(after) == 0).alias("orphan"))


def membership_after(membership: DataFrame, results: DataFrame) -> DataFrame:
    return membership.join(results.filter("status = 'removed'").select("id", "parent"), ["id", "parent"], "left_anti")


def audit_events(results: DataFrame) -> DataFrame:
    """A reversible record of every removal."""
    return results.filter("status = 'removed'").select(F.col("id").alias("file"), "name", F.col("parent").alias("removed_parent"), "parents_before", "parents_after", "orphan")


def audit_header(spark, entries: DataFrame, actor: str, report_name: str, report_id: str, report_hash: str, folder_id: str, strict: bool) -> DataFrame:
    s = summary(entries)
    fixed = dict(actor=actor, report_name=report_name, report_id=report_id, report_hash=report_hash, folder_id=folder_id, strict=strict)
    return s.select(*[F.lit(v).alias(k) for k, v in fixed.items()], "asli", "dup", "mode")


def ledger_rows(results: DataFrame, key: str) -> DataFrame:
    """What a later run need not try again: removed, already out, several parents; failures are tried again."""
    return results.filter(F.col("status").isin("removed", "skip_already_out", "skip_multi_parent")).select(F.lit(key).alias("key"), "id", "status", F.current_timestamp().alias("ts"), "orphan", F.col("parents_before").alias("parents"))


def summary(entries: DataFrame) -> DataFrame:
    """asli, dup, dup_bytes, mode, and whether a strict run asks first."""
    dup = F.col("role") != "ASLI"
    s = entries.agg(F.count_if(F.col("role") == "ASLI").alias("asli"), F.count_if(dup).alias("dup"), F.coalesce(F.sum(F.when(dup, to_int(F.col("size")))), F.lit(0)).alias("dup_bytes"))
    return s.withColumn("mode", F.when(F.col("asli") + F.col("dup") >= schemas.BATCH_FROM, "batch").otherwise("interactive")).withColumn("strict_asks", F.col("dup") > schemas.STRICT_ASKS_ABOVE)


def status_histogram(plan_: DataFrame) -> DataFrame:
    return plan_.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("label", status_label(F.col("status")))


def outcome(results: DataFrame) -> DataFrame:
    s = F.col("status")
    return results.agg(F.count_if(s == "removed").alias("ok"), F.count_if(s.startswith("error_remove")).alias("failed"), F.count_if(s.startswith("skip_") | (s == "resumed")).alias("skipped"), F.count_if(_yes(F.col("orphan"))).alias("orphaned"))


def plan_table(plan_: DataFrame) -> DataFrame:
    """The plan in words. Order by the sort_ columns: groups by number, then by name; removals before skips, by line."""
    ready = F.col("status") == "ready"
    note = F.when(ready, F.concat(F.lit("→ dikeluarkan ("), owner_text(F.col("owned_by_me")), F.lit(")"))).otherwise(status_label(F.col("status")))
    mark = F.when(ready, "○").when(F.col("status").isin(*_PROTECTED), "●").otherwise("·")
    number = F.col("grp").try_cast("bigint")
    return plan_.select(number.isNull().alias("sort_text"), number.alias("sort_number"), F.col("grp").alias("sort_grp"), (~ready).alias("sort_skip"), F.col("line_no").alias("sort_line"), mark.alias("mark"), shown_name(F.col("name")).alias("shown"), note.alias("note"))


def group_summary(plan_: DataFrame) -> DataFrame:
    """One row for each group: rows, rows to remove, rows kept or skipped, first line."""
    ready = F.col("status") == "ready"
    return plan_.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(ready).alias("n_remove"), F.count_if(~ready).alias("n_skip"), F.min("line_no").alias("first_line"))


def id_sets(known: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids given that are known, and those that aren't."""
    g = given.select("id").distinct()
    return g.join(known.select("id").distinct(), "id", "left_semi"), g.join(known.select("id").distinct(), "id", "left_anti")


def sorted_ids(ids: DataFrame) -> DataFrame:
    """One row `ids`: the distinct ids, sorted, for a message about a list that somebody gave."""
    return ids.agg(F.array_join(F.array_sort(F.collect_set("id")), ", ").alias("ids"))


def manual_summary(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """One row about ids named by hand: rows that would go, originals among them, rows without a parent, ids not in the report."""
    named = entries.join(ids.select("id").distinct(), "id", "left_semi")
    has = missing(F.col("parent")).isNotNull()
    unknown = id_sets(entries, ids)[1].agg(F.count(F.lit(1)).alias("unknown"))
    return named.agg(F.count_if(has).alias("n"), F.count_if(has & (F.col("role") == "ASLI")).alias("asli"), F.count_if(~has).alias("no_parent")).crossJoin(F.broadcast(unknown))  # one row each


def guard_strict(entries: DataFrame, strict: bool, allow_large_strict: bool = False) -> DataFrame:
    """The entries; refuses a strict run over many duplicates, each of which would be read in full, unless it is allowed."""
    if strict and not allow_large_strict and summary(entries).first()["strict_asks"]:
        raise ValueError(f"more than {schemas.STRICT_ASKS_ABOVE} duplicates: a strict run reads each in full; pass allow_large_strict")
    return entries
