"""Column expressions that put values into words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from culler.functions.fields import missing, to_int
from culler.schemas import META_FAILED, NEVER, REMOVE_FAILED, STATUS_LABEL, VIEW_LINK


def human_bytes(n: Column) -> Column:
    x, out = n.cast("double"), None
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        said = F.format_string(f"%.2f {unit}", x / 1024.0**i)
        out = F.when((n.isNull()) | (n == 0), "—").when(x < 1024, said) if out is None else out.otherwise(said) if unit == "TB" else out.when(x < 1024.0 ** (i + 1), said)
    return out


def resolution(w: Column, h: Column) -> Column:
    w, h = to_int(w), to_int(h)
    return F.when((w > 0) & (h > 0), F.concat(w.cast("string"), F.lit(" x "), h.cast("string"), F.lit(" px"))).otherwise("—")


def status_label(status: Column) -> Column:
    third = F.substring(F.element_at(F.split(status, ":", 3), -1), 1, 80)
    table = F.create_map(*[F.lit(x) for kv in STATUS_LABEL.items() for x in kv])
    return F.when(status.startswith("error_meta"), F.concat(F.lit(META_FAILED), third)).when(status.startswith("error_remove"), F.concat(F.lit(REMOVE_FAILED), third)).otherwise(F.coalesce(F.try_element_at(table, status), status))


def view_link(id_: Column, link: Column | None = None) -> Column:
    made = F.concat(F.lit(VIEW_LINK[0]), id_, F.lit(VIEW_LINK[1]))
    return made if link is None else F.coalesce(missing(link), made)


def shown_name(name: Column) -> Column:
    return F.substring(F.coalesce(missing(name), F.lit("(tanpa nama)")), 1, 42)


def short_name(name: Column, id_: Column) -> Column:
    return F.substring(F.coalesce(missing(name), id_, F.lit("")), 1, 40)


def owner_text(mine: Column) -> Column:
    return F.when(F.coalesce(mine, F.lit(False)), "milik Anda").otherwise("milik orang lain")


def created_key(created: Column) -> Column:
    return F.coalesce(missing(created), F.lit(NEVER))


def checkpoint_key(report_md5: Column, folder_id: Column) -> Column:
    return F.concat_ws("_", report_md5, F.coalesce(missing(folder_id), F.lit("nofolder")))
