"""Error classes of calls to the file store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from culler.schemas import ATTEMPTS, BACKOFF

# Marks of exhausted quotas, marks of passing rate limits, codes worth another try.
QUOTA = ("dailylimitexceeded", "daily limit", "quotaexceeded", "quota exceeded", "limitexceeded", "storagequota")
RATE_EXCEEDED = ("ratelimitexceeded", "userratelimitexceeded")
RATE_LIMIT = ("ratelimit", "userratelimit")
AGAIN = (408, 429, 500, 502, 503, 504)


def _has(c: Column, marks: tuple[str, ...]) -> Column:
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(False)
    for m in marks:
        out = out | low.contains(m)
    return out


def classify_error(code: Column, reason: Column) -> Column:
    """recoverable, fatal or fatal_global."""
    return (
        F.when((code == 403) & _has(reason, QUOTA), F.when(_has(reason, RATE_EXCEEDED), "recoverable").otherwise("fatal_global"))
        .when(code == 403, F.when(_has(reason, RATE_LIMIT), "recoverable").otherwise("fatal"))
        .when(code == 401, "fatal_global")
        .when(code.isin(*AGAIN), "recoverable")
        .otherwise("fatal")
    )


def error_text(code: Column, reason: Column) -> Column:
    return F.concat(classify_error(code, reason), F.lit(":http_"), code.cast("string"), F.lit(":"), F.substring(F.coalesce(reason, F.lit("")), 1, 140))


def exception_text(message: Column, last: Column) -> Column:
    """Error text of a call that raised: worth another try, except on the last."""
    return F.concat(F.when(last, "fatal").otherwise("recoverable"), F.lit(":exc:"), message)


def call_result(attempts: Column, most: int = ATTEMPTS) -> Column:
    """Struct tries, err of a call, from its attempts: an array of (code, reason, exc), all null where one succeeded.

    Only recoverable errors are tried again, `most` times in all; err is null after a success.
    """
    tried = F.slice(attempts, 1, most)
    over = lambda a: a["exc"].isNull() & (a["code"].isNull() | (classify_error(a["code"], a["reason"]) != "recoverable"))
    first = F.array_position(F.transform(tried, over), F.lit(True)).cast("int")
    tries = F.when(first > 0, first).otherwise(F.size(tried))
    end = F.element_at(tried, tries)
    err = F.when(end["exc"].isNotNull(), exception_text(end["exc"], F.lit(True))).when(end["code"].isNotNull(), error_text(end["code"], end["reason"]))
    return F.struct(tries.alias("tries"), err.alias("err"))


def is_not_found(err: Column) -> Column:
    return F.coalesce(err.contains("http_404"), F.lit(False))


def is_global(err: Column) -> Column:
    return F.coalesce(err.startswith("fatal_global"), F.lit(False))


def backoff_seconds(attempt: Column) -> tuple[Column, Column]:
    """Least and most seconds to wait after an attempt (from 0); up to half is added at random."""
    base = F.element_at(F.array(*[F.lit(float(x)) for x in BACKOFF]), F.least(attempt, F.lit(len(BACKOFF) - 1)).cast("int") + 1)
    return base, base * 1.5
