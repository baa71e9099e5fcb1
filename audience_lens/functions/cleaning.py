"""Column functions for typing and normalising raw values (all lenient: bad -> NULL)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from audience_lens.config import EVENT_PAGES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Trim spaces; an empty string becomes NULL."""
    return F.nullif(F.trim(_col(c).cast("string")), F.lit(""))


def title_case(c: Column | str) -> Column:
    return F.initcap(F.trim(_col(c)))


def default_if_blank(c: Column | str, default: str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))


def to_bool(c: Column | str) -> Column:
    """'true' in any case is true, any other value false, NULL stays NULL."""
    return F.lower(_col(c).cast("string")) == "true"


def to_timestamp_lenient(c: Column | str) -> Column:
    """Wall-clock timestamp without zone, so that day boundaries need no session zone."""
    return _col(c).try_cast("timestamp_ntz")


def to_date_lenient(c: Column | str) -> Column:
    return _col(c).try_cast("date")


def to_number_lenient(c: Column | str, to: str) -> Column:
    return _col(c).try_cast(to)


def moment(at: dt.datetime) -> Column:
    """Literal wall-clock timestamp; no zone of client or session is involved."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def clock(ts: Column | str) -> Column:
    """Wall-clock timestamp as text, to the second."""
    return F.substring(_col(ts).cast("string"), 1, 19)


def lower_trim(c: Column | str) -> Column:
    return F.lower(F.trim(_col(c)))


def known_event_type(c: Column | str) -> Column:
    return _col(c).isin(*EVENT_PAGES)


def money(c: Column | str, scale: int = 4) -> Column:
    """Exact decimal of a double amount: sums no longer depend on row order."""
    return _col(c).cast(f"decimal(18,{scale})")
