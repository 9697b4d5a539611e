"""As-of lookup: for each request, the latest fact dated on or before its date.

Requests and facts are one table, dealt by key and ordered by day, facts before
requests of the same day; the running maximum of (date, tie-break, record) over
a key's rows is the latest fact so far, and the requests keep it. Facts and
requests move once: no request list is made distinct, joined back or multiplied.

Optional keys (filter only when the request gives a value) give one running
maximum per null pattern. All of them hold the required keys, so the rows that
are dealt by those serve every pattern; a request takes the one of its own.
A frame keeps one record at a time, and a key's rows go to disk beyond the
window's buffer, so a hot key costs time and not memory.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product as cartesian

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.aggregates import arg_max

_DAY = "_asof_day"
_KIND = "_asof_kind"
_REC = "_asof_rec"
_ASKED = "_asof_asked"


@dataclass
class Facts:
    """What one look-up searches; see ``latest_asof``."""

    frame: DataFrame
    date: str
    values: list[str]
    tiebreak: list[str] | None = None
    optional_keys: list[str] = ()
    keys: dict[str, str] | None = None  # request key -> fact column when names differ
    alias: str = "latest"


def latest_asof(requests: DataFrame, facts: DataFrame, *, keys: list[str], request_date: str,
                fact_date: str, values: list[str], tiebreak: list[str] | None = None,
                optional_keys: list[str] = (), strict: bool = False,
                fact_keys: dict[str, str] | None = None, alias: str = "latest",
                request_keys: DataFrame | None = None) -> DataFrame:
    """Attach struct column ``alias`` (fields ``values``) = latest matching fact or null.

    ``keys`` must match when given; ``optional_keys`` match only when the
    request's value is not null. ``fact_keys`` renames request key -> fact
    column when names differ. ``strict`` asks for facts strictly before the
    request date. Ties on the date are broken by ``tiebreak`` (highest wins).
    ``request_keys`` is accepted for callers that have the key columns apart; one
    pass over ``requests`` needs no second frame.
    """
    return latest_asof_each(requests, [Facts(facts, fact_date, values, tiebreak, optional_keys, fact_keys, alias)],
                            keys=keys, request_date=request_date, strict=strict)


def latest_asof_each(requests: DataFrame, lookups: list[Facts], *, keys: list[str], request_date: str, strict: bool = False) -> DataFrame:
    """Several look-ups by the same ``keys`` and date at once: the requests move once for all of them."""
    optional = list(dict.fromkeys(k for f in lookups for k in f.optional_keys))
    all_keys = [*keys, *optional]
    day = F.col(request_date).cast("date")
    asked = F.struct(*[F.col(f"`{c}`") for c in requests.columns])
    both = requests.select(*[F.col(k).alias(f"_asof_{k}") for k in all_keys], (F.date_sub(day, 1) if strict else day).alias(_DAY),
                           F.lit(1).alias(_KIND), asked.alias(_ASKED))
    for m, f in enumerate(lookups):
        names, mine = f.keys or {}, [*keys, *f.optional_keys]
        record = F.struct(*[F.col(names.get(v, v)).alias(v) if v in mine else F.col(v) for v in f.values])
        order = [F.col(f.date), *[F.col(names.get(t, t)) for t in (f.tiebreak or []) if t != f.date]]
        best = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], record.alias("v"))
        past = f.frame.where(F.col(f.date).isNotNull())
        for k in keys:
            past = past.where(F.col(names.get(k, k)).isNotNull())
        past = past.select(*[F.col(names.get(k, k)).alias(f"_asof_{k}") for k in mine], F.col(f.date).cast("date").alias(_DAY),
                           F.lit(0).alias(_KIND), best.alias(f"{_REC}{m}"))
        both = both.unionByName(past, allowMissingColumns=True)
    # Few keys first: rows that are together by ``keys`` are together by more keys too, so they move once.
    choices: dict[int, Column] = {}
    for n, pattern in enumerate(sorted(cartesian([True, False], repeat=len(optional)), key=sum)):
        given = [k for k, on in zip(optional, pattern) if on]
        w = (Window.partitionBy(*[f"_asof_{k}" for k in [*keys, *given]]).orderBy(_DAY, _KIND)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        here = [m for m, f in enumerate(lookups) if set(given) <= set(f.optional_keys)]
        both = both.withColumns({f"{_REC}{m}_{n}": F.max(f"{_REC}{m}").over(w) for m in here})
        for m in here:
            cond = F.col(_DAY).isNotNull()
            for k in [*keys, *given]:
                cond = cond & F.col(f"_asof_{k}").isNotNull()
            for k in lookups[m].optional_keys:
                if k not in given:
                    cond = cond & F.col(f"_asof_{k}").isNull()
            found = F.col(f"{_REC}{m}_{n}.v")
            choices[m] = F.when(cond, found) if m not in choices else choices[m].when(cond, found)
    return both.where(F.col(_KIND) == 1).select(*[F.col(f"{_ASKED}.`{c}`") for c in requests.columns],
                                                *[choices[m].alias(f.alias) for m, f in enumerate(lookups)])


def flatten(df: DataFrame, struct_col: str, prefix: str) -> DataFrame:
    """Expand a struct column into ``prefix + field`` columns."""
    fields = df.schema[struct_col].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c != struct_col],
                     *[F.col(f"{struct_col}.{f}").alias(prefix + f) for f in fields])


def max_by_key(df: DataFrame, keys: list[str], order: list[str | Column], alias: str = "latest") -> DataFrame:
    """Newest row per key as a struct (``active_model``-style lookups), partial aggregation."""
    others = [c for c in df.columns if c not in keys]
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    return df.groupBy(*keys).agg(arg_max(F.struct(*others), cols).alias(alias))
