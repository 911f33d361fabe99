"""Staging text -> clean typed shipment table.

Steps (all narrow projections of one stage, except the imputation mean):

1. labels: ``TRIM``, blank -> ``UNKNOWN`` (id, origin, destination, carrier, status);
2. dates / numbers: ``TRIM``, strip thousands separators, blank -> NULL, cast to the clean type
   (the decimal cast rounds half away from zero to the column scale);
3. ``transit_days`` is replaced by ``delivery_date - shipment_date`` whenever the delivery
   date is present (it may be negative; nothing checks it);
4. a missing cost is filled with the mean of the known costs, rounded to the cost scale.
   The mean is a one-row global aggregate used as a scalar subquery (no join).

``mode="strict"`` reproduces a typed insert: a malformed value or a missing ship date fails the
job (checked explicitly, so it does not depend on ANSI mode). ``mode="quarantine"`` (default)
keeps the job running: such rows are set aside with a reason (see ``quarantine_rows``) and
excluded from the clean table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.kpi import MONEY, SUM_COST, ratio
from ..functions.parse import blank_to_null, parse_date, parse_decimal, parse_int, text_or_unknown
from ..sources import store
from ..sources.files import MALFORMED
from ..sources.schema import CLEAN_COLUMNS, COST_TYPE, DISTANCE_TYPE, UNKNOWN, WEIGHT_TYPE

LABELS = ("shipment_id", "origin_warehouse", "destination", "carrier", "status")
_NUMERIC = {"weight_kg": WEIGHT_TYPE, "cost": COST_TYPE, "distance_miles": DISTANCE_TYPE}


def _fields(staging: DataFrame) -> list[str]:
    """The staging columns without the reader's column of malformed records."""
    return [n for n in staging.columns if n != MALFORMED]


def _normalised(staging: DataFrame, keep: tuple[Column, ...] = ()) -> DataFrame:
    """Projection 1: labels normalised, other fields trimmed (numbers without thousands
    separators), blank -> NULL. Still text, so a later check can tell blank from malformed.
    ``keep`` columns are passed through unchanged. ``blank_mask`` has bit i set when staging
    column i was NULL or blank (the raw-data missing-value profile, kept as one small int)."""
    c = F.col
    fields = _fields(staging)
    if len(fields) > 63:
        raise ValueError("blank_mask holds at most 63 staging columns")
    mask = F.lit(0).cast("bigint")
    for i, n in enumerate(fields):
        mask = mask + F.when(blank_to_null(c(n)).isNull(), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0))
    cols = [*keep, mask.alias("blank_mask")] + [text_or_unknown(c(n)).alias(n) for n in LABELS]
    cols += [blank_to_null(c(n)).alias(n) for n in ("shipment_date", "delivery_date", "transit_days")]
    cols += [F.nullif(F.replace(F.trim(c(n)), F.lit(","), F.lit("")), F.lit("")).alias(n) for n in _NUMERIC]
    return staging.select(*cols)


def _typed(date_format: str | None) -> dict[str, Column]:
    """Projection 2: casts of the normalised text."""
    c = F.col
    out: dict[str, Column] = {n: c(n) for n in LABELS}
    for n in ("shipment_date", "delivery_date"):
        out[n] = parse_date(c(n), date_format)
    for n, t in _NUMERIC.items():
        out[n] = parse_decimal(c(n), t)
    out["transit_days"] = parse_int(c("transit_days"))
    return out


_CHECKED = ("shipment_date", "delivery_date", "weight_kg", "cost", "distance_miles", "transit_days")


def _reject_reason(raw: dict[str, Column], typed: dict[str, Column], malformed: Column | None = None) -> Column:
    """First failed check of a row, NULL when the row is accepted."""
    checks = [] if malformed is None else [(malformed.isNotNull(), "wrong number of fields")]
    checks.append((raw["shipment_date"].isNull(), "shipment_date missing"))
    for n in _CHECKED:
        checks.append((raw[n].isNotNull() & typed[n].isNull(), f"{n} unparseable"))
    reason = F.lit(None).cast("string")
    for cond, text in reversed(checks):
        reason = F.when(cond, F.lit(text)).otherwise(reason)
    return reason


def _recompute_transit(c_ship: Column, c_del: Column, c_transit: Column) -> Column:
    return F.when(c_del.isNotNull(), F.datediff(c_del, c_ship)).otherwise(c_transit).cast("int")


def parse_staging(staging: DataFrame, mode: str = "quarantine", keep_raw: bool = False, date_format: str | None = None) -> DataFrame:
    """Typed rows plus ``reject_reason`` (NULL for accepted rows); transit days recomputed. Dates are whole ISO
    dates, or written by ``date_format``.

    With ``keep_raw`` the original text of every field is kept in ``raw_<field>`` for rejected
    rows only (NULL otherwise, which costs nothing in Parquet), so the parsed table can serve
    the quarantine report without a second pass over the source. A staging frame with the reader's column
    ``malformed_record`` rejects those rows first and keeps the record in ``raw_record``.
    """
    src = _fields(staging)
    keep = tuple(F.col(n).alias(f"raw_{n}") for n in src) if keep_raw else ()
    flawed = MALFORMED in staging.columns
    if flawed:
        keep += (F.col(MALFORMED).alias("raw_record"),)
        src = [*src, "record"]
    norm = _normalised(staging, keep)
    typed = _typed(date_format)
    # cast once into attributes, then check them (keeps each expression small)
    parsed = norm.select(*[typed[n].alias(n) for n in CLEAN_COLUMNS], "blank_mask",
                         *[F.col(n).alias(f"_norm_{n}") for n in _CHECKED],
                         *[F.col(f"raw_{n}") for n in src if keep_raw or n == "record"])
    reason = _reject_reason({n: F.col(f"_norm_{n}") for n in _CHECKED}, {n: F.col(n) for n in _CHECKED},
                            F.col("raw_record") if flawed else None)
    if mode == "strict":
        # a typed insert fails on the first bad row: raise instead of quarantining. Checked
        # explicitly (not through ANSI casts), so it holds whatever spark.sql.ansi.enabled says;
        # ``accepted`` filters on this column, so every row is checked.
        reason = F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit("rejected row: "), reason))
                        ).cast("string")
    parsed = parsed.select(*CLEAN_COLUMNS, reason.alias("reject_reason"), "blank_mask",
                           *[F.col(f"raw_{n}") for n in src if keep_raw])
    if keep_raw:
        parsed = parsed.select(*CLEAN_COLUMNS, "reject_reason", "blank_mask", *[
            F.when(F.col("reject_reason").isNotNull(), F.col(f"raw_{n}")).alias(f"raw_{n}") for n in src])
    return parsed.withColumn("transit_days", _recompute_transit(
        F.col("shipment_date"), F.col("delivery_date"), F.col("transit_days")))


def accepted(parsed: DataFrame) -> DataFrame:
    """Rows of a parsed frame that passed every check (the typed insert would take them)."""
    return parsed.where(F.col("reject_reason").isNull()).select(*CLEAN_COLUMNS)


def rejected(parsed: DataFrame) -> DataFrame:
    """Rejected rows of a parsed frame (``keep_raw=True``): original text and the reason."""
    raw = [c for c in parsed.columns if c.startswith("raw_")]
    return (parsed.where(F.col("reject_reason").isNotNull())
            .select(*[F.col(c).alias(c[4:]) for c in raw], "reject_reason"))


def clean_shipments(staging: DataFrame, mode: str = "quarantine") -> DataFrame:
    """Accepted typed rows, before cost imputation (CL-1..CL-5, CL-7)."""
    return accepted(parse_staging(staging, mode))


def quarantine_rows(staging: DataFrame) -> DataFrame:
    """Rows a typed insert would reject: the raw staging text plus the reason (CL-7)."""
    return rejected(parse_staging(staging, "quarantine", keep_raw=True))


def mean_cost(clean: DataFrame) -> DataFrame:
    """One row: mean of the known costs, rounded to the cost scale (AVG then NUMERIC(14,2))."""
    return clean.agg(
        ratio(F.sum("cost").cast(SUM_COST), F.count("cost")).cast(MONEY).alias("mean_cost"))


def impute_cost(clean: DataFrame) -> DataFrame:
    """Fill NULL cost with the mean of the known costs (CL-6).

    The mean is a global aggregate (exactly one row) read as a scalar subquery, so Spark
    computes it once and ships a single value to the tasks; no join is planned.
    """
    m = mean_cost(clean).select("mean_cost").scalar()
    return clean.withColumn("cost", F.coalesce(F.col("cost"), m).cast(COST_TYPE))


def fill_cost(clean: DataFrame, mean) -> DataFrame:
    """Fill NULL cost with a known mean (a Decimal, e.g. stored next to a parsed table), so the
    clean table is a projection of the parsed one instead of a second stored copy."""
    if mean is None:
        return clean
    return clean.withColumn("cost", F.coalesce(F.col("cost"), F.lit(mean).cast(COST_TYPE)).cast(COST_TYPE))


def log_data(staging: DataFrame, mode: str = "quarantine", unique: bool = False) -> DataFrame:
    """Clean, imputed fact table (the analysed ``log_data``); ``unique`` enforces the key."""
    parsed = parse_staging(staging, mode)
    return impute_cost(accepted(enforce_key(store.cut(parsed, "parsed"), mode) if unique else parsed))


def duplicate_ids(clean: DataFrame) -> DataFrame:
    """Ids that occur more than once (a primary-key violation), with their count (CL-8).

    ``groupBy`` aggregates map-side first, so even a hot id (for example ``UNKNOWN`` on a third
    of all rows) is reduced to one partial count per task before the shuffle.
    """
    return (clean.groupBy("shipment_id").agg(F.count(F.lit(1)).alias("occurrences"))
            .where(F.col("occurrences") > 1))


#: Parts into which the rows of one repeated id are split before one is kept.
KEY_SALTS = 64
#: So many repeated ids are broadcast; the rows of more meet them by a shuffle.
BROADCAST_IDS = 1_000_000
REPEATED_ID, MISSING_ID = "shipment_id repeated", "shipment_id missing"


def enforce_key(parsed: DataFrame, mode: str = "quarantine") -> DataFrame:
    """``parsed`` with a unique ``shipment_id`` among its accepted rows (CL-8). parsed: a stored table (``store.cut``), as it
    is read for the ids and for the rows.

    Of the rows that share an id one stays: the first by ship date, then by the other columns in their order (NULLs
    first). The others get the reason ``shipment_id repeated``. A row without an id (the label ``UNKNOWN``) cannot be told
    from another one, so all of them get the reason ``shipment_id missing``. ``mode="strict"`` stops the job at such a row.

    Only rows with repeated ids are shuffled: the repeated ids come from a count that combines map-side, are stored, and
    the join back is broadcast for up to ``BROADCAST_IDS`` of them. ``UNKNOWN`` is a plain filter, never a key. One id on very many rows is first
    reduced inside ``KEY_SALTS`` parts, so no task sorts all its rows.
    """
    named = F.col("reject_reason").isNull() & (F.col("shipment_id") != UNKNOWN)
    repeated = duplicate_ids(parsed.where(named)).select(F.col("shipment_id").alias("_id"))
    repeated = store.cut(repeated, "repeated-ids")
    if repeated.count() <= BROADCAST_IDS:
        repeated = F.broadcast(repeated)
    joined = parsed.join(repeated, named & (F.col("shipment_id") == F.col("_id")), "left")
    many = joined.where(F.col("_id").isNotNull())
    order = [F.asc("shipment_date"), *[F.asc_nulls_first(c) for c in CLEAN_COLUMNS if c not in ("shipment_id", "shipment_date")]]
    many = many.withColumn("_salt", F.spark_partition_id() % KEY_SALTS)
    many = many.withColumn("_place", F.row_number().over(Window.partitionBy("_id", "_salt").orderBy(*order)))
    # rows behind another one of their part are out; the first of the parts meet, KEY_SALTS rows an id at most
    behind, first = many.where("_place > 1"), many.where("_place = 1")
    first = first.withColumn("_place", F.row_number().over(Window.partitionBy("_id").orderBy(*order)))
    many = first.union(behind).withColumn("reject_reason", F.when(F.col("_place") > 1, F.lit(REPEATED_ID)))
    single = joined.where(F.col("_id").isNull()).withColumn(
        "reject_reason", F.when(F.col("reject_reason").isNull() & (F.col("shipment_id") == UNKNOWN), F.lit(MISSING_ID))
        .otherwise(F.col("reject_reason")))
    out = single.select(*parsed.columns).union(many.select(*parsed.columns))
    if mode == "strict":
        broken = F.raise_error(F.concat(F.lit("broken key: "), F.col("reject_reason"), F.lit(" "), F.col("shipment_id"))).cast("string")
        out = out.withColumn("reject_reason", F.when(F.col("reject_reason").isin(REPEATED_ID, MISSING_ID), broken)
                             .otherwise(F.col("reject_reason")))
    return out


def data_issues(clean: DataFrame) -> DataFrame:
    """Rows that say delivered (any letter case) without a delivery date, or lack a ship date (CL-9)."""
    return clean.where((F.col("status").ilike("delivered") & F.col("delivery_date").isNull())
                       | F.col("shipment_date").isNull())
