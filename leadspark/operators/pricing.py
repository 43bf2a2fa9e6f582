"""Price list, as-of price lookup and API cost roll-ups.

The price lookup (J2) is the one theta join of the engine. It is planned
without any shuffle of the usage table: a short price list is folded into one
row per model (an array of its periods), joined to usage on ``model``
(broadcast when the list is small, checked by a bounded count), and the
period is picked per row with higher-order functions. A long list is first cut
into the stretches of time in which one period is in force (:func:`timeline`), which a usage
row finds by binary search. Rules of the pick:

* candidates are the model's periods with ``start <= d``;
* a candidate is *valid* when ``end >= d`` or ``end`` is null (``end`` is a
  timestamp at midnight, so usage later on the end day is not valid);
* the last valid candidate in file order (``ord``) wins, else the last
  candidate in file order, else no price.
"""

from __future__ import annotations

import datetime as dt

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouping import row_number_per_group
from .sizing import broadcast_bounded, is_small, rows_of

# A price list is a small dimension (models x price periods). It is
# broadcast only when a bounded count proves it below this many rows;
# past that the same plan runs as a shuffled equi-join on ``model``, with
# AQE splitting a hot model's usage partition.
MAX_BROADCAST_PRICE_ROWS = 200_000

# Lists up to this many rows are scanned per usage row; longer ones get a timeline.
SCAN_PRICE_ROWS = 256
# Stretches of a model that one page of its timeline holds.
PAGE = 256
# Stretches of a model that one sort of its timeline takes.
CHUNK = 1 << 16
# Blocks of 1, 2, 4, ... stretches that are looked up for each stretch (larger ones: for a group of them).
SMALL_LEVELS = 6
# Bytes of a page's first moment, with its model's row where that has one page.
FIRST_BYTES = 64

PRICE_FIELDS = ["input_price", "output_price", "search_price"]
# Usage measure paired with each price column.
MEASURE_OF_PRICE = {"input_price": "input_tokens", "output_price": "output_tokens",
                    "search_price": "search_calls"}


def periods_by_model(prices: DataFrame) -> DataFrame:
    """One row per model holding all of its price periods."""
    return prices.groupBy("model").agg(F.collect_list(F.struct(
        "ord", "start_date", "end_date", *PRICE_FIELDS)).alias("periods"))


def price_asof(usage: DataFrame, prices: DataFrame, date_col: str = "search_date",
               max_broadcast_rows: int = MAX_BROADCAST_PRICE_ROWS, scan_rows: int = SCAN_PRICE_ROWS) -> DataFrame:
    """Attach ``price_ord`` and the three prices in force at ``date_col``.

    Usage rows keep their partitioning; no aggregation over usage happens.
    """
    n = prices.limit(max(max_broadcast_rows, scan_rows) + 1).count()
    side = F.broadcast if n <= max_broadcast_rows else lambda df: df
    d = F.col(date_col)
    if n <= scan_rows:
        cands = F.filter("periods", lambda p: p["start_date"] <= d)
        ranked = F.transform(cands, lambda p: F.struct(
            F.coalesce(p["end_date"] >= d, F.lit(True)).alias("valid"),
            p["ord"].alias("ord"), p.alias("p")))
        out = usage.join(side(periods_by_model(prices)), "model", "left").withColumn("_best", F.array_max(ranked))
    else:
        line = timeline(prices)
        page = F.floor((F.col("seg") - 1) / PAGE)
        pages = line.groupBy("model", page.alias("_page")).agg(F.array_sort(F.collect_list("at")).alias("_ats"))
        firsts = pages.groupBy("model").agg(F.array_sort(F.collect_list(F.col("_ats")[0])).alias("_firsts"))
        best = line.select("model", F.col("seg").alias("_seg"), "_best")
        # one moment a page, so they are sent to the usage rows far beyond the price rows that are
        few = is_small(line.filter((F.col("seg") - 1) % PAGE == 0), rows_of(FIRST_BYTES))
        out = usage.join(F.broadcast(firsts) if few else firsts, "model", "left").withColumn("_page", _up_to("_firsts", d, 1 << 20) - 1).drop("_firsts")
        out = out.join(side(pages), ["model", "_page"], "left").withColumn(
            "_seg", F.col("_page") * PAGE + _up_to("_ats", d, PAGE)).drop("_ats")
        out = out.join(side(best), ["model", "_seg"], "left")
    return out.select(
        *[c for c in usage.columns],
        F.col("_best.ord").alias("price_ord"),
        F.col("_best.valid").alias("price_valid"),
        *[F.col(f"_best.p.{f}").alias(f) for f in PRICE_FIELDS])


def _up_to(sorted_array: str, d: Column, longest: int) -> Column:
    """How many entries of a sorted array (at most ``longest``, a power of two,
    doubled less one) are not after ``d``, by binary search."""
    steps = [longest >> i for i in range(longest.bit_length())]
    return F.aggregate(F.array(*[F.lit(s).cast("bigint") for s in steps]), F.lit(0).cast("bigint"), lambda at, step: F.when(
        F.get(F.col(sorted_array), (at + step - 1).cast("int")) <= d, at + step).otherwise(at))


def timeline(prices: DataFrame) -> DataFrame:
    """The stretches of time of each model, ``(model, seg, at, _best)``: from
    ``at`` on, until the next stretch, ``_best`` (valid, ord, p) is in force.

    A stretch begins at a start or just after an end. The last valid period in file order
    is the largest ``ord`` of those that cover a stretch: a period gives its
    ``ord`` to the blocks of 1, 2, 4, ... stretches that make it up (two a size at most),
    and a stretch takes the largest of the blocks that it lies in. So the
    work is rows x log(rows), also where many periods overlap. Periods go by their
    number in file order; their prices are joined to the result."""
    period = F.struct("ord", "start_date", "end_date", *PRICE_FIELDS)
    p = prices.filter(F.col("model").isNotNull() & F.col("start_date").isNotNull()).select(
        "model", F.col("start_date").alias("at"), F.col("end_date").isNull().alias("open"),
        F.when(F.col("end_date") >= F.col("start_date"), F.col("end_date") + F.expr("INTERVAL '0.000001' SECOND")).alias("past"),
        period.alias("p"))
    # numbers are only compared: they rise by file order and may have gaps
    p = (p.repartitionByRange("p", "model").sortWithinPartitions("p", "model")
         .withColumn("no", F.monotonically_increasing_id()).checkpoint(eager=True))
    points = p.select("model", "at").unionByName(p.filter("past IS NOT NULL").select("model", F.col("past").alias("at"))).distinct()
    segs = row_number_per_group(points, ["model"], ["at"], "seg")
    sizes = segs.groupBy("model").agg(F.max("seg").alias("n")).checkpoint(eager=True)
    segs = segs.join(F.broadcast(sizes) if is_small(sizes, MAX_BROADCAST_PRICE_ROWS) else sizes, "model").checkpoint(eager=True)
    ends = segs.select("model", F.col("at").alias("past"), F.col("seg").alias("stop"))
    starts = p.drop("p").join(segs, ["model", "at"]).checkpoint(eager=True)
    span = ["model", "no", "seg", "stop", "n"]
    spans = starts.filter("past IS NOT NULL").join(ends, ["model", "past"]).select(*span).unionByName(
        starts.filter("open").withColumn("stop", F.col("n") + 1).select(*span))

    levels = F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("n") + 1)).cast("int")))
    lo, hi = F.expr("shiftright(seg + shiftleft(1L, level) - 1, level)"), F.expr("shiftright(stop, level)")
    blocks = (spans.withColumn("level", levels).withColumn("lo", lo).withColumn("hi", hi)
              .filter("lo < hi").select("model", "level", "no", F.explode(F.array_compact(F.array(
                  F.when(F.col("lo") % 2 == 1, F.col("lo")), F.when(F.col("hi") % 2 == 1, F.col("hi") - 1)))).alias("block"))
              .groupBy("model", "level", "block").agg(F.max("no").alias("no"))).checkpoint(eager=True)

    def largest(parts: DataFrame, name: str, low: int) -> DataFrame:
        """The largest number of the blocks that hold a part (``1 << low`` stretches), by its levels' blocks."""
        return (parts.withColumn("block", F.expr(f"shiftright({name}, level - {low})")).join(blocks, ["model", "level", "block"])
                .groupBy("model", name).agg(F.max("no").alias(f"of_{name}")))

    # large blocks are looked up once for the stretches of a group, so a stretch meets the small ones alone
    group = F.shiftright("seg", SMALL_LEVELS).alias("group")
    groups = segs.select("model", "n", group).distinct().withColumn("level", levels).filter(F.col("level") >= SMALL_LEVELS)
    small = segs.select("model", "seg", F.explode(F.sequence(F.lit(0), F.lit(SMALL_LEVELS - 1))).alias("level"))
    begun = starts.groupBy("model", "seg").agg(F.max("no").alias("no"))
    line = _begun_so_far(segs.join(begun, ["model", "seg"], "left")).join(largest(small, "seg", 0), ["model", "seg"], "left")
    line = line.withColumn("group", group).join(largest(groups, "group", SMALL_LEVELS), ["model", "group"], "left")
    line = line.withColumn("valid", F.greatest("of_seg", "of_group"))
    line = line.withColumn("no", F.coalesce("valid", "begun")).join(p.select("model", "no", "p"), ["model", "no"], "left")
    return line.select("model", "seg", "at", F.struct(
        F.col("valid").isNotNull().alias("valid"), F.col("p.ord").alias("ord"), F.col("p")).alias("_best")).checkpoint(eager=True)


def _begun_so_far(segs: DataFrame) -> DataFrame:
    """``begun``: the largest ``no`` of a model up to each ``seg``. It runs within chunks of
    ``CHUNK`` stretches, and what the chunks before leave is added; no task sorts a whole model."""
    segs = segs.withColumn("_chunk", F.floor(F.col("seg") / CHUNK))
    before = Window.partitionBy("model").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    left = segs.groupBy("model", "_chunk").agg(F.max("no").alias("_no")).withColumn("_left", F.max("_no").over(before))
    left = left.filter("_left IS NOT NULL").select("model", "_chunk", "_left")
    so_far = F.max("no").over(Window.partitionBy("model", "_chunk").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0))
    return segs.withColumn("begun", so_far).join(left, ["model", "_chunk"], "left").withColumn(
        "begun", F.greatest("begun", "_left")).drop("_chunk", "_left")


# Money is computed in exact decimals (measure < 10^13 per record, price
# < 10^6 with 9 decimals; a larger value fails the cast, it is never lost) so
# sums do not depend on the order rows arrive in; results are turned into
# DOUBLE only at the end. The widths are the largest whose sum of three terms
# (scale 15) stays exact in 38 digits.
MEASURE_DEC = "decimal(13,0)"
PRICE_DEC = "decimal(15,9)"
PER_MILLION = Decimal("0.000001")


def money_part(measure: Column, price: Column, per_million: bool) -> Column:
    """One F22 term; a missing or zero price adds nothing (falsy prices are
    skipped)."""
    each = price.cast(PRICE_DEC) * F.lit(PER_MILLION) if per_million else price.cast(PRICE_DEC)
    return F.when(price.isNotNull() & (price != 0), each * measure.cast(MEASURE_DEC)).otherwise(F.lit(Decimal(0)))


def cost_money() -> Column:
    """F22 as an exact decimal: tokens per million x price + calls x price."""
    return (money_part(F.col("input_tokens"), F.col("input_price"), True)
            + money_part(F.col("output_tokens"), F.col("output_price"), True)
            + money_part(F.col("search_calls"), F.col("search_price"), False))


def cost_expr() -> Column:
    """F22 as DOUBLE."""
    return cost_money().cast("double")


def filter_period(usage: DataFrame, date_from=None, date_to=None,
                  date_col: str = "search_date") -> DataFrame:
    """Optional inclusive bounds, pushed down to the parquet scan."""
    if date_from is not None:
        usage = usage.filter(F.col(date_col) >= F.lit(_ts(date_from)))
    if date_to is not None:
        usage = usage.filter(F.col(date_col) <= F.lit(_ts(date_to)))
    return usage


def month_to_date(usage: DataFrame, as_of, date_col: str = "search_date") -> DataFrame:
    """P10: usage from the first day of ``as_of``'s month on."""
    a = _ts(as_of)
    return filter_period(usage, date_from=dt.datetime(a.year, a.month, 1), date_col=date_col)


def _ts(v):
    if isinstance(v, str):
        v = dt.datetime.fromisoformat(v)
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        v = dt.datetime(v.year, v.month, v.day)
    return v


def cost_detail(usage: DataFrame, prices: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """A14 detail: one cost row per usage record (what the reference emits).

    ``price_missing`` flags a found period with a null price part (D8).
    """
    u = filter_period(usage, date_from, date_to)
    p = price_asof(u, prices)
    missing = F.col("price_ord").isNotNull() & (
        F.col("input_price").isNull() | F.col("output_price").isNull()
        | F.col("search_price").isNull())
    return p.select(
        "client", "usage_id", F.col("search_date").alias("date"), "model",
        "price_ord", cost_money().alias("money"), missing.alias("price_missing"))


def cost_daily(detail: DataFrame) -> DataFrame:
    """A14 as documented: cost per tenant, day and model (partial agg map-side)."""
    return detail.groupBy("client", F.to_date("date").alias("day"), "model").agg(
        F.sum("money").cast("double").alias("cost"), F.count(F.lit(1)).alias("n_records"))


def cost_total(detail: DataFrame) -> DataFrame:
    """A1 + A2 + K4: total cost per tenant with its period label."""
    return detail.groupBy("client").agg(
        F.sum("money").cast("double").alias("total_cost"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("n_records"))


def period_label(totals: DataFrame, date_from=None, date_to=None) -> Column:
    """K4: ``{client}_{from}_{to}``; given bounds win over the data's range."""
    def part(given, observed):
        if given is not None:
            return F.lit(_ts(given).strftime("%Y%m%d"))
        return F.coalesce(F.date_format(observed, "yyyyMMdd"),
                          F.lit("NoStartDate" if observed == "first_date" else "NoEndDate"))
    return F.concat_ws("_", F.col("client"), part(date_from, "first_date"),
                       part(date_to, "last_date"))


def cost_mtd(usage: DataFrame, prices: DataFrame, as_of,
             clients: DataFrame | None = None, clients_small: bool = False) -> DataFrame:
    """Month-to-date cost per tenant. With ``clients`` the usage is
    first cut to those tenants (semi join), so the result has at most one
    row per row of ``clients``."""
    u = month_to_date(usage, as_of)
    if clients is not None:
        u = u.join(broadcast_bounded(clients.select("client"), clients_small), "client", "left_semi")
    detail = cost_detail(u, prices)
    return detail.groupBy("client").agg(F.sum("money").cast("double").alias("mtd_cost"))


def cost_by_measure(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Pair each usage measure with its price column via unpivot and
    report the cost per tenant, model and measure."""
    p = price_asof(usage, prices)
    stacked = p.select(
        "client", "model",
        F.explode(F.array(*[F.struct(
            F.lit(MEASURE_OF_PRICE[f]).alias("measure"),
            F.col(MEASURE_OF_PRICE[f]).alias("amount"),
            F.col(f).alias("price"),
            F.lit(f != "search_price").alias("per_million")) for f in PRICE_FIELDS])).alias("m"))
    m = F.col("m")
    cost = F.when(m["per_million"], money_part(m["amount"], m["price"], True)).otherwise(
        money_part(m["amount"], m["price"], False))
    return stacked.groupBy("client", "model", m["measure"].alias("measure")).agg(
        F.sum(m["amount"]).alias("amount"), F.sum(cost).cast("double").alias("cost"))


def usage_rollup(usage: DataFrame) -> DataFrame:
    """A3: per tenant, sum the numerics and keep the *last* call's
    function/model (by date, then id)."""
    order = F.struct("search_date", "usage_id")
    return usage.groupBy("client").agg(
        F.sum("search_calls").alias("search_calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.max_by("function", order).alias("function"),
        F.max_by("model", order).alias("model"),
        F.count(F.lit(1)).alias("n_calls"))


def models_without_price(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Models used but absent from the price list (anti join)."""
    models = F.broadcast(prices.select("model").distinct()) if is_small(
        prices, MAX_BROADCAST_PRICE_ROWS) else prices.select("model").distinct()
    return usage.select("client", "model").distinct().join(models, "model", "left_anti")


def price_sequence_issues(prices: DataFrame) -> DataFrame:
    """Per model in start order, an open end before the last row
    (``open_ended``) and ``end < next start`` (``gap``; adjacent days count)."""
    w = Window.partitionBy("model").orderBy("start_date", "ord")
    nxt = F.lead("start_date").over(w)
    s = prices.select("model", "ord", "start_date", "end_date", nxt.alias("next_start"))
    issue = (F.when(F.col("next_start").isNull(), F.lit(None))
             .when(F.col("end_date").isNull(), F.lit("open_ended"))
             .when(F.col("end_date") < F.col("next_start"), F.lit("gap")))
    return s.withColumn("issue", issue).filter(F.col("issue").isNotNull())
