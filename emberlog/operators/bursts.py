"""Bursts of failed logins for each account and each address, and the success that followed.

A burst is a run of failures of one key in which some failure is hot: `threshold` failures or more lie in the window
that ends with it. Its members are the failures in the window of a hot one; it ends where the next hot failure's
window no longer reaches the last hot one. A failure only needs the nearest hot one at or after it, so windows over
(rule, key) in time order find all bursts in one pass.

Failures of one key at one instant are summed first, so a key under attack is one row for each instant. Time is cut
into spans of SPAN windows, and a key's spans are dealt to different tasks: a burst is decided by what lies two windows
before and one after, so a span also gets copies of these few rows. Windows are running sums, in which a failure counts
from its instant on and no longer once it's a window old, so the work doesn't grow with the failures in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from emberlog.functions.text import clean_text, safe_csv_cell
from emberlog.functions.time import format_duration, format_timestamp, iso_seconds, minutes_text
from emberlog.operators.networks import label_networks
from emberlog.operators.ranks import numbered
from emberlog.scratch import scratch, stored
from emberlog.settings import BurstSettings

KEYS = ["rule", "key"]
#: Windows in a span of time that one task looks through; 3 / SPAN of the rows are copied.
SPAN = 32


def keyed(events: DataFrame, settings: BurstSettings, *more: str) -> DataFrame:
    """events for each rule: key is what the rule counts by, related what it lists; us is the time in µs. more: further columns to keep."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    sides = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), text(r.key).alias("key"), text(r.related).alias("related")) for r in settings.all_rules()]))
    place = [c for c in ("file_idx", "line_no") if c in events.columns]
    return events.withColumn("_s", sides).select("_s.rule", "_s.key", "_s.related", F.unix_micros("ts").alias("us"), "outcome", "n", "source", *place, "user", "ip", *more)


def _micros(delta) -> int:
    return round(delta.total_seconds() * 1_000_000)


def _span(us: str, width: int) -> Column:
    """The number of the span of SPAN widths that an instant lies in, exact for any bigint."""
    return F.expr(f"({us} - pmod({us}, {SPAN * width})) div {SPAN * width}")


def _spans(events: DataFrame, width: int, settings: BurstSettings) -> DataFrame:
    """(rule, key, span, us, n, in_window, own): the instants that a span sees, own being those that lie in it; in_window holds from a window before the span on.

    in_window is a running sum of changes. By failures, an instant's failures come, and go again a microsecond after
    the last moment of the window that begins with it. By related values, a value comes with a failure that none of its
    own stands in the window before, and goes a window after one that none of its own follows.
    """
    failures = keyed(events.where("outcome = 'failure'"), settings)
    distinct = [r.name for r in settings.all_rules() if r.measure == "related"]
    seen = F.explode(F.sequence(_span(f"(us - {width})", width), _span(f"(us + {2 * width})", width))).alias("span")
    own = F.col("rule").isin(*distinct) if distinct else F.lit(False)
    instants = failures.where(~own).groupBy(*KEYS, "us").agg(F.sum("n").alias("n")).select(*KEYS, "us", "n", F.col("n").alias("comes"), F.col("n").alias("goes"), seen)
    if distinct:
        each = failures.where(own).groupBy(*KEYS, "related", "us").agg(F.sum("n").alias("n")).select(*KEYS, "related", "us", "n", seen)
        order = Window.partitionBy(*KEYS, "span", "related").orderBy("us")
        fresh = F.coalesce(F.lag("us").over(order) < F.col("us") - width, F.lit(True)).cast("bigint")
        final = F.coalesce(F.lead("us").over(order) > F.col("us") + width, F.lit(True)).cast("bigint")
        each = each.select(*KEYS, "us", "n", fresh.alias("comes"), final.alias("goes"), "span").groupBy(*KEYS, "span", "us").agg(F.sum("n").alias("n"), F.sum("comes").alias("comes"), F.sum("goes").alias("goes"))
        instants = instants.unionByName(each)
    change = F.explode(F.array(F.struct(F.col("us").alias("at"), F.lit(1).alias("in"), F.col("comes").alias("by")), F.struct((F.col("us") + width + 1).alias("at"), F.lit(0).alias("in"), (-F.col("goes")).alias("by"))))
    rows = instants.select(*KEYS, "span", "us", "n", change.alias("c")).select(*KEYS, "span", "us", "n", "c.at", F.col("c.in").alias("comes"), "c.by")
    rows = rows.withColumn("in_window", F.sum("by").over(_in_span().rowsBetween(Window.unboundedPreceding, 0))).where("comes = 1")
    return rows.withColumn("own", F.col("span") == _span("us", width))


def _in_span(newest_first: bool = False) -> WindowSpec:
    order = [F.col(c).desc() if newest_first else F.col(c) for c in ("at", "comes")]
    return Window.partitionBy(*KEYS, "span").orderBy(*order)


def window_counts(events: DataFrame, settings: BurstSettings) -> DataFrame:
    """(rule, key, us, n, in_window): failures of each instant, and those in the window that ends with it."""
    return _spans(events, _micros(settings.window), settings).where("own").select(*KEYS, "us", "n", "in_window")


def burst_members(events: DataFrame, settings: BurstSettings) -> DataFrame:
    """(rule, key, us, n, burst): the instants that belong to a burst; bursts of a key are numbered from 1."""
    width = _micros(settings.window)
    begin = F.col("span") * (SPAN * width)
    hot = F.when((F.col("in_window") >= settings.threshold) & (F.col("us") >= begin - width), F.col("us"))
    rows = _spans(events, width, settings).withColumn("hot", hot)
    rows = rows.withColumn("before", F.last("hot", ignorenulls=True).over(_in_span().rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.col("hot").isNotNull() & (F.col("us") >= begin) & (F.col("before").isNull() | (F.col("before") < F.col("hot") - width))
    rows = rows.withColumn("opens", opens.cast("bigint")).withColumn("number", F.sum("opens").over(_in_span().rowsBetween(Window.unboundedPreceding, 0)))
    # backwards in time, since Spark works through a frame that ends with the last row anew for each row
    nearest = F.last(F.when(F.col("hot").isNotNull(), F.struct("hot", "number")), ignorenulls=True).over(_in_span(newest_first=True).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("next", nearest).where(F.col("own") & (F.col("next.hot") - width <= F.col("us"))).select(*KEYS, "span", "us", "n", "opens", F.col("next.number").alias("number"))
    rows = stored(rows, f"{scratch(events.sparkSession, 'bursts')}/members")
    earlier = Window.partitionBy(*KEYS).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # one row a span
    opened = rows.groupBy(*KEYS, "span").agg(F.sum("opens").alias("opens")).select(*KEYS, "span", F.coalesce(F.sum("opens").over(earlier), F.lit(0)).alias("earlier"))
    return rows.join(opened, [*KEYS, "span"]).select(*KEYS, "us", "n", (F.col("earlier") + F.col("number")).alias("burst"))


def member_failures(events: DataFrame, settings: BurstSettings) -> DataFrame:
    """The failures of all bursts with rule, key and burst, stored: everything that alerts say comes from them."""
    rows = keyed(events.where("outcome = 'failure'"), settings).join(burst_members(events, settings).select(*KEYS, "us", "burst"), [*KEYS, "us"])
    return stored(rows, f"{scratch(events.sparkSession, 'bursts')}/failures")


def burst_evidence(failures: DataFrame, settings: BurstSettings) -> DataFrame:
    """(rule, key, burst, place, source, line_no, times): the first max_evidence of member_failures of each burst, in reading order.

    A line that stands for several failures takes as many places; what goes beyond the limit is cut.
    """
    order = Window.partitionBy(*KEYS, "burst").orderBy("us", *[c for c in ("file_idx", "line_no") if c in failures.columns], "source")
    few = failures.withColumn("place", F.row_number().over(order)).where(F.col("place") <= settings.max_evidence)  # limited before the shuffle
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = few.withColumn("before", before).where(F.col("before") < settings.max_evidence)
    return few.select(*KEYS, "burst", "place", "source", "line_no", F.least("n", settings.max_evidence - F.col("before")).cast("int").alias("times"))


def burst_related(failures: DataFrame) -> DataFrame:
    """(rule, key, burst, place, related): the different related values of member_failures of each burst, a row a value, numbered in order.

    However many values a burst has, they are counted and numbered by ranges of the values, never in one task or array.
    """
    each = stored(failures.select(*KEYS, "burst", "related").distinct(), f"{scratch(failures.sparkSession, 'bursts')}/related")
    return numbered(each, F.col("related"), groups=(*KEYS, "burst"), name="place").select(*KEYS, "burst", "place", "related")


def _listed(failures: DataFrame, most: int | None) -> DataFrame:
    """(rule, key, burst, n_related, related): the number of related values, and the first `most` of them as an array.

    Values are made distinct dealt by the value, so the counts add up a row a value and task, not sets of a burst.
    """
    each, keys = failures.select(*KEYS, "burst", "related").distinct(), [*KEYS, "burst"]
    every = F.array_sort(F.collect_list("related")).alias("related")
    if most is None:
        return each.groupBy(*keys).agg(F.count("related").alias("n_related"), every)
    each = stored(each, f"{scratch(failures.sparkSession, 'bursts')}/related")
    few = each.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("related"))).where(F.col("place") <= most)  # limited before the shuffle
    return each.groupBy(*keys).agg(F.count("related").alias("n_related")).join(few.groupBy(*keys).agg(every), keys)


def burst_alerts(events: DataFrame, settings: BurstSettings = BurstSettings()) -> DataFrame:
    """One row for each burst: failures, first and last time, related values and evidence.

    n_related counts all related values; related lists them in order, the first max_related of them if that is set. For
    all of very many, as rows, see burst_related.
    """
    failures = member_failures(events, settings)
    alerts = failures.groupBy(*KEYS, "burst").agg(F.sum("n").alias("failures"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    shown = burst_evidence(failures, settings).groupBy(*KEYS, "burst").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source", "line_no", "times"))), lambda x: F.struct(x["source"], x["line_no"], x["times"])).alias("evidence"))
    alerts = alerts.join(_listed(failures, settings.max_related), [*KEYS, "burst"]).join(shown, [*KEYS, "burst"])
    return alerts.withColumn("duration_s", F.floor((F.col("last_us") - F.col("first_us")) / 1_000_000))


def attach_success(alerts: DataFrame, events: DataFrame, settings: BurstSettings = BurstSettings()) -> DataFrame:
    """alerts with success, the first success of the same key from the burst's start to success_after its end, and severity.

    Forward as-of join: alerts and the successes of their keys stand in one ordered window of each span of time, and an
    alert takes the first success at or after its start, in reading order for equal times. An alert without one in its
    span takes the first one of the spans after it, of which only one row a span is looked at. So the work is linear
    in both, and a key with very many successes is dealt to several tasks.
    """
    names, width = alerts.columns, _micros(settings.window + settings.success_after)
    place = [F.col(c).cast("bigint") if c in events.columns else F.lit(0).cast("bigint") for c in ("file_idx", "line_no")]
    win = F.struct("us", place[0].alias("f"), place[1].alias("l"), "user", "ip", "source", "line_no").alias("win")
    wins = keyed(events.where("outcome = 'success'"), settings).select(*KEYS, _span("us", width).alias("span"), F.col("us").alias("at"), win)
    kind = lambda df, c: df.schema[c].dataType
    left = alerts.select(*KEYS, _span("first_us", width).alias("span"), F.col("first_us").alias("at"), F.lit(None).cast(kind(wins, "win")).alias("win"), F.struct(*names).alias("alert"))
    firsts = wins.select(*KEYS, "span", "win").union(left.select(*KEYS, "span", "win")).groupBy(*KEYS, "span").agg(F.min("win").alias("win"))
    later = Window.partitionBy(*KEYS).orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(*KEYS, "span", F.last("win", ignorenulls=True).over(later).alias("later"))
    both = left.unionByName(wins.withColumn("alert", F.lit(None).cast(kind(left, "alert"))))
    # backwards in time (see burst_members), an alert after the successes of its instant
    ahead = Window.partitionBy(*KEYS, "span").orderBy(F.desc("at"), F.desc_nulls_last("win.f"), F.desc_nulls_last("win.l")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("found", F.last("win", ignorenulls=True).over(ahead)).where("alert is not null").join(firsts, [*KEYS, "span"])
    first = F.coalesce("found", "later")
    shown = F.struct(*[first[c].alias(c) for c in ("us", "user", "ip", "source", "line_no")])
    reached = F.when(first["us"] <= F.col("alert.last_us") + _micros(settings.success_after), shown)
    return found.select("alert.*", reached.alias("success")).withColumn("severity", F.when(F.col("success").isNull(), "media").otherwise("alta"))


def detect_bursts(events: DataFrame, settings: BurstSettings = BurstSettings()) -> DataFrame:
    """Alerts with their successes and rank, their number from 1 in the order first_us, rule, key."""
    path = scratch(events.sparkSession, "bursts")
    alerts = stored(burst_alerts(events, settings), f"{path}/alerts")  # read twice, as what follows
    return numbered(stored(attach_success(alerts, events, settings), f"{path}/detected"), F.col("first_us"), F.col("rule"), F.col("key"))


def out_of_order(events: DataFrame, chunk: int = 100_000) -> DataFrame:
    """One row, n: attempts that are earlier than some attempt read before them (file_idx, line_no give the order).

    The running maximum is kept inside chunks of lines; the maxima of the chunks before, a row a chunk, set its start.
    """
    rows = events.select("file_idx", "line_no", F.floor(F.col("line_no") / chunk).alias("chunk"), F.unix_micros("ts").alias("us"), "n")
    tops = rows.groupBy("file_idx", "chunk").agg(F.max("us").alias("top"))
    floor = tops.select("file_idx", "chunk", F.max("top").over(Window.orderBy("file_idx", "chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("floor"))
    inside = Window.partitionBy("file_idx", "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    late = rows.withColumn("inside", F.max("us").over(inside)).join(floor, ["file_idx", "chunk"]).where(F.col("us") < F.greatest("inside", "floor"))
    return late.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def detection_stats(events: DataFrame) -> DataFrame:
    """One row: events, failures, successes, out_of_order."""
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = F.lit(0).alias("one")
    totals = events.agg(count("n").alias("events"), count(F.when(F.col("outcome") == "failure", F.col("n"))).alias("failures"), count(F.when(F.col("outcome") == "success", F.col("n"))).alias("successes")).select(one, "*")
    return totals.join(out_of_order(events).select(one, F.col("n").alias("out_of_order")), "one").drop("one")


def evidence_text(alerts: DataFrame) -> DataFrame:
    """(rule, key, burst, text): `source: line, line (xN); source: ...` of each alert's evidence."""
    rows = alerts.select(*KEYS, "burst", F.posexplode("evidence").alias("pos", "e")).select(*KEYS, "burst", "pos", "e.*")
    lines = rows.groupBy(*KEYS, "burst", "source", "line_no").agg(F.min("pos").alias("pos"), F.sum("times").alias("times"))
    label = F.concat(F.col("line_no").cast("string"), F.when(F.col("times") > 1, F.concat(F.lit(" (x"), F.col("times").cast("string"), F.lit(")"))).otherwise(""))
    in_order = lambda c: F.array_sort(F.collect_list(F.struct("pos", c)))
    files = lines.withColumn("label", label).groupBy(*KEYS, "burst", "source").agg(F.min("pos").alias("first"), in_order("label").alias("labels"))
    part = F.concat(clean_text(F.col("source")), F.lit(": "), F.array_join(F.transform("labels", lambda x: x["label"]), ", "))
    parts = files.select(*KEYS, "burst", F.col("first").alias("pos"), part.alias("part")).groupBy(*KEYS, "burst").agg(in_order("part").alias("parts"))
    return parts.select(*KEYS, "burst", F.array_join(F.transform("parts", lambda x: x["part"]), "; ").alias("text"))


def explanations(alerts: DataFrame, settings: BurstSettings = BurstSettings(), zone: str = "UTC") -> DataFrame:
    """alerts with `explanation`: the sentences that say why each was raised."""
    time = lambda us: format_timestamp(F.timestamp_micros(us), zone)
    rules, s = settings.all_rules(), F.col("success")
    by_user = F.col("rule").isin(*[r.name for r in rules if r.key == "user"]) if any(r.key == "user" for r in rules) else F.lit(False)
    by_values = F.col("rule").isin(*[r.name for r in rules if r.measure == "related"]) if any(r.measure == "related" for r in rules) else F.lit(False)
    of_what = F.when(by_values, F.when(by_user, "different addresses failing").otherwise("different accounts failing")).otherwise("failures")
    gap = F.floor((s["us"] - F.col("last_us")) / 1_000_000)
    moment = F.when(s["us"] <= F.col("last_us"), "during the burst").otherwise(F.concat(format_duration(gap), F.lit(" after the last failure")))
    whose = F.when(by_user, F.concat(F.lit("from "), s["ip"])).otherwise(F.concat(F.lit("as "), s["user"]))
    none = F.concat(F.lit("No successful login of the same "), F.when(by_user, "account").otherwise("address"), F.lit(f" up to {minutes_text(settings.success_after)} after the burst."))
    some = F.concat(F.lit("Successful login "), moment, F.lit(": "), time(s["us"]), F.lit(" "), whose, F.lit(" ("), s["source"], F.lit(":"), s["line_no"].cast("string"), F.lit("). Check whether it was legitimate."))
    sentences = F.array(
        F.concat(F.col("failures").cast("string"), F.lit(" failed attempts from "), time(F.col("first_us")), F.lit(" to "), time(F.col("last_us")), F.lit(" ("), format_duration(F.col("duration_s")), F.lit(").")),
        F.concat(F.lit(f"Rule: {settings.threshold} or more "), of_what, F.lit(f" in a window of {minutes_text(settings.window)}.")),
        F.concat(F.when(by_user, "Addresses").otherwise("Accounts"), F.lit(" ("), F.col("n_related").cast("string"), F.lit("): "), F.array_join("related", ", ")),
        F.when(s.isNull(), none).otherwise(some),
    )
    return alerts.withColumn("explanation", F.transform(sentences, clean_text))


def mark_excluded(alerts: DataFrame, networks: DataFrame, settings: BurstSettings = BurstSettings(), network: str = "network") -> DataFrame:
    """alerts with excluded: of an address's alert the longest of the table's networks that it lies in, such as those of one's own scanners; else null.

    Alerts are marked, never dropped. An account is in no network, even if its name is an address.
    """
    by_ip = [r.name for r in settings.all_rules() if r.key == "ip"]
    address = F.when(F.col("rule").isin(*by_ip), F.col("key")) if by_ip else F.lit(None).cast("string")
    return label_networks(alerts.withColumn("_address", address), networks, "_address", network, "excluded").drop("_address")


def _location(success: Column) -> Column:
    return F.when(success.isNotNull(), F.concat_ws(":", success["source"], success["line_no"].cast("string")))


def alerts_flat(alerts: DataFrame) -> DataFrame:
    """Alerts as text cells for CSV."""
    when = lambda us: iso_seconds(F.timestamp_micros(us))
    places = F.transform("evidence", lambda e: F.array_join(F.array_repeat(F.concat_ws(":", e["source"], e["line_no"].cast("string")), e["times"]), " "))
    s = F.col("success")
    return alerts.select(
        "rule", safe_csv_cell(F.col("key")).alias("key"), "severity", when(F.col("first_us")).alias("first_seen"), when(F.col("last_us")).alias("last_seen"), "duration_s", "failures", "n_related",
        safe_csv_cell(F.array_join("related", " ")).alias("related"), safe_csv_cell(F.array_join(places, " ")).alias("evidence"), when(s["us"]).alias("success_at"), safe_csv_cell(_location(s)).alias("success_location"),
    )


def alerts_json(alerts: DataFrame) -> DataFrame:
    """(rule, key, first_us, json): each alert, with its explanation if there is one, as one JSON record; no success is null."""
    when = lambda us: iso_seconds(F.timestamp_micros(us))
    s = F.col("success")
    win = F.when(s.isNotNull(), F.struct(when(s["us"]).alias("timestamp"), s["user"].alias("user"), s["ip"].alias("ip"), _location(s).alias("location")))
    more = ["explanation"] if "explanation" in alerts.columns else []
    record = F.struct("rule", "key", "severity", when(F.col("first_us")).alias("first_seen"), when(F.col("last_us")).alias("last_seen"), "duration_s", "failures", "related", "evidence", win.alias("success_after"), *more)
    return alerts.select("rule", "key", "first_us", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))
