"""Independent SQL for every query, in plain joins and distinct counts.

These statements do not use the rewrites of the library: they join the facts as they
are and let DuckDB count, so that they check the rewrites.
"""

from __future__ import annotations

from workload import bindings as B
from workload import queries as Q

_TABLES = """
WITH ev AS (
  SELECT e.*, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events e
),
wide AS (
  SELECT ev.*, c_acctbal, c_mktsegment, n_name, r_name, r_regionkey, p_name, p_type
  FROM ev JOIN customer ON c_custkey = user_id
  JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey
  JOIN part ON p_partkey = k
),
search_events AS (
  SELECT event_id AS event_uuid, user_id AS merged_amplitude_id,
    CAST(user_id AS VARCHAR) || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS search_id,
    ts AS event_time, CAST(day(ts) AS INTEGER) AS month, k % 10 = 0 AS is_bot,
    c_acctbal > 5000 AS is_host, c_mktsegment AS first_attribution_source,
    r_name AS first_attribution_channel,
    CASE k % 4 WHEN 0 THEN 'map' WHEN 1 THEN 'text' WHEN 2 THEN 'filter' ELSE 'saved' END
      AS search_type,
    CASE k % 5 WHEN 0 THEN 'relevance' WHEN 1 THEN 'price_asc' WHEN 2 THEN 'price_desc'
      WHEN 3 THEN 'distance' END AS search_sort,
    CASE WHEN k % 13 <> 0 THEN CAST(k * 3 AS INTEGER) END AS count_results,
    p_name AS search_term, p_type AS search_term_category, n_name AS search_dma,
    r_regionkey = 1 AS is_usa_canada
  FROM wide WHERE event_type = 'view'
),
listing_views AS (
  SELECT event_id AS event_uuid, user_id AS merged_amplitude_id,
    CAST(user_id AS VARCHAR) || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS search_id,
    ts AS event_time, CAST(day(ts) AS INTEGER) AS month, k % 10 = 0 AS is_bot,
    c_acctbal > 5000 AS is_host, c_mktsegment AS first_attribution_source,
    r_name AS first_attribution_channel, k AS listing_id,
    CAST(1 + k % 25 AS INTEGER) AS search_position,
    CASE k % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'home' ELSE 'favourites' END AS source_screen,
    n_name AS click_dma, 'hex' || CAST(r_regionkey AS VARCHAR) AS hex_1_resolution,
    k % 2 = 0 AS is_listing_reserved
  FROM wide WHERE event_type = 'click' AND value > 80
),
reservations AS (
  SELECT event_id AS reservation_id, user_id AS renter_user_id, k AS listing_id,
    ts AS created_at,
    CASE WHEN k % 5 <> 0 THEN ts + to_hours(k) END AS approved_at,
    CASE WHEN k % 3 <> 0 THEN ts + to_hours(2 * k) END AS successful_payment_collected_at,
    n_name AS dma
  FROM wide WHERE event_type = 'purchase' AND value > 100
),
amplitude_user_ids AS (
  SELECT c_custkey AS merged_amplitude_id, c_custkey AS user_id FROM customer
),
s AS (SELECT * FROM search_events WHERE NOT is_bot),
l AS (SELECT * FROM listing_views WHERE NOT is_bot),
r AS (SELECT * FROM reservations WHERE renter_user_id IS NOT NULL),
item_views AS (
  SELECT l_partkey AS listing_id, l_linenumber AS search_position, l_shipdate AS event_time,
    month(l_shipdate) AS month, l_returnflag AS source_screen,
    l_linestatus = 'F' AS is_listing_reserved
  FROM lineitem
),
item_reservations AS (
  SELECT l_partkey AS listing_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45
),
order_reservations AS (
  SELECT o_orderkey AS reservation_id, o_custkey AS renter_user_id, o_orderdate AS created_at,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_hours(o_orderkey % 72) END
      AS approved_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_hours(o_orderkey % 200) END
      AS successful_payment_collected_at
  FROM orders
)
"""


def _label(value: str, ranges: str, otherwise: str = "NULL") -> str:
    """The label of the closed range that holds a value; ``ranges`` is "low high label; ...".

    A table of ranges is looked up, where the library compares edge by edge.
    """
    rows = [r.strip().split(" ", 2) for r in ranges.split(";")]
    values = ", ".join(f"({low}, {high}, '{label}')" for low, high, label in rows)
    return (f"coalesce((SELECT label FROM (VALUES {values}) AS bin(low, high, label) "
            f"WHERE {value} BETWEEN low AND high), {otherwise})")


def _rate(part: str, whole: str, name: str) -> str:
    return f"round({part} * CAST(100 AS DOUBLE) / nullif({whole}, 0), 2) AS {name}"


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part} / {whole} * 100 ELSE 0.0::DOUBLE END"


_FUNNEL_SETS = """,
ss AS (SELECT DISTINCT merged_amplitude_id AS u FROM {s} WHERE merged_amplitude_id IS NOT NULL),
cc AS (SELECT DISTINCT merged_amplitude_id AS u FROM {l} WHERE merged_amplitude_id IS NOT NULL),
rr AS (SELECT DISTINCT renter_user_id AS u FROM reservations WHERE renter_user_id IS NOT NULL),
sc AS (SELECT u FROM ss INTERSECT SELECT u FROM cc),
scr AS (SELECT u FROM sc INTERSECT SELECT u FROM rr)
"""
_RAW_SETS = _FUNNEL_SETS.format(s="search_events", l="listing_views")
_HUMAN_SETS = _FUNNEL_SETS.format(s="s", l="l")


def _stage_counts(renters: str) -> str:
    """Searchers, and those of them that are in the other sets; ``renters`` has u and paid."""
    return _HUMAN_SETS + f""", booked AS ({renters}), c AS (
  SELECT count(*) AS total_searchers, count(*) FILTER (u IN (FROM cc)) AS total_viewers,
    count(*) FILTER (u IN (SELECT u FROM booked)) AS total_reservers,
    count(*) FILTER (u IN (SELECT u FROM booked WHERE paid)) AS total_payers FROM ss
), rates AS (
  SELECT *, {_share('total_viewers', 'total_searchers')} AS search_to_view_rate,
    {_share('total_reservers', 'total_viewers')} AS view_to_reserve_rate,
    {_share('total_payers', 'total_reservers')} AS reserve_to_pay_rate,
    {_share('total_payers', 'total_searchers')} AS overall_rate,
    total_searchers - total_viewers AS lost_after_search,
    total_viewers - total_reservers AS lost_after_view,
    total_reservers - total_payers AS lost_after_reserve
  FROM c
) SELECT *, 100 - search_to_view_rate AS search_dropoff_pct,
    100 - view_to_reserve_rate AS view_dropoff_pct,
    100 - reserve_to_pay_rate AS reserve_dropoff_pct FROM rates"""


_DIRECT = """SELECT renter_user_id AS u, successful_payment_collected_at IS NOT NULL AS paid
  FROM reservations"""
_BY_MAP = """SELECT m.merged_amplitude_id AS u, successful_payment_collected_at IS NOT NULL AS paid
  FROM reservations, amplitude_user_ids m WHERE m.user_id = renter_user_id"""


# A row per fact and user is counted on its own; the identity only looks them up.
_JOURNEY = """, own_searches AS (
  SELECT merged_amplitude_id AS u, count(DISTINCT search_id) AS ids,
    count(DISTINCT event_uuid) AS events, min(event_time) AS t0, max(event_time) AS t1
  FROM s GROUP BY ALL
), own_views AS (
  SELECT merged_amplitude_id AS u, count(DISTINCT listing_id) AS ids,
    count(DISTINCT event_uuid) AS events, min(event_time) AS t0, max(event_time) AS t1
  FROM l GROUP BY ALL
), own_bookings AS (
  SELECT renter_user_id AS u, count(DISTINCT reservation_id) AS ids,
    count(DISTINCT reservation_id) FILTER (successful_payment_collected_at IS NOT NULL) AS paid
  FROM r GROUP BY ALL
), journey AS (
  SELECT m.user_id, m.merged_amplitude_id,
    ifnull(a.ids, 0) AS total_searches, ifnull(a.events, 0) AS total_search_events,
    a.t0 AS first_search_time, a.t1 AS last_search_time,
    ifnull(b.ids, 0) AS unique_listings_viewed, ifnull(b.events, 0) AS total_view_events,
    b.t0 AS first_view_time, b.t1 AS last_view_time,
    ifnull(c.ids, 0) AS total_reservations, ifnull(c.paid, 0) AS successful_payments,
    CAST(unique_listings_viewed > 0 AS INTEGER) AS has_viewed_listing,
    CAST(total_reservations > 0 AS INTEGER) AS has_made_reservation,
    CAST(successful_payments > 0 AS INTEGER) AS has_completed_payment
  FROM (SELECT DISTINCT * FROM amplitude_user_ids) m
  LEFT JOIN own_searches a ON a.u = m.merged_amplitude_id
  LEFT JOIN own_views b ON b.u = m.merged_amplitude_id
  LEFT JOIN own_bookings c ON c.u = m.user_id
)"""

_JOURNEY_FUNNEL = _JOURNEY + f""", people AS (
  SELECT merged_amplitude_id, sum(total_searches) AS a, sum(has_viewed_listing) AS b,
    sum(has_made_reservation) AS c, sum(has_completed_payment) AS d FROM journey GROUP BY 1
), f AS (
  SELECT count(*) AS total_users, count(*) FILTER (a > 0) AS users_who_searched,
    count(*) FILTER (b > 0) AS users_who_viewed, count(*) FILTER (c > 0) AS users_who_reserved,
    count(*) FILTER (d > 0) AS users_who_paid FROM people
) SELECT *, {_rate('users_who_viewed', 'users_who_searched', 'search_to_view_rate')},
  {_rate('users_who_reserved', 'users_who_viewed', 'view_to_reserve_rate')},
  {_rate('users_who_paid', 'users_who_reserved', 'reserve_to_pay_rate')},
  {_rate('users_who_paid', 'users_who_searched', 'overall_conversion_rate')} FROM f"""

_OVERLAP = f""", c AS (
  SELECT (SELECT count(*) FROM ss) AS total_searchers,
    (SELECT count(*) FROM cc) AS total_clickers,
    (SELECT count(*) FROM rr) AS total_reservers,
    (SELECT count(*) FROM sc) AS searched_and_clicked,
    (SELECT count(*) FROM scr) AS searched_clicked_reserved
) SELECT *, {_share('searched_and_clicked', 'total_searchers')} AS search_to_click_rate,
  {_share('searched_clicked_reserved', 'searched_and_clicked')} AS click_to_reserve_rate,
  {_share('searched_clicked_reserved', 'total_searchers')} AS search_to_reserve_rate FROM c"""

_ORDERED = """, counted AS (
  SELECT reservation_id, renter_user_id AS user_id,
    (SELECT count(*) FROM search_events e WHERE e.merged_amplitude_id = r.renter_user_id
      AND e.event_time <= r.created_at) AS searches,
    (SELECT count(*) FROM listing_views e WHERE e.merged_amplitude_id = r.renter_user_id
      AND e.event_time <= r.created_at) AS clicks,
    created_at AS reservation_time, listing_id
  FROM r
), funnel AS (SELECT * FROM counted WHERE searches > 0 AND clicks > 0)"""


def _bot_impact() -> str:
    sides = []
    for side, s, l in (("all", "search_events", "listing_views"), ("non_bot", "s", "l")):
        sides.append(f"""
  (SELECT count(DISTINCT merged_amplitude_id) FROM {s}) AS {side}_searchers,
  (SELECT count(DISTINCT merged_amplitude_id) FROM {l}) AS {side}_clickers,
  (SELECT count(DISTINCT merged_amplitude_id) FROM {s} WHERE merged_amplitude_id IN
    (SELECT merged_amplitude_id FROM {l})) AS {side}_searched_and_clicked,
  (SELECT count(DISTINCT merged_amplitude_id) FROM {s} WHERE merged_amplitude_id IN
    (SELECT merged_amplitude_id FROM {l}) AND merged_amplitude_id IN
    (SELECT renter_user_id FROM reservations)) AS {side}_funnel_users""")
    rates = ", ".join(
        f"{_share(f'{x}_searched_and_clicked', f'{x}_searchers')} AS {x}_search_to_click_rate, "
        f"{_share(f'{x}_funnel_users', f'{x}_searched_and_clicked')} "
        f"AS {x}_click_to_reserve_rate, "
        f"{_share(f'{x}_funnel_users', f'{x}_searchers')} AS {x}_search_to_reserve_rate"
        for x in ("all", "non_bot"))
    return f""", c AS (SELECT {','.join(sides)},
  (SELECT count(DISTINCT renter_user_id) FROM reservations) AS total_reservers
), rates AS (SELECT *, {rates} FROM c)
SELECT *,
  (non_bot_searchers - all_searchers) / nullif(all_searchers, 0) * 100 AS searcher_change_pct,
  (non_bot_funnel_users - all_funnel_users) / nullif(all_funnel_users, 0) * 100
    AS funnel_change_pct,
  non_bot_search_to_reserve_rate - all_search_to_reserve_rate AS rate_change_pp
FROM rates"""


def _segment_funnel(expression: str, name: str, tail: str) -> str:
    return _RAW_SETS + f""", users AS (
  SELECT DISTINCT {expression} AS {name}, merged_amplitude_id AS u FROM search_events
  WHERE {expression} IS NOT NULL
), c AS (
  SELECT {name}, count(*) AS total_searchers,
    count(*) FILTER (u IN (SELECT u FROM cc)) AS total_clickers,
    count(*) FILTER (u IN (SELECT u FROM rr)) AS total_reservers,
    count(*) FILTER (u IN (SELECT u FROM cc)) AS searched_and_clicked,
    count(*) FILTER (u IN (SELECT u FROM scr)) AS searched_clicked_reserved
  FROM users GROUP BY {name}
), funnel AS (
  SELECT *, {_share('searched_and_clicked', 'total_searchers')} AS search_to_click_rate,
    {_share('searched_clicked_reserved', 'searched_and_clicked')} AS click_to_reserve_rate,
    {_share('searched_clicked_reserved', 'total_searchers')} AS search_to_reserve_rate FROM c
) SELECT * FROM funnel {tail}"""


def _channel(tail: str = "") -> str:
    return _segment_funnel("first_attribution_channel", "channel", tail)


def _source_channel(tail: str = "") -> str:
    return _segment_funnel(
        "first_attribution_source || ' - ' || first_attribution_channel", "source_channel", tail)


_DROPOFF = _RAW_SETS + f""", c AS (
  SELECT (SELECT count(*) FROM ss) AS total_searchers, (SELECT count(*) FROM cc) AS total_clickers,
    (SELECT count(*) FROM (SELECT u FROM ss EXCEPT SELECT u FROM cc)) AS searched_not_clicked,
    (SELECT count(*) FROM (SELECT u FROM cc EXCEPT SELECT u FROM rr)) AS clicked_not_reserved,
    (SELECT count(*) FROM (SELECT u FROM ss EXCEPT SELECT u FROM scr))
      AS non_converting_searchers
) SELECT *, {_share('searched_not_clicked', 'total_searchers')} AS search_to_click_dropoff_rate,
  {_share('clicked_not_reserved', 'total_clickers')} AS click_to_reserve_dropoff_rate,
  {_share('non_converting_searchers', 'total_searchers')} AS non_conversion_rate FROM c"""


def _view_performance(keys: str, averages: bool, tail: str = "", least: int = 0,
                      source: str = "s") -> str:
    """Searchers from the searches, viewers over EXISTS, means with each search's views."""
    names = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"x.{n} IS NOT DISTINCT FROM g.{n}" for n in names)
    weight = "greatest(1, (SELECT count(*) FROM l WHERE l.search_id = w.search_id))"
    means = f""",
    (SELECT round(sum(count_results * n) / sum(n), 2) FROM weighted x WHERE {same})
      AS avg_results,
    (SELECT round(avg(count_results), 2) FROM weighted x WHERE {same}) AS avg_results_unweighted""" \
        if averages else ""
    return f"""
  WITH weighted AS (SELECT {keys}, count_results, {weight} AS n FROM {source} w
    WHERE count_results IS NOT NULL),
  pairs AS (SELECT DISTINCT {keys}, merged_amplitude_id AS viewer FROM (
    SELECT DISTINCT {keys}, search_id FROM {source}) JOIN (
    SELECT DISTINCT search_id, merged_amplitude_id FROM l) USING (search_id)),
  g AS (SELECT {keys}, count(DISTINCT merged_amplitude_id) AS unique_searchers,
    count(DISTINCT search_id) AS total_searches FROM {source} GROUP BY ALL),
  h AS (SELECT *, (SELECT count(viewer) FROM pairs x WHERE {same}) AS unique_viewers{means}
    FROM g)
  SELECT *, {_rate('unique_viewers', 'unique_searchers', 'conversion_rate')} FROM h
  WHERE unique_searchers >= {least} {tail}"""


_SEARCH_TYPE = _view_performance("search_type", True)
_ATTRIBUTION = _view_performance(
    "first_attribution_source, first_attribution_channel", False,
    "ORDER BY unique_searchers DESC, first_attribution_source, first_attribution_channel LIMIT 10",
    Q.MIN_ATTRIBUTION_USERS)
# Every number of a market or month is a count of its own over distinct users.
_DMA = f"""
  WITH shown AS (SELECT DISTINCT click_dma AS market, listing_id FROM l),
  g AS (SELECT search_dma, count(DISTINCT merged_amplitude_id) AS unique_searchers FROM s
    GROUP BY 1),
  h AS (SELECT *,
    (SELECT count(DISTINCT merged_amplitude_id) FROM l WHERE click_dma = search_dma)
      AS unique_viewers,
    (SELECT count(DISTINCT renter_user_id) FROM r JOIN shown USING (listing_id)
      WHERE market = search_dma) AS unique_reservers,
    (SELECT count(DISTINCT renter_user_id) FROM r JOIN shown USING (listing_id)
      WHERE market = search_dma AND successful_payment_collected_at IS NOT NULL)
      AS unique_payers FROM g)
  SELECT *, {_rate('unique_viewers', 'unique_searchers', 'search_to_view_rate')},
    {_rate('unique_reservers', 'unique_viewers', 'view_to_reserve_rate')},
    {_rate('unique_payers', 'unique_reservers', 'reserve_to_pay_rate')}
  FROM h WHERE unique_searchers >= {Q.MIN_DMA_USERS}
  ORDER BY unique_searchers DESC, search_dma LIMIT 10"""
_MONTHLY = f"""
  WITH booked AS (SELECT day(created_at) AS month, renter_user_id AS u,
    bool_or(successful_payment_collected_at IS NOT NULL) AS paid FROM r GROUP BY 1, 2),
  g AS (SELECT month, count(DISTINCT merged_amplitude_id) AS unique_searchers,
    count(DISTINCT search_id) AS total_searches,
    round(avg(count_results), 2) AS avg_search_results FROM s GROUP BY 1),
  h AS (SELECT *,
    (SELECT count(DISTINCT merged_amplitude_id) FROM l WHERE l.month = g.month) AS unique_viewers,
    (SELECT count(*) FROM booked WHERE booked.month = g.month) AS unique_reservers,
    (SELECT count(*) FROM booked WHERE booked.month = g.month AND paid) AS unique_payers FROM g)
  SELECT *, {_share('unique_viewers', 'unique_searchers')} AS search_to_view_rate FROM h"""
_RESULT_RANGES = ("0 0 No Results; 1 10 1-10 Results; 11 50 11-50 Results; "
                  "51 100 51-100 Results; 101 200 101-200 Results")
_RESULT_CATEGORY = _label("count_results", _RESULT_RANGES, "'200+ Results'")
_RESULT_ORDER = """list_position(['No Results', '1-10 Results', '11-50 Results', '51-100 Results',
    '101-200 Results', '200+ Results'], result_count_category)"""
_RESULT_COUNT = f"""
  , labelled AS (SELECT *, {_RESULT_CATEGORY} AS result_count_category FROM s)
  SELECT *, CAST({_RESULT_ORDER} AS INTEGER) AS label_order FROM ({
    _view_performance('result_count_category', False, source='labelled')})"""
_HOURLY = f"""
  , seen AS (SELECT DISTINCT hour(event_time) AS h, merged_amplitude_id AS u FROM l),
  g AS (SELECT CAST(hour(event_time) AS INTEGER) AS search_hour,
    count(DISTINCT merged_amplitude_id) AS unique_searchers,
    count(DISTINCT search_id) AS total_searches FROM s GROUP BY 1),
  h AS (SELECT *, (SELECT count(u) FROM seen WHERE h = search_hour) AS unique_viewers FROM g)
  SELECT *, {_rate('unique_viewers', 'unique_searchers', 'conversion_rate')} FROM h"""

# Hours from whole microseconds.
_HOURS_APPROVAL = "(epoch_us(approved_at) - epoch_us(created_at)) / 3600000000.0::DOUBLE"
_HOURS_PAYMENT = """(epoch_us(successful_payment_collected_at) - epoch_us(created_at))
    / 3600000000.0::DOUBLE"""
_IS_PAID, _IS_APPROVED = "successful_payment_collected_at IS NOT NULL", "approved_at IS NOT NULL"
_PAID = f"count(*) FILTER ({_IS_PAID})"
_PENDING = f"count(*) FILTER ({_IS_APPROVED} AND NOT ({_IS_PAID}))"
_REJECTED = f"count(*) FILTER (NOT ({_IS_APPROVED}))"


def _payments(table: str) -> str:
    return f"""SELECT total_reservations, successful_payments, pending_payments,
  rejected_reservations,
  {_rate('successful_payments', 'total_reservations', 'payment_completion_rate')},
  round(waited_approval, 2) AS avg_hours_to_approval,
  round(waited_payment, 2) AS avg_hours_to_payment
  FROM (SELECT count(*) AS total_reservations, {_PAID} AS successful_payments,
    {_PENDING} AS pending_payments, {_REJECTED} AS rejected_reservations,
    avg({_HOURS_APPROVAL}) AS waited_approval, avg({_HOURS_PAYMENT}) AS waited_payment
    FROM {table})"""


# The further of the two steps that a reservation has reached.
_STATUS = f"""['Pending Approval', 'Pending Payment', 'Completed'][
    1 + greatest(2 * CAST({_IS_PAID} AS INTEGER), CAST({_IS_APPROVED} AS INTEGER))]"""


def _cleaned_reservations(table: str) -> str:
    return f"""SELECT *, {_STATUS} AS reservation_status, {_HOURS_APPROVAL} AS hours_to_approval,
  {_HOURS_PAYMENT} AS hours_to_payment,
  CAST(month(created_at) AS INTEGER) AS reservation_month FROM {table}"""


def _long(tag: str, query: str, segment: str, metrics: str) -> str:
    names = metrics.split()
    listed = ", ".join(f"'{m}'" for m in names)
    values = ", ".join(f"CAST({m} AS DOUBLE)" for m in names)
    return f"""SELECT '{tag}' AS analysis_type, {segment} AS segment,
  unnest([{listed}]) AS metric, unnest([{values}]) AS value FROM ({query})"""


def _tagged_report() -> str:
    funnel = "SELECT * FROM f2"
    head = _JOURNEY_FUNNEL.rsplit(") SELECT *,", 1)
    ctes = head[0] + "), f2 AS (SELECT *," + head[1] + ")"
    parts = [
        _long("FUNNEL_METRICS", funnel, "'(all)'",
              "total_users users_who_searched users_who_viewed users_who_reserved "
              "users_who_paid search_to_view_rate view_to_reserve_rate reserve_to_pay_rate "
              "overall_conversion_rate"),
        _long("SEARCH_TYPE_ANALYSIS", _SEARCH_TYPE, "search_type",
              "unique_searchers unique_viewers total_searches avg_results "
              "avg_results_unweighted conversion_rate"),
        _long("ATTRIBUTION_ANALYSIS", _ATTRIBUTION,
              "first_attribution_source || ' / ' || first_attribution_channel",
              "unique_searchers unique_viewers total_searches conversion_rate"),
        _long("DMA_ANALYSIS", _DMA, "search_dma",
              "unique_searchers unique_viewers unique_reservers unique_payers "
              "search_to_view_rate view_to_reserve_rate reserve_to_pay_rate"),
        _long("MONTHLY_TRENDS", _MONTHLY, "CAST(month AS VARCHAR)",
              "unique_searchers unique_viewers unique_reservers unique_payers total_searches "
              "avg_search_results search_to_view_rate"),
        _long("PAYMENT_ANALYSIS", _payments("order_reservations"), "'(all)'",
              "total_reservations successful_payments pending_payments rejected_reservations "
              "payment_completion_rate avg_hours_to_approval avg_hours_to_payment"),
    ]
    return ctes + " " + " UNION ALL ".join(parts)


_WEEKDAY = "dayname(event_time)"
_RESULT_BIN = _label(
    "count_results", "1 10 1-10; 11 50 11-50; 51 100 51-100; 101 200 101-200; 201 1000 200+")
_LENGTH_BIN = _label("length(search_term)", "1 5 1-5 chars; 6 10 6-10 chars; "
                     "11 15 11-15 chars; 16 30 16-30 chars; 31 100 30+ chars")
_HOUR_BIN = _label("hour(event_time)", "1 6 Night (0-6); 7 12 Morning (6-12); "
                   "13 18 Afternoon (12-18); 19 24 Evening (18-24)")
_OWN_SEARCHES = """(SELECT count(*) FROM search_events i
    WHERE i.merged_amplitude_id = e.merged_amplitude_id)"""
_FREQUENCY_BIN = _label(_OWN_SEARCHES, "1 1 1 search; 2 3 2-3 searches; 4 10 4-10 searches; "
                        "11 100 10+ searches")

_SEARCH_SEGMENTS = {
    "search_type": "search_type", "search_term_category": "search_term_category",
    "search_sort": "search_sort", "dma": "search_dma", "result_count": _RESULT_BIN,
    "term_length": _LENGTH_BIN, "geo": "CAST(is_usa_canada AS VARCHAR)",
    "bot": "CAST(is_bot AS VARCHAR)", "host": "CAST(is_host AS VARCHAR)",
    "month": "CAST(month AS VARCHAR)", "day_of_week": _WEEKDAY, "hour": _HOUR_BIN,
    "search_frequency": _FREQUENCY_BIN,
}
_ATTRIBUTION_SEGMENTS = {
    "source": "first_attribution_source", "channel": "first_attribution_channel"}


def _pairs(segments: dict[str, str], table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT DISTINCT '{name}' AS dimension, {expression} AS segment, "
        f"merged_amplitude_id AS u FROM {table} e WHERE ({expression}) IS NOT NULL"
        for name, expression in segments.items())


def _segments(segments: dict[str, str], hit: str, count: str, rate: str, minimum: int,
              sets: str = _RAW_SETS, table: str = "search_events") -> str:
    return sets + f""", pairs AS ({_pairs(segments, table)}), c AS (
  SELECT dimension, segment, count(*) AS total_searchers, count(*) FILTER ({hit}) AS {count}
  FROM pairs GROUP BY dimension, segment
) SELECT *, {_share(count, 'total_searchers')} AS {rate} FROM c
  WHERE total_searchers >= {minimum}"""


_CONVERTED = "u IN (SELECT u FROM scr)"
_TERM = {"search_term": "search_term"}


def _single_cte(column: str) -> str:
    """Common table ``m``: conversion by one column of the human searches."""
    return _HUMAN_SETS + f""", pairs AS (
  SELECT DISTINCT {column}, merged_amplitude_id AS u FROM s WHERE {column} IS NOT NULL
), c AS (
  SELECT {column}, count(*) AS total_searchers, count(*) FILTER ({_CONVERTED}) AS funnel_users
  FROM pairs GROUP BY {column}
), m AS (SELECT *, {_share('funnel_users', 'total_searchers')} AS conversion_rate FROM c)"""


def _single(column: str) -> str:
    return _single_cte(column) + " SELECT * FROM m"


def _spine(name: str, expression: str, labels: list[str], users: str, hits: str,
           table: str = "s", hit: str = _CONVERTED, sets: str = _HUMAN_SETS) -> str:
    """Common table ``spined``: one row per label, zeros where there are no users."""
    values = ", ".join(f"({label}, {i})" for i, label in enumerate(labels, 1))
    return sets + f""", labels({name}, {name}_order) AS (VALUES {values}), pairs AS (
  SELECT DISTINCT {expression} AS {name}, merged_amplitude_id AS u FROM {table}
), c AS (
  SELECT labels.{name}, {name}_order, count(u) AS {users}, count(u) FILTER ({hit}) AS {hits}
  FROM labels LEFT JOIN pairs ON labels.{name} = pairs.{name} GROUP BY ALL
), spined AS (SELECT *, {_share(hits, users)} AS conversion_rate FROM c)"""


_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
_BY_WEEKDAY = _spine("day_of_week", _WEEKDAY, [f"'{d}'" for d in _DAYS], "total_searchers",
                     "funnel_users")
_BY_HOST = _spine("user_type", "CASE WHEN is_host THEN 'Hosts' ELSE 'Non-Hosts' END",
                  ["'Hosts'", "'Non-Hosts'"], "total_searchers", "funnel_users")
_BY_GEO = _spine("characteristic",
                 "CASE WHEN is_usa_canada THEN 'USA/Canada' ELSE 'International' END",
                 ["'USA/Canada'", "'International'"], "total_users", "converting_users")
_PEAK = """CASE WHEN hour(event_time) >= 9 AND hour(event_time) <= 17 THEN 'Peak Hours (9-17)'
    ELSE 'Off-Peak Hours' END"""
_BY_PEAK = _spine("characteristic", _PEAK, ["'Peak Hours (9-17)'", "'Off-Peak Hours'"],
                  "total_users", "converting_users")
_BY_POSITION = _spine("search_position", "search_position", [str(p) for p in range(1, 21)],
                      "total_clickers", "funnel_users", "l", "u IN (SELECT u FROM rr)")
_BY_POSITION_10 = _spine("search_position", "search_position", [str(p) for p in range(1, 11)],
                         "total_users", "converting_users", "l")
_BUCKET = _label("search_position", "1 5 Positions 1-5; 6 10 Positions 6-10; "
                 "11 15 Positions 11-15; 16 20 Positions 16-20")
_BUCKETS = ["'Positions 1-5'", "'Positions 6-10'", "'Positions 11-15'", "'Positions 16-20'"]
_APPROVED = """u IN (SELECT renter_user_id FROM reservations WHERE approved_at IS NOT NULL)"""
_BY_BUCKET = _spine("position_bucket", _BUCKET, _BUCKETS, "total_clickers", "converting_users",
                    "l", _APPROVED)


def _position_insights(rate: str, total: str, source: str) -> str:
    return f""", v AS (SELECT search_position AS p, {rate} AS x FROM {source} WHERE {total} > 0),
t AS (
  SELECT (SELECT avg(x) FROM v WHERE p <= 5) AS top_avg,
    (SELECT avg(x) FROM v WHERE p > 5) AS rest_avg, (SELECT avg(x) FROM v) AS avg_rate,
    (SELECT x FROM v ORDER BY p LIMIT 1) AS first_rate,
    (SELECT x FROM v ORDER BY p DESC LIMIT 1) AS last_rate,
    (SELECT max(p) - min(p) FROM v) AS steps
) SELECT round(top_avg, 6) AS top_avg, round(rest_avg, 6) AS rest_avg,
  round(avg_rate, 6) AS avg_rate, round(first_rate, 6) AS first_rate,
  round(last_rate, 6) AS last_rate, round(top_avg - rest_avg, 6) AS top_minus_rest,
  round(first_rate - last_rate, 6) AS decline,
  round((first_rate - last_rate) / nullif(steps, 0), 6) AS decline_per_step FROM t"""


_CLICKS = """, labels AS (SELECT CAST(range AS INTEGER) AS search_position FROM range(1, 21)),
c AS (SELECT search_position, (SELECT count(*) FROM l x
    WHERE x.search_position = labels.search_position) AS total_clicks FROM labels),
clicks AS (
  SELECT search_position, total_clicks,
    total_clicks / (SELECT count(*) FROM l) * 100 AS click_percentage,
    CAST((SELECT sum(total_clicks) FROM c b WHERE b.search_position <= c.search_position)
      AS BIGINT) / (SELECT count(*) FROM l) * 100 AS cumulative_percentage FROM c
)"""

_SORTS = f""", sorted AS (SELECT * FROM s WHERE search_sort IS NOT NULL),
viewers AS (SELECT DISTINCT merged_amplitude_id AS u FROM listing_views),
c AS (
  SELECT search_sort, count(DISTINCT merged_amplitude_id) AS total_users,
    count(DISTINCT merged_amplitude_id) FILTER
      (EXISTS (SELECT 1 FROM viewers WHERE u = merged_amplitude_id)) AS converting_users,
    count(*) AS total_searches, round(avg(count_results), 6) AS avg_results
  FROM sorted GROUP BY search_sort
) SELECT *, round({_share('converting_users', 'total_users')}, 6) AS conversion_rate,
  round(total_searches / total_users, 6) AS avg_searches_per_user,
  round((SELECT count(DISTINCT merged_amplitude_id) FROM sorted
      WHERE merged_amplitude_id IN (SELECT u FROM viewers))
    / (SELECT count(DISTINCT merged_amplitude_id) FROM sorted) * 100, 6) AS overall_rate
FROM c"""

_STATS = f""", vc AS (SELECT listing_id, count(*) AS total_views FROM item_views GROUP BY 1),
stats AS (
  SELECT vc.listing_id, total_views,
    (SELECT count(*) FROM item_reservations x WHERE x.listing_id = vc.listing_id)
      AS total_reservations,
    vc.listing_id IN (SELECT listing_id FROM item_reservations) AS was_reserved
  FROM vc
), rated AS (SELECT *, {_share('total_reservations', 'total_views')} AS conversion_rate
  FROM stats)"""

_POSITION_BIN = _label(
    "search_position", "1 5 1-5; 6 10 6-10; 11 15 11-15; 16 20 16-20; 21 100 20+")
_LISTING_BIN = _label("listing_id", "1 100 1-100; 101 500 101-500; 501 1000 501-1000; "
                      "1001 2000 1001-2000; 2001 10000 2000+")
_ITEM_SEGMENTS = {
    "position": _POSITION_BIN, "source_screen": "source_screen",
    "month": "CAST(month AS VARCHAR)", "day_of_week": _WEEKDAY,
    "is_listing_reserved": "CAST(is_listing_reserved AS VARCHAR)", "listing_id": _LISTING_BIN,
}
_VIEW_SEGMENTS = _ITEM_SEGMENTS | {
    "dma": "click_dma", "source": "first_attribution_source",
    "channel": "first_attribution_channel", "bot": "CAST(is_bot AS VARCHAR)",
    "host": "CAST(is_host AS VARCHAR)", "hour": _HOUR_BIN, "hex_1": "hex_1_resolution",
}


def _listing_segments(segments: dict[str, str], views: str, booked: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS dimension, {expression} AS segment, listing_id FROM {views} "
        f"WHERE ({expression}) IS NOT NULL" for name, expression in segments.items())
    return f""", tagged AS ({rows}),
booked AS (SELECT listing_id, count(*) AS n FROM {booked} GROUP BY 1),
listed AS (SELECT DISTINCT dimension, segment, listing_id FROM tagged),
a AS (SELECT dimension, segment, count(*) AS total_views FROM tagged GROUP BY 1, 2),
b AS (
  SELECT dimension, segment, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_reservations,
    count(*) AS unique_listings, count(n) AS reserved_listings
  FROM listed LEFT JOIN booked USING (listing_id) GROUP BY 1, 2
) SELECT dimension, segment, total_views, total_reservations, unique_listings, reserved_listings,
  {_share('total_reservations', 'total_views')} AS conversion_rate,
  {_share('reserved_listings', 'unique_listings')} AS listing_reservation_rate
FROM a JOIN b USING (dimension, segment) WHERE total_views >= {Q.MIN_SEGMENT_VIEWS}"""


_EXTREMES = _HUMAN_SETS + f""", pairs AS ({_pairs({
    "search_sort": "search_sort", "search_term_category": "search_term_category",
    "geography": "CASE WHEN is_usa_canada THEN 'USA/Canada' ELSE 'International' END",
    "user_type": "CASE WHEN is_host THEN 'Hosts' ELSE 'Non-Hosts' END", "time": _PEAK}, "s")}
  UNION ALL SELECT DISTINCT 'search_position', 'Position ' || CAST(p AS VARCHAR),
    merged_amplitude_id FROM range(1, 11) t(p) LEFT JOIN l ON search_position = p
), rates AS (
  SELECT dimension AS analysis, segment AS characteristic,
    {_share(f'count(u) FILTER ({_CONVERTED})', 'count(u)')} AS rate
  FROM pairs GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY analysis ORDER BY rate DESC, characteristic) AS up,
    row_number() OVER (PARTITION BY analysis ORDER BY rate, characteristic) AS down FROM rates
), bests AS (
  SELECT analysis, upper(replace(analysis, '_', ' ')) AS title,
    max(CASE WHEN up = 1 THEN characteristic END) AS best,
    max(CASE WHEN up = 1 THEN rate END) AS best_rate,
    max(CASE WHEN down = 1 THEN characteristic END) AS worst,
    max(CASE WHEN down = 1 THEN rate END) AS worst_rate, avg(rate) AS avg_rate
  FROM ranked GROUP BY analysis
)"""

_OPPORTUNITIES = f""", c AS (
  SELECT (SELECT count(DISTINCT merged_amplitude_id) FROM s) AS a,
    (SELECT count(DISTINCT s.merged_amplitude_id) FROM s JOIN l USING (merged_amplitude_id)) AS b,
    (SELECT count(DISTINCT s.merged_amplitude_id) FROM s
      JOIN r ON renter_user_id = s.merged_amplitude_id) AS d
), types AS ({_SEARCH_TYPE}), p AS ({_payments('order_reservations')})
SELECT 'Search-to-View Conversion' AS area, round({_share('b', 'a')}, 6) AS current_rate,
  a - b AS recoverable, CAST(NULL AS VARCHAR) AS best, CAST(NULL AS VARCHAR) AS worst FROM c
UNION ALL SELECT 'View-to-Reserve Conversion', round({_share('d', 'b')}, 6), b - d, NULL, NULL
FROM c
UNION ALL SELECT 'Search Type Optimization',
  round(max(conversion_rate) - min(conversion_rate), 6), NULL,
  (SELECT search_type FROM types ORDER BY conversion_rate DESC, search_type LIMIT 1),
  (SELECT search_type FROM types ORDER BY conversion_rate, search_type LIMIT 1) FROM types
UNION ALL SELECT 'Payment Completion', payment_completion_rate, pending_payments, NULL, NULL
FROM p"""


def _whole(query: str) -> str:
    """A query with tables of its own, behind the logical tables."""
    return f" SELECT * FROM ({query})"


def _cleaned(table: str, derived: str) -> str:
    return f"SELECT *, {derived} FROM {table}"


def _oracles() -> dict[str, str]:
    supported = f"WHERE total_searchers >= {Q.MIN_SOURCE_CHANNEL_USERS}"
    clicked = f"WHERE searched_and_clicked >= {Q.MIN_SOURCE_CHANNEL_CLICKERS}"
    position_category = _label(
        "search_position", "1 5 Top 5; 6 10 6-10; 11 20 11-20", "'20+'")
    converted = ("funnel_users", "conversion_rate")
    lost = ("non_converting_users", "non_conversion_rate")
    not_converted = "u NOT IN (SELECT u FROM scr)"
    all_segments = _SEARCH_SEGMENTS | _ATTRIBUTION_SEGMENTS
    status = f"""SELECT payment_status, reservations,
      reservations / CAST(sum(reservations) OVER () AS BIGINT) * 100 AS share_pct FROM"""
    return {
        "s03_filtered_scan": """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity
          FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45""",
        "s09_adhoc_sql": """SELECT search_type, search_sort, count(*) AS searches,
          count(DISTINCT merged_amplitude_id) AS users FROM s WHERE search_sort IS NOT NULL
          GROUP BY ALL HAVING searches >= 10""",
        "p14_search_bins": f"""SELECT event_uuid, count_results, search_term, event_time,
          is_host, is_usa_canada, {_RESULT_BIN} AS result_count_label,
          {_LENGTH_BIN} AS term_length_label, {_WEEKDAY} AS day_of_week_label,
          {_HOUR_BIN} AS hour_label, {_PEAK} AS time_label,
          CASE WHEN is_host THEN 'Hosts' ELSE 'Non-Hosts' END AS user_type_label,
          CASE WHEN is_usa_canada THEN 'USA/Canada' ELSE 'International' END
            AS geography_label FROM search_events""",
        "p18_view_bins": f"""SELECT listing_id, search_position, event_time,
          {_POSITION_BIN} AS position_label, {_BUCKET} AS position_bucket_label,
          {_LISTING_BIN} AS listing_id_label FROM item_views""",
        "w02_search_frequency": f"""SELECT merged_amplitude_id AS user_id,
          count(*) AS searches, any_value({_FREQUENCY_BIN}) AS search_frequency
          FROM search_events e WHERE merged_amplitude_id IS NOT NULL GROUP BY 1""",
        "u01_funnel_users": _RAW_SETS + " SELECT u AS user_id FROM scr",
        "u02_never_clicked_users": _RAW_SETS
        + " SELECT u AS user_id FROM ss EXCEPT SELECT u FROM cc",
        "q01_funnel_counts": _stage_counts(_DIRECT),
        "q01_funnel_counts_mapped": _stage_counts(_BY_MAP),
        "q02_user_journey": _JOURNEY + " SELECT * FROM journey",
        "q03_funnel_from_journey": _JOURNEY_FUNNEL,
        "q04_funnel_overlap": _RAW_SETS + _OVERLAP,
        "q04_funnel_overlap_no_bots": _HUMAN_SETS + _OVERLAP,
        "q05_ordered_funnel": _ORDERED + " SELECT * FROM funnel",
        "q05_ordered_funnel_summary": _ORDERED + """ SELECT count(*) AS reservations,
          count(DISTINCT user_id) AS users, round(avg(searches), 6) AS avg_searches,
          round(avg(clicks), 6) AS avg_clicks FROM funnel""",
        "q06_bot_impact": _bot_impact(),
        "q07_funnel_by_channel": _channel(),
        "q07_high_volume_channels": _channel(f"WHERE total_searchers >= {Q.MIN_CHANNEL_USERS}"),
        "q07_top_channels": _channel("ORDER BY search_to_reserve_rate DESC, channel LIMIT 5"),
        "q08_funnel_by_source_channel": _source_channel(supported),
        "q08_top_conversion": _source_channel(
            f"{supported} ORDER BY search_to_reserve_rate DESC, source_channel LIMIT 5"),
        "q08_top_volume": _source_channel(
            "ORDER BY total_searchers DESC, source_channel LIMIT 5"),
        "q08_top_click_to_reserve": _source_channel(
            f"{clicked} ORDER BY click_to_reserve_rate DESC, source_channel LIMIT 5"),
        "q08_source_channel_volume": """SELECT
          first_attribution_source || ' - ' || first_attribution_channel AS source_channel,
          count(*) AS searches FROM search_events GROUP BY 1 HAVING source_channel IS NOT NULL""",
        "q09_dropoff": _DROPOFF,
        "q10_search_type_performance": _whole(_SEARCH_TYPE),
        "q11_attribution_performance": _whole(_ATTRIBUTION),
        "q12_dma_performance": _whole(_DMA),
        "q13_category_performance": _whole(_view_performance("search_term_category", True)),
        "q14_result_count_performance": _RESULT_COUNT,
        "q15_hourly_patterns": _HOURLY,
        "q16_monthly_trends": _whole(_MONTHLY),
        "q17_search_type_volume": """SELECT search_type, count(*) AS events,
          count(DISTINCT merged_amplitude_id) AS unique_users FROM s GROUP BY 1""",
        "q18_top_dmas": """SELECT search_dma, count(DISTINCT merged_amplitude_id)
          AS unique_searchers FROM s WHERE search_dma IS NOT NULL GROUP BY 1
          ORDER BY 2 DESC, 1 LIMIT 15""",
        "q19_top_attribution": f"""SELECT first_attribution_source, first_attribution_channel,
          count(DISTINCT merged_amplitude_id) AS unique_users FROM s
          WHERE first_attribution_source IS NOT NULL GROUP BY 1, 2
          HAVING unique_users >= {Q.MIN_ATTRIBUTION_USERS} ORDER BY 3 DESC, 1, 2 LIMIT 10""",
        "q20_monthly_volume": """SELECT month, count(*) AS events,
          count(DISTINCT merged_amplitude_id) AS unique_users FROM s GROUP BY 1""",
        "q21_category_volume": """SELECT search_term_category, count(*) AS events,
          count(DISTINCT merged_amplitude_id) AS unique_users FROM s
          WHERE search_term_category IS NOT NULL GROUP BY 1""",
        "q22_payment_summary": _payments("order_reservations"),
        "q22_payment_summary_cleaned": _payments("reservations"),
        "q23_monthly_payments": f"""SELECT CAST(month(created_at) AS INTEGER)
          AS reservation_month, count(*) AS total_reservations, {_PAID} AS successful_payments,
          {_rate(_PAID, 'count(*)', 'payment_completion_rate')}
          FROM order_reservations GROUP BY 1""",
        "q24_cleaned_reservations": _cleaned_reservations("reservations"),
        "q24_cleaned_orders": _cleaned_reservations("order_reservations"),
        "q25_tagged_report": _tagged_report(),
        "q26_cleaned_searches": _cleaned(
            "s", f"{_RESULT_CATEGORY} AS result_count_category, "
            "CAST(hour(event_time) AS INTEGER) AS search_hour, "
            "CAST(merged_amplitude_id AS VARCHAR) || '_' "
            "|| CAST(CAST(event_time AS DATE) AS VARCHAR) AS search_session_id"),
        "q26_cleaned_views": _cleaned(
            "l", f"{position_category} AS position_category, "
            "CAST(hour(event_time) AS INTEGER) AS view_hour"),
        "q27_payment_status": f"""{status} (
          SELECT 'Successful' AS payment_status, {_PAID} AS reservations FROM order_reservations
          UNION ALL SELECT 'Pending', {_PENDING} FROM order_reservations
          UNION ALL SELECT 'Rejected', {_REJECTED} FROM order_reservations)""",
        "q27_lifecycle_status": f"""SELECT {_STATUS} AS reservation_status,
          count(*) AS reservations,
          count(*) / (SELECT count(*) FROM order_reservations) * 100 AS share_pct
          FROM order_reservations GROUP BY 1""",
        "q30_search_characteristics": _segments(
            _SEARCH_SEGMENTS, _CONVERTED, *converted, Q.MIN_SEGMENT_USERS),
        "q30_top_search_terms": _segments(_TERM, _CONVERTED, *converted, Q.MIN_TERM_USERS)
        + " ORDER BY conversion_rate DESC, segment LIMIT 10",
        "q31_non_converting_searches": _segments(
            all_segments, not_converted, *lost, Q.MIN_SEGMENT_USERS),
        "q31_worst_search_terms": _segments(_TERM, not_converted, *lost, Q.MIN_TERM_USERS)
        + " ORDER BY non_conversion_rate DESC, segment LIMIT 10",
        "q32_never_clicked": _segments(
            {k: k for k in ("search_type", "search_term_category")},
            "u NOT IN (SELECT u FROM cc)", "never_clicked_users", "never_clicked_rate",
            Q.MIN_SEGMENT_USERS),
        "q33_weekday_conversion": _BY_WEEKDAY + " SELECT * FROM spined",
        "q33_weekday_weekend": _BY_WEEKDAY + """, m AS (SELECT
          (SELECT avg(conversion_rate) FROM spined WHERE day_of_week_order <= 5) AS a,
          (SELECT avg(conversion_rate) FROM spined WHERE day_of_week_order > 5) AS b)
          SELECT round(a, 6) AS weekday_avg, round(b, 6) AS weekend_avg,
          round((SELECT avg(conversion_rate) FROM spined), 6) AS avg_rate,
          round(a - b, 6) AS weekday_minus_weekend FROM m""",
        "q34_monthly_conversion": _single_cte("month") + """
          SELECT month, total_searchers, funnel_users, conversion_rate,
          round((SELECT avg(conversion_rate) FROM m), 6) AS avg_rate,
          CASE WHEN conversion_rate > (SELECT avg(conversion_rate) FROM m) THEN 'above'
            WHEN conversion_rate < (SELECT avg(conversion_rate) FROM m) THEN 'below'
            ELSE 'equal' END AS versus_average FROM m""",
        "q35_host_conversion": _BY_HOST + """ SELECT user_type, total_searchers, funnel_users,
          conversion_rate, total_searchers /
            CAST((SELECT sum(total_searchers) FROM spined) AS BIGINT) * 100 AS market_share
          FROM spined""",
        "q35_host_gap": _BY_HOST + """ SELECT round(h.conversion_rate, 6) AS host_rate,
          round(n.conversion_rate, 6) AS non_host_rate,
          round(h.conversion_rate - n.conversion_rate, 6) AS gap_pp,
          round((h.conversion_rate / nullif(n.conversion_rate, 0) - 1) * 100, 6)
            AS relative_pct
          FROM spined h, spined n WHERE h.user_type = 'Hosts' AND n.user_type = 'Non-Hosts'""",
        "q36_sort_preference": _single("search_sort"),
        "q37_term_category": _single("search_term_category"),
        "q38_geography": _BY_GEO + " SELECT * EXCLUDE (characteristic_order) FROM spined",
        "q39_peak_hours": _BY_PEAK + " SELECT * EXCLUDE (characteristic_order) FROM spined",
        "q40_position_conversion": _BY_POSITION
        + " SELECT * EXCLUDE (search_position_order) FROM spined",
        "q40_position_funnel": _BY_POSITION_10 + """ SELECT 'Position ' ||
          CAST(search_position AS VARCHAR) AS characteristic, total_users, converting_users,
          conversion_rate FROM spined""",
        "q40_position_insights": _BY_POSITION
        + _position_insights("conversion_rate", "total_clickers", "spined"),
        "q41_bucket_conversion": _BY_BUCKET + " SELECT * FROM spined",
        "q41_bucket_insights": _BY_BUCKET + """, m AS (SELECT
          (SELECT avg(conversion_rate) FROM spined WHERE position_bucket_order <= 2) AS a,
          (SELECT avg(conversion_rate) FROM spined WHERE position_bucket_order > 2) AS b)
          SELECT round(a, 6) AS top_10_avg, round(b, 6) AS lower_avg,
          round((SELECT avg(conversion_rate) FROM spined), 6) AS avg_rate,
          round(a - b, 6) AS top_minus_lower FROM m""",
        "q42_estimated_buckets": f""", labels(position_bucket) AS (VALUES
            {', '.join(f'({b})' for b in _BUCKETS)}),
          t AS (SELECT count(*) AS clicks, count(DISTINCT CASE WHEN merged_amplitude_id IN
            (SELECT renter_user_id FROM reservations WHERE approved_at IS NOT NULL)
            THEN merged_amplitude_id END) AS converted FROM l),
          b AS (SELECT {_BUCKET} AS position_bucket, * FROM l),
          c AS (SELECT labels.position_bucket,
            count(DISTINCT b.merged_amplitude_id) AS total_clickers,
            count(b.event_uuid) / (SELECT clicks FROM t) AS click_proportion
            FROM labels LEFT JOIN b ON b.position_bucket = labels.position_bucket GROUP BY 1),
          e AS (SELECT *, CAST(floor((SELECT converted FROM t) * click_proportion) AS BIGINT)
            AS estimated_converting_users FROM c)
          SELECT *, {_share('estimated_converting_users', 'total_clickers')}
            AS estimated_conversion_rate FROM e""",
        "q43_sort_conversion": _SORTS,
        "q44_click_distribution": _CLICKS + " SELECT * FROM clicks",
        "q44_click_insights": _CLICKS
        + _position_insights("click_percentage", "total_clicks", "clicks"),
        "q50_listing_stats": _STATS + " SELECT * FROM rated",
        "q51_listing_segments": _listing_segments(
            _ITEM_SEGMENTS, "item_views", "item_reservations"),
        "q51_listing_segments_events": _listing_segments(
            _VIEW_SEGMENTS, "listing_views", "reservations"),
        "q52_high_volume_listings": _STATS + f""" SELECT * EXCLUDE (was_reserved) FROM rated
          WHERE total_views >= {Q.HIGH_VOLUME_VIEWS}
          ORDER BY conversion_rate DESC, listing_id LIMIT 10""",
        "q53_listing_summary": f""", c AS (SELECT
          (SELECT count(*) FROM item_views) AS total_listing_views,
          (SELECT count(*) FROM item_reservations) AS total_reservations,
          (SELECT count(DISTINCT listing_id) FROM item_views) AS unique_listings_viewed,
          (SELECT count(DISTINCT listing_id) FROM item_reservations)
            AS unique_listings_reserved)
          SELECT *, {_share('total_reservations', 'total_listing_views')}
            AS overall_conversion_rate,
          {_share('unique_listings_reserved', 'unique_listings_viewed')}
            AS listing_reservation_rate FROM c""",
        "q54_top_listings": _STATS + f""" SELECT * FROM rated
          WHERE total_views >= {Q.MIN_TOP_LISTING_VIEWS}
          ORDER BY conversion_rate DESC, listing_id LIMIT 10""",
        "q55_extremes": _EXTREMES + """ SELECT analysis, title, best,
          round(best_rate, 6) AS best_rate, worst, round(worst_rate, 6) AS worst_rate,
          round(best_rate - worst_rate, 6) AS gap_pp, round(avg_rate, 6) AS avg_rate
          FROM bests""",
        "q56_top_characteristics": _EXTREMES + """ SELECT analysis, best, best_rate FROM bests
          ORDER BY best_rate DESC, analysis LIMIT 5""",
        "q57_opportunities": _OPPORTUNITIES,
        "q60_table_profile": """SELECT 'search_events' AS table_name, count(*) AS row_count
          FROM search_events UNION ALL SELECT 'listing_views', count(*) FROM listing_views
          UNION ALL SELECT 'reservations', count(*) FROM reservations
          UNION ALL SELECT 'amplitude_user_ids', count(*) FROM amplitude_user_ids""",
        "q61_bot_distribution": """SELECT CASE WHEN is_bot THEN 'True' ELSE 'False' END AS is_bot,
          count(*) AS row_count FROM search_events GROUP BY 1""",
        "q61_distinct_flags": """SELECT DISTINCT CASE WHEN is_bot THEN 'True' ELSE 'False' END
          AS is_bot FROM search_events""",
        "q62_sort_counts": """SELECT search_sort, count(*) AS row_count FROM search_events
          WHERE search_sort IS NOT NULL GROUP BY 1""",
        "q62_filter_counts": """SELECT 'all' AS filter_name, count(*) AS row_count
          FROM search_events
          UNION ALL SELECT 'not_bot', count(*) FROM search_events WHERE NOT is_bot
          UNION ALL SELECT 'sort_known', count(*) FROM search_events
            WHERE search_sort IS NOT NULL
          UNION ALL SELECT 'sort_known_not_bot', count(*) FROM search_events
            WHERE search_sort IS NOT NULL AND NOT is_bot""",
        "q63_linkage_check": """SELECT u AS user_id,
          (SELECT count(*) FROM s WHERE s.merged_amplitude_id = u) AS searches,
          (SELECT count(*) FROM l WHERE l.merged_amplitude_id = u) AS clicks,
          (SELECT count(*) FROM reservations WHERE renter_user_id = u) AS reservations
          FROM (SELECT DISTINCT merged_amplitude_id AS u FROM s)""",
    }


#: The tables with reservations that went through a map which is not the identity.
_ACCOUNTS = _TABLES.replace("\nreservations AS (", "\nunlinked AS (").replace(
    "amplitude_user_ids AS (", f"""accounts AS (
  SELECT c_custkey AS searcher, c_custkey + {B.FIRST} AS account FROM customer
  WHERE c_custkey % 7 <> 3
  UNION SELECT c_custkey, c_custkey + {B.SECOND} FROM customer WHERE c_custkey % 7 <> 3
  UNION SELECT c_custkey + 1, c_custkey + {B.FIRST} FROM customer WHERE c_custkey % 11 = 0
),
account_reservations AS (
  SELECT * REPLACE (renter_user_id + CASE WHEN listing_id % 2 = 0 THEN {B.FIRST}
    ELSE {B.SECOND} END AS renter_user_id) FROM unlinked
),
reservations AS (
  SELECT b.* REPLACE (a.searcher AS renter_user_id) FROM account_reservations b
  JOIN accounts a ON a.account = b.renter_user_id
),
amplitude_user_ids AS (""", 1)
LINKED = "_linked"


def _identity_oracles() -> dict[str, str]:
    return {
        "j01_resolved_renters": "SELECT reservation_id, renter_user_id, listing_id FROM reservations",
        "j01_resolved_or_unmatched": """SELECT reservation_id, listing_id,
          (SELECT min(searcher) FROM accounts a WHERE a.account = b.renter_user_id)
            AS renter_user_id FROM account_reservations b""",
        "j01_unmatched_renters": """SELECT renter_user_id AS account, count(*) AS reservations
          FROM account_reservations WHERE renter_user_id NOT IN (SELECT account FROM accounts)
          GROUP BY 1""",
        "q01_funnel_counts_linked": _stage_counts(_DIRECT),
    }


_LINES = f"""
WITH ev AS (
  SELECT e.*, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events e
  WHERE event_type = 'view'
), good AS (SELECT *, k % 23 <> 5 AS whole FROM ev), cells AS (
  SELECT event_id, user_id, whole, k, ts,
    {list(B.FLAG_SPELLINGS)}[1 + k % 8] AS is_bot,
    CASE WHEN k % 3 = 0 THEN 'True' ELSE 'False' END AS is_host,
    [NULL, CAST(k AS VARCHAR), k || '.0', k || '.5', 'many', CAST(3 * k AS VARCHAR)][1 + k % 6]
      AS count_results,
    ['sea, view', 'the "old" town', NULL, 'plain'][1 + k % 4] AS search_term,
    CASE WHEN k % 9 = 0 THEN '{B.NO_TIME}' WHEN k % 2 = 0
      THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END
      AS event_time,
    CASE WHEN k % 10 = 7 THEN 'someday' ELSE strftime(ts, '%Y-%m-%d') END AS event_date
  FROM good
)"""


def _ingest_oracles() -> dict[str, str]:
    text = [("event_uuid", "CAST(event_id AS VARCHAR)"),
            ("merged_amplitude_id", "CAST(user_id AS VARCHAR)"), ("is_bot", "nullif(is_bot, '')"),
            ("is_host", "is_host"), ("count_results", "count_results"),
            ("search_term", "search_term"), ("event_time", "event_time"),
            ("event_date", "event_date"), ("month", "CAST(day(ts) AS VARCHAR)")]
    # A line with a cell too many still has its first cells.
    line = """concat_ws(',', event_id, user_id, is_bot, is_host, coalesce(count_results, ''),
      ['"sea, view"', '"the ""old"" town"', '', 'plain'][1 + k % 4], event_time, event_date,
      day(ts)) || ',one too many'"""
    bad = " UNION ALL ".join(
        f"SELECT CAST(event_id AS VARCHAR) AS row, '{column}' AS column, {cell} AS cell, "
        f"'{reason}' AS reason FROM cells WHERE {where}"
        for column, cell, reason, where in (
            ("is_bot", "is_bot", "not a flag", "whole AND is_bot = '2'"),
            ("count_results", "count_results", "not a whole number", "whole AND k % 6 IN (3, 4)"),
            ("event_time", "event_time", "not a time", "whole AND k % 9 = 0"),
            ("event_date", "event_date", "not a date", "whole AND k % 10 = 7"),
            ("_corrupt_record", line, "wrong number of cells", "NOT whole")))
    return {
        "s01_typed_csv": _LINES + """SELECT CAST(event_id AS VARCHAR) AS event_uuid,
          CAST(user_id AS VARCHAR) AS merged_amplitude_id,
          [true, false, false, true, true, false, NULL, NULL][1 + k % 8] AS is_bot,
          k % 3 = 0 AS is_host,
          CAST([NULL, k, k, NULL, NULL, 3 * k][1 + k % 6] AS INTEGER) AS count_results,
          search_term, CASE WHEN k % 9 <> 0 THEN date_trunc('second', ts) END AS event_time,
          CASE WHEN k % 10 <> 7 THEN CAST(ts AS DATE) END AS event_date,
          CAST(day(ts) AS INTEGER) AS month FROM cells""",
        "s01_rejects": _LINES + bad,
        "s02_text_csv": _LINES + "SELECT " + ", ".join(f"{e} AS {n}" for n, e in text)
        + f", CASE WHEN NOT whole THEN {line} END AS broken_line FROM cells",
        "p01_normalised_reservations": _TABLES + """SELECT
          CAST(reservation_id AS VARCHAR) AS reservation_id,
          CAST(renter_user_id AS VARCHAR) AS renter_user_id, CAST(created_at AS TIMESTAMP)
            AS created_at, CAST(approved_at AS TIMESTAMP) AS approved_at,
          CAST(successful_payment_collected_at AS TIMESTAMP) AS successful_payment_collected_at
          FROM order_reservations""",
    }


_CHART_SOURCES = {
    "funnel": "q01_funnel_counts", "search_type_volume": "q17_search_type_volume",
    "top_dmas": "q18_top_dmas", "top_attribution": "q19_top_attribution",
    "monthly_volume": "q20_monthly_volume", "category_volume": "q21_category_volume",
    "weekday": "q33_weekday_conversion", "monthly": "q34_monthly_conversion",
    "hosts": "q35_host_conversion", "sort": "q36_sort_preference",
    "category": "q37_term_category", "geography": "q38_geography", "peak_hours": "q39_peak_hours",
    "position": "q40_position_conversion", "position_buckets": "q41_bucket_conversion",
    "position_buckets_estimated": "q42_estimated_buckets", "clicks": "q44_click_distribution",
    "sort_activity": "q43_sort_conversion",
}


def _chart_tables(known: dict[str, str]) -> str:
    """Every chart from the statement of its own query, in the long format."""
    parts = []
    for chart, (keys, metrics) in Q.CHARTS.items():
        segment = " || ' / ' || ".join(
            f"coalesce(CAST({k} AS VARCHAR), '(none)')" for k in keys) or "'(all)'"
        parts.append("SELECT * REPLACE (round(value, 6) AS value) FROM (" + _long(
            chart, known[_CHART_SOURCES[chart]], segment, metrics) + ")")
    return " UNION ALL ".join(parts)


_RATES = {
    "search_sort": ("q36_sort_preference", "search_sort"),
    "search_term_category": ("q37_term_category", "search_term_category"),
    "geography": ("q38_geography", "characteristic"),
    "user_type": ("q35_host_conversion", "user_type"),
    "time": ("q39_peak_hours", "characteristic"),
    "month": ("q34_monthly_conversion", "CAST(month AS VARCHAR)"),
    "day_of_week": ("q33_weekday_conversion", "day_of_week"),
    "search_position": ("q40_position_funnel", "characteristic"),
    "clicked_position": ("q40_position_conversion", "'Position ' || search_position"),
    "position_bucket": ("q41_bucket_conversion", "position_bucket"),
    "search_type": ("q10_search_type_performance", "search_type"),
}


def _all_extremes(known: dict[str, str]) -> str:
    rates = " UNION ALL ".join(
        f"SELECT '{analysis}' AS analysis, {label} AS characteristic, conversion_rate AS rate "
        f"FROM ({known[query]})" for analysis, (query, label) in _RATES.items())
    return f"""WITH rates AS ({rates}), b AS (
  SELECT analysis, max(rate) AS best_rate, min(rate) AS worst_rate, avg(rate) AS avg_rate
  FROM rates GROUP BY 1
) SELECT analysis, array_to_string(list_transform(string_split(analysis, '_'),
    lambda w: upper(w[1]) || w[2:]), ' ') AS title,
  (SELECT min(characteristic) FROM rates x WHERE x.analysis = b.analysis AND rate = best_rate)
    AS best, round(best_rate, 6) AS best_rate,
  (SELECT min(characteristic) FROM rates x WHERE x.analysis = b.analysis AND rate = worst_rate)
    AS worst, round(worst_rate, 6) AS worst_rate,
  round(best_rate - worst_rate, 6) AS gap_pp, round(avg_rate, 6) AS avg_rate FROM b"""


def all_oracles() -> dict[str, str]:
    """The statements with the logical tables in front."""
    bodies = _oracles()
    known = {name: _TABLES + body for name, body in bodies.items()}
    linked = {name + LINKED: body for name, body in bodies.items()} | _identity_oracles()
    return known | {
        name: _ACCOUNTS + linked[name] for name in Q.all_queries() if name in linked
    } | _ingest_oracles() | {
        "s12_chart_tables": _chart_tables(known), "q55_all_extremes": _all_extremes(known)}
