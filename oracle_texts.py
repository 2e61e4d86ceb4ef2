"""DuckDB SQL that gives the rows of each registered query, over the same test tables."""

from __future__ import annotations

# The behaviour tables, mapped from the test tables.
_VIEWS = {
    "e0": """
        SELECT event_id, ts, user_id, event_type,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS mon,
               extract(day FROM ts) AS dom,
               extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60
                 + CAST(floor(extract(second FROM ts)) AS BIGINT) AS sod
        FROM events""",
    "e1": """
        SELECT *, (user_id % 23) * 3600 + sod // CASE user_id % 4
                 WHEN 0 THEN 24 WHEN 1 THEN 240 WHEN 2 THEN 2400 ELSE 20000 END AS off
        FROM e0""",
    "user_visit_action": """
        SELECT day AS date,
               CASE WHEN user_id % 11 = 10 THEN user_id + 1000000000 ELSE user_id END AS user_id,
               user_id || '-' || CASE user_id % 7
                 WHEN 0 THEN 'm' || mon
                 WHEN 1 THEN 'h' || mon || '.' || (dom // 16)
                 WHEN 2 THEN 'w' || mon || '.' || (dom // 7)
                 ELSE 'd' || day END AS session_id,
               CAST(k % 10 AS BIGINT) AS page_id,
               day || ' ' || lpad(CAST(off // 3600 AS VARCHAR), 2, '0')
                   || ':' || lpad(CAST(off % 3600 // 60 AS VARCHAR), 2, '0')
                   || ':' || lpad(CAST(off % 60 AS VARCHAR), 2, '0') AS action_time,
               CASE WHEN event_type = 'view' THEN 'kw' || (k % 10) END AS search_keyword,
               CASE WHEN event_type = 'click' THEN CAST(k AS BIGINT) END AS click_category_id,
               CASE WHEN event_type = 'click' THEN (event_id * 13 + k) % 200 END
                 AS click_product_id,
               CASE WHEN event_type = 'signup' THEN k || ',' || ((k * 7 + 3) % 100) END
                 AS order_category_ids,
               CASE WHEN event_type = 'signup'
                 THEN (event_id % 200) || ',' || ((event_id + 1) % 200) END AS order_product_ids,
               CASE WHEN event_type = 'purchase' THEN CAST(k AS VARCHAR) END AS pay_category_ids,
               CASE WHEN event_type = 'purchase' THEN CAST(event_id % 200 AS VARCHAR) END
                 AS pay_product_ids,
               event_id % 25 AS city_id
        FROM e1""",
    "user_info": """
        SELECT c_custkey AS user_id, 'user' || c_custkey AS username, c_name AS name,
               CAST((c_custkey * 7) % 60 AS INTEGER) AS age, c_mktsegment AS professional,
               'NATION_' || c_nationkey AS city,
               CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex
        FROM customer""",
    "city_info": """
        SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS city_name, r_name AS area
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "clicks": """
        SELECT epoch_us(ts) // 1000 AS click_ms, ts AS click_time,
               strftime(ts, '%Y-%m-%d') AS date, replace(area, ' ', '_') AS province,
               city_name AS city, user_id, CAST(k % 10 AS BIGINT) AS ad_id
        FROM e0 JOIN city_info ON event_id % 25 = city_id WHERE ts IS NOT NULL""",
    "sessions": """
        SELECT session_id, min(user_id) AS user_id,
               coalesce(string_agg(DISTINCT search_keyword, ',' ORDER BY search_keyword)
                 FILTER (search_keyword <> ''), '') AS search_keywords,
               coalesce(array_to_string(list_sort(list(DISTINCT click_category_id)
                 FILTER (click_category_id IS NOT NULL)), ','), '') AS click_category_ids,
               min(CAST(action_time AS TIMESTAMP)) AS start_time,
               count(*) AS step_length,
               date_diff('second', min(CAST(action_time AS TIMESTAMP)),
                                   max(CAST(action_time AS TIMESTAMP))) AS visit_length
        FROM user_visit_action WHERE session_id IS NOT NULL GROUP BY session_id""",
    "with_users": """
        SELECT s.*, age, professional, city, sex
        FROM sessions s JOIN user_info u ON s.user_id = u.user_id""",
    "user_counts": """
        SELECT date, user_id, ad_id, count(*) AS click_count
        FROM clicks GROUP BY date, user_id, ad_id""",
    "blacklist": """
        SELECT DISTINCT user_id FROM user_counts
        WHERE click_count >= 3 AND user_id IS NOT NULL""",
    "allowed": """
        SELECT * FROM clicks c
        WHERE NOT EXISTS (SELECT 1 FROM blacklist b WHERE b.user_id = c.user_id)""",
    "stat": """
        SELECT date, province, city, ad_id, count(*) AS click_count
        FROM allowed GROUP BY date, province, city, ad_id""",
    "before": """
        SELECT date, province, city, ad_id, count(*) AS click_count
        FROM clicks WHERE click_time < TIMESTAMP '2024-01-16 12:00:00'
        GROUP BY date, province, city, ad_id""",
    "batch": """
        SELECT date, province, city, ad_id, count(*) AS click_count
        FROM clicks WHERE click_time >= TIMESTAMP '2024-01-16 00:00:00'
        GROUP BY date, province, city, ad_id""",
}


def _with(names: str, body: str, **more: str) -> str:
    """``body`` after a WITH clause of the named views and of further ones."""
    views = {name: _VIEWS[name] for name in names.split()} | more
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in views.items())
    return f"WITH {ctes}\n{body}"


_ACTIONS = "e0 e1 user_visit_action"
_SESSIONS = f"{_ACTIONS} user_info sessions with_users"
_CLICKS = "e0 city_info clicks"
_SESSION_COLUMNS = """session_id, user_id, search_keywords, click_category_ids,
    strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, step_length, visit_length"""
_DETAIL_COLUMNS = """CAST(1 AS BIGINT) AS taskid, user_id AS userid, session_id AS sessionid,
    page_id AS pageid, action_time AS "actionTime", search_keyword AS "searchKeyword",
    click_category_id AS "clickCategoryId", click_product_id AS "clickProductId",
    order_category_ids AS "orderCategoryIds", order_product_ids AS "orderProductIds",
    pay_category_ids AS "payCategoryIds", pay_product_ids AS "payProductIds" """

_TASK_ACTIONS = """
    SELECT * FROM user_visit_action WHERE date >= '2024-01-02' AND date <= '2024-01-29'"""
_TASK_SESSIONS = _VIEWS["sessions"].replace("FROM user_visit_action", "FROM task_actions")
_TASK_FILTERED = """
    SELECT s.*, age, professional, city, sex
    FROM task_sessions s JOIN user_info u ON s.user_id = u.user_id
    WHERE age BETWEEN 5 AND 54
      AND professional IN ('HOUSEHOLD', 'MACHINERY', 'BUILDING', 'FURNITURE')
      AND sex IN ('male')
      AND list_has_any(['NATION_' || i FOR i IN range(20)], [city])
      AND list_has_any(string_split(search_keywords, ','), ['kw1', 'kw3', 'kw5', 'kw7', 'kw9'])
      AND list_has_any(string_split(click_category_ids, ','),
                       [CAST(i AS VARCHAR) FOR i IN range(10, 60)])"""
_FILTERED = {
    "task_actions": _TASK_ACTIONS,
    "task_sessions": _TASK_SESSIONS,
    "filtered": _TASK_FILTERED,
}

_BUCKETS = (
    ("visit_length_1s_3s", "visit_length BETWEEN 1 AND 3"),
    ("visit_length_4s_6s", "visit_length BETWEEN 4 AND 6"),
    ("visit_length_7s_9s", "visit_length BETWEEN 7 AND 9"),
    ("visit_length_10s_30s", "visit_length >= 10 AND visit_length < 30"),
    ("visit_length_30s_60s", "visit_length >= 30 AND visit_length < 60"),
    ("visit_length_1m_3m", "visit_length >= 60 AND visit_length < 180"),
    ("visit_length_3m_10m", "visit_length >= 180 AND visit_length < 600"),
    ("visit_length_10m_30m", "visit_length >= 600 AND visit_length < 1800"),
    ("visit_length_30m", "visit_length >= 1800"),
    ("step_length_1_3", "step_length BETWEEN 1 AND 3"),
    ("step_length_4_6", "step_length BETWEEN 4 AND 6"),
    ("step_length_7_9", "step_length BETWEEN 7 AND 9"),
    ("step_length_10_30", "step_length >= 10 AND step_length < 30"),
    ("step_length_30_60", "step_length >= 30 AND step_length < 60"),
    ("step_length_60", "step_length >= 60"),
)


def _ratio(part: str, whole: str) -> str:
    return f"((200 * {part} + nullif({whole}, 0)) // (2 * nullif({whole}, 0))) / 100.0"


def _stat(table: str, task_id: int) -> str:
    ratios = ",\n".join(
        f"{_ratio(f'count(*) FILTER ({test})', 'count(*)')} AS {name}_ratio"
        for name, test in _BUCKETS
    )
    return (
        f"SELECT CAST({task_id} AS BIGINT) AS taskid, count(*) AS session_count,\n"
        f"{ratios}\nFROM {table}"
    )


_TIMED = """
    SELECT *, strftime(start_time, '%Y-%m-%d') AS day, extract(hour FROM start_time) AS hr
    FROM with_users"""
_HOURS = """
    SELECT day, hr, count(*) AS n,
           CAST(sum(count(*)) OVER (PARTITION BY day) AS BIGINT) AS total
    FROM timed GROUP BY day, hr"""
_SHARES = """
    SELECT day, hr, least(5, total) AS wanted, least(5, total) * n // total AS base,
           least(5, total) * n % total AS remainder FROM hours"""
_QUOTAS = """
    SELECT day, hr, base + CASE WHEN
             row_number() OVER (PARTITION BY day ORDER BY remainder DESC, hr)
               <= wanted - sum(base) OVER (PARTITION BY day) THEN 1 ELSE 0 END AS quota
    FROM shares"""
_DRAWN = """
    SELECT t.* FROM (
      SELECT *, row_number() OVER (PARTITION BY day, hr
                  ORDER BY md5('1' || session_id), session_id) AS draw_rank FROM timed) t
    JOIN quotas q ON t.day = q.day AND t.hr = q.hr
    WHERE draw_rank <= quota"""
_SAMPLE = {
    "timed": _TIMED,
    "hours": _HOURS,
    "shares": _SHARES,
    "quotas": _QUOTAS,
    "drawn": _DRAWN,
}

_CATEGORY = {
    "detail": """
        SELECT * FROM user_visit_action
        WHERE session_id IN (SELECT session_id FROM with_users)""",
    "touched": """
        SELECT session_id, click_category_id AS c, 1 AS click, 0 AS ord, 0 AS pay
        FROM detail WHERE click_category_id IS NOT NULL
        UNION ALL
        SELECT session_id, CAST(unnest(string_split(order_category_ids, ',')) AS BIGINT), 0, 1, 0
        FROM detail WHERE order_category_ids IS NOT NULL
        UNION ALL
        SELECT session_id, CAST(unnest(string_split(pay_category_ids, ',')) AS BIGINT), 0, 0, 1
        FROM detail WHERE pay_category_ids IS NOT NULL""",
    "top": """
        SELECT CAST(1 AS BIGINT) AS taskid, c AS categoryid,
               CAST(sum(click) AS BIGINT) AS "clickCount",
               CAST(sum(ord) AS BIGINT) AS "orderCount", CAST(sum(pay) AS BIGINT) AS "payCount"
        FROM touched GROUP BY c
        ORDER BY sum(click) DESC, sum(ord) DESC, sum(pay) DESC, c LIMIT 10""",
}

_FLOW = {
    "visits": """
        SELECT page_id, lead(page_id) OVER (PARTITION BY session_id
                 ORDER BY CAST(action_time AS TIMESTAMP) NULLS FIRST, page_id NULLS FIRST)
                 AS next_page
        FROM user_visit_action WHERE session_id IS NOT NULL""",
    "flow": """
        SELECT CAST(s AS INTEGER) AS step, CAST(f AS BIGINT) AS from_page,
               CAST(t AS BIGINT) AS to_page
        FROM (VALUES (1, 1, 2), (2, 2, 3), (3, 3, 3), (4, 3, 4)) v(s, f, t)""",
    "moved": """
        SELECT step, from_page, to_page,
               (SELECT count(*) FROM visits v
                WHERE v.page_id = from_page AND v.next_page = to_page) AS moves
        FROM flow""",
    "based": """
        SELECT *, coalesce(lag(moves) OVER (ORDER BY step),
                           (SELECT count(*) FROM visits WHERE page_id = 1)) AS base
        FROM moved""",
    "rates": f"SELECT *, coalesce({_ratio('moves', 'base')}, 0.0) AS rate FROM based",
}

_TOP3 = """
    SELECT date, province, ad_id, CAST(click_count AS BIGINT) AS click_count FROM (
      SELECT *, row_number() OVER (PARTITION BY date, province
                                   ORDER BY click_count DESC, ad_id) AS rn FROM (
        SELECT date, province, ad_id, sum(click_count) AS click_count
        FROM {source} GROUP BY date, province, ad_id))
    WHERE rn <= 3"""
_TREND = """
    SELECT strftime(click_time, '%Y-%m-%d') AS date, strftime(click_time, '%H') AS hour,
           strftime(click_time, '%M') AS minute, ad_id, count(*) AS click_count
    FROM clicks GROUP BY 1, 2, 3, 4"""
_REPLACED_TOP3 = """
    SELECT * FROM new_top3
    UNION ALL
    SELECT * FROM old_top3 o WHERE NOT EXISTS (
      SELECT 1 FROM new_top3 n WHERE n.date = o.date AND n.province = o.province)"""
_OLD_NEW_TOP3 = {
    "old_top3": _TOP3.format(source="before"),
    "new_top3": _TOP3.format(source="batch"),
}
_BOTH_KEYS = """b.date = s.date AND b.province = s.province AND b.city = s.city
    AND b.ad_id IS NOT DISTINCT FROM s.ad_id"""
_USER_COUNTS = "SELECT date, user_id, ad_id, click_count FROM user_counts"

# An arrival (third of a month) is one batch. Counts of allowed clicks grow batch by
# batch; a user is on the list from the batch after the one that reached the threshold.
# A (date, ad) count grows only in the batch of its date, so that batch is known at once.
_PASSED = """
    SELECT c.* FROM clicks c
    LEFT JOIN (
      SELECT user_id, min(substr(date, 1, 7) || '.' ||
               least((CAST(substr(date, 9, 2) AS INTEGER) - 1) // 10, 2)) AS listed_in
      FROM user_counts WHERE click_count >= 3 GROUP BY user_id) l ON c.user_id = l.user_id
    WHERE listed_in IS NULL OR substr(date, 1, 7) || '.' ||
      least((CAST(substr(date, 9, 2) AS INTEGER) - 1) // 10, 2) <= listed_in"""


_STREAMED = _with(
    "e0 city_info clicks user_counts",
    "{body}",
    passed=_PASSED,
    passed_stat="""SELECT date, province, city, ad_id, count(*) AS click_count
        FROM passed GROUP BY date, province, city, ad_id""",
)

# Lines that cannot be clicks.
_BROKEN_LINES = """
    SELECT CASE event_id % 40 WHEN 0 THEN '' WHEN 1 THEN '   '
             WHEN 2 THEN 'soon ' || replace(area, ' ', '_') || ' ' || city_name
             WHEN 3 THEN '9223372036854775807 ' || city_name
             ELSE '-9223372036854775807 ' || city_name END AS value,
           CASE event_id % 40 WHEN 0 THEN 'empty line' WHEN 1 THEN 'empty line'
             WHEN 2 THEN 'time is no number' ELSE 'time out of range' END AS reason
    FROM e0 JOIN city_info ON event_id % 25 = city_id
    WHERE ts IS NOT NULL AND event_id % 40 <= 4"""
_REJECTED_COUNTS = "SELECT value, reason, count(*) AS line_count FROM broken_lines GROUP BY value, reason"


def _streamed(body: str) -> str:
    return _STREAMED.replace("{body}", body)


# A click counts unless its user was listed on its date or before.
_RERUN = {
    "final_clicks": """SELECT * FROM clicks
        WHERE click_time < TIMESTAMP '2024-01-16' OR click_time >= TIMESTAMP '2024-01-16 12:00:00'""",
    "listed": """SELECT user_id, min(date) AS listed_on FROM (
          SELECT date, user_id, ad_id FROM final_clicks WHERE user_id IS NOT NULL
          GROUP BY date, user_id, ad_id HAVING count(*) >= 3)
        GROUP BY user_id""",
}
_RERUN_STAT = """
    SELECT date, province, city, ad_id, count(*) AS click_count
    FROM final_clicks c LEFT JOIN listed l ON c.user_id = l.user_id
    WHERE listed_on IS NULL OR date < listed_on
    GROUP BY date, province, city, ad_id"""


def _when(test: str, value: str) -> str:
    return f"CASE WHEN {test} THEN {value} END"


_TASKS = f"""
    SELECT c_custkey AS task_id,
           {_when("c_custkey % 2 = 0", "'2024-01-05'")} AS start_date,
           {_when("c_custkey % 4 = 0", "'2024-01-25'")} AS end_date,
           {_when("c_custkey % 3 = 0", "CAST(c_custkey % 40 AS INTEGER)")} AS start_age,
           {_when("c_custkey % 3 <> 1", "CAST(c_custkey % 40 + 20 AS INTEGER)")} AS end_age,
           {_when("c_custkey % 5 < 3", "c_mktsegment || ',OTHER'")} AS professionals,
           {_when("c_custkey % 7 = 0", "'NATION_' || c_nationkey")} AS cities,
           {_when("c_custkey % 6 = 0", "'male'")} AS sex,
           {_when("c_custkey % 8 = 0", "'kw' || (c_custkey % 10)")} AS keywords,
           {_when("c_custkey % 9 = 0", "(c_custkey % 100) || ',7'")} AS category_ids,
           (c_custkey % 10) || ',2,3' AS page_flow
    FROM customer"""


def oracle_sql() -> dict[str, str]:
    stat_sql = _with(
        f"{_CLICKS} user_counts blacklist allowed stat",
        "SELECT date, province, city, ad_id, click_count FROM stat",
    )
    top3_sql = _with(
        f"{_CLICKS} user_counts blacklist allowed stat", _TOP3.format(source="stat")
    )
    counts_sql = _with(f"{_CLICKS} user_counts", _USER_COUNTS)
    replaced_sql = _with(f"{_CLICKS} before batch", _REPLACED_TOP3, **_OLD_NEW_TOP3)
    return {
        "action_scan_date_range": _with(
            _ACTIONS,
            "SELECT * FROM user_visit_action WHERE date BETWEEN '2024-01-05' AND '2024-01-20'",
        ),
        "action_scan_day_before": _with(
            _ACTIONS, "SELECT * FROM user_visit_action WHERE date = '2024-01-10'"
        ),
        "action_count_by_minute": _with(
            _ACTIONS,
            """SELECT strftime(CAST(action_time AS TIMESTAMP), '%Y%m%d') AS date_key,
                      strftime(CAST(action_time AS TIMESTAMP), '%Y%m%d%H%M') AS minute_key,
                      count(*) AS action_count,
                      strftime(CAST(action_time AS TIMESTAMP), '%Y-%m-%d') AS date
               FROM user_visit_action GROUP BY 1, 2, 4""",
        ),
        "product_status_scan": """
            SELECT p_partkey AS product_id, p_name AS product_name,
                   CAST(p_partkey % 2 AS VARCHAR) AS product_status FROM part""",
        "task_params": _TASKS,
        "session_aggregate": _with(
            f"{_ACTIONS} sessions", f"SELECT {_SESSION_COLUMNS} FROM sessions"
        ),
        "session_user_enriched": _with(
            _SESSIONS,
            f"SELECT {_SESSION_COLUMNS}, age, professional, city, sex FROM with_users",
        ),
        "session_filtered": _with(
            f"{_ACTIONS} user_info",
            f"SELECT {_SESSION_COLUMNS}, age, professional, city, sex FROM filtered",
            **_FILTERED,
        ),
        "session_equal_filter": _with(
            _SESSIONS,
            f"SELECT {_SESSION_COLUMNS}, age, professional, city, sex FROM with_users "
            "WHERE professional = 'MACHINERY' AND sex = 'female'",
        ),
        "session_detail": _with(
            _SESSIONS,
            f"SELECT {_DETAIL_COLUMNS} FROM user_visit_action "
            "WHERE session_id IN (SELECT session_id FROM with_users)",
        ),
        "session_detail_count": _with(
            _SESSIONS,
            "SELECT count(*) AS detail_count FROM user_visit_action "
            "WHERE session_id IN (SELECT session_id FROM with_users)",
        ),
        "session_aggr_stat": _with(_SESSIONS, _stat("with_users", 1)),
        "session_aggr_stat_filtered": _with(
            f"{_ACTIONS} user_info", _stat("filtered", 2), **_FILTERED
        ),
        "session_count_by_hour": _with(
            _SESSIONS,
            "SELECT strftime(start_time, '%Y-%m-%d_%H') AS date_hour, "
            "count(*) AS session_count FROM with_users GROUP BY 1",
        ),
        "session_random_extract": _with(
            _SESSIONS,
            "SELECT CAST(1 AS BIGINT) AS taskid, session_id AS sessionid, "
            "strftime(start_time, '%Y-%m-%d %H:%M:%S') AS \"startTime\", "
            'search_keywords AS "searchKeywords", click_category_ids AS "clickCategoryIds" '
            "FROM drawn",
            **_SAMPLE,
        ),
        "session_random_extract_detail": _with(
            _SESSIONS,
            f"SELECT {_DETAIL_COLUMNS} FROM user_visit_action "
            "WHERE session_id IN (SELECT session_id FROM drawn)",
            **_SAMPLE,
        ),
        "top10_category": _with(_SESSIONS, "SELECT * FROM top", **_CATEGORY),
        "top10_category_session": _with(
            _SESSIONS,
            """SELECT CAST(1 AS BIGINT) AS taskid, c AS categoryid, session_id AS sessionid,
                      CAST(clicks AS BIGINT) AS "clickCount"
               FROM (SELECT *, row_number() OVER (PARTITION BY c
                                 ORDER BY clicks DESC, session_id) AS rn
                     FROM (SELECT c, session_id, sum(click) AS clicks FROM touched
                           WHERE c IN (SELECT categoryid FROM top)
                           GROUP BY c, session_id HAVING sum(click) > 0))
               WHERE rn <= 10""",
            **_CATEGORY,
        ),
        "page_split_convert_rate": _with(_ACTIONS, "SELECT * FROM rates", **_FLOW),
        "page_split_convert_rate_string": _with(
            _ACTIONS,
            """SELECT CAST(1 AS BIGINT) AS taskid,
                      string_agg(from_page || '_' || to_page || '=' ||
                                 CAST(CAST(rate AS DOUBLE) AS VARCHAR), '|' ORDER BY step)
                        AS "convertRate"
               FROM rates""",
            **_FLOW,
        ),
        "area_top3_product": _with(
            f"{_ACTIONS} city_info",
            """SELECT CAST(1 AS BIGINT) AS taskid, area,
                      CASE area WHEN 'ASIA' THEN 'A' WHEN 'EUROPE' THEN 'A'
                                WHEN 'AMERICA' THEN 'B' ELSE 'C' END AS "areaLevel",
                      product_id AS productid, city_infos AS "cityInfos",
                      clicks AS "clickCount", p_name AS "productName",
                      CAST(product_id % 2 AS VARCHAR) AS "productStatus"
               FROM (SELECT *, row_number() OVER (PARTITION BY area
                                 ORDER BY clicks DESC, product_id) AS rn
                     FROM (SELECT area, click_product_id AS product_id, p_name,
                                  count(*) AS clicks,
                                  string_agg(DISTINCT lpad(CAST(c.city_id AS VARCHAR), 3, ' ')
                                    || ':' || city_name, ',' ORDER BY
                                    lpad(CAST(c.city_id AS VARCHAR), 3, ' ')
                                    || ':' || city_name) AS padded,
                                  replace(padded, ' ', '') AS city_infos
                           FROM user_visit_action a
                           JOIN city_info c ON a.city_id = c.city_id
                           JOIN part ON click_product_id = p_partkey
                           GROUP BY area, click_product_id, p_name))
               WHERE rn <= 3""",
        ),
        "ad_log_parse": _with(
            _CLICKS, "SELECT click_ms, province, city, user_id, ad_id FROM clicks"
        ),
        "ad_user_click_count": counts_sql,
        "ad_click_count_lookup": _with(
            f"{_CLICKS} user_counts",
            """SELECT k.date, k.user_id, k.ad_id, coalesce(click_count, 0) AS click_count
               FROM keys k LEFT JOIN user_counts u
                 ON k.date = u.date AND k.user_id = u.user_id AND k.ad_id = u.ad_id""",
            keys="""SELECT DISTINCT strftime(click_time + INTERVAL 1 DAY, '%Y-%m-%d') AS date,
                           user_id, ad_id FROM clicks""",
        ),
        "ad_blacklist": _with(
            f"{_CLICKS} user_counts blacklist", "SELECT user_id FROM blacklist"
        ),
        "ad_clicks_allowed": _with(
            f"{_CLICKS} user_counts blacklist allowed",
            "SELECT click_ms, province, city, user_id, ad_id FROM allowed",
        ),
        "ad_stat": stat_sql,
        "ad_province_top3": top3_sql,
        "ad_click_trend": _with(_CLICKS, _TREND),
        "upsert_split_existing": _with(
            f"{_CLICKS} before batch",
            f"SELECT * FROM batch b WHERE EXISTS (SELECT 1 FROM before s WHERE {_BOTH_KEYS})",
        ),
        "upsert_split_new": _with(
            f"{_CLICKS} before batch",
            f"SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM before s WHERE {_BOTH_KEYS})",
        ),
        "upsert_replace": _with(
            f"{_CLICKS} before batch",
            f"""SELECT coalesce(b.date, s.date) AS date,
                       coalesce(b.province, s.province) AS province,
                       coalesce(b.city, s.city) AS city, coalesce(b.ad_id, s.ad_id) AS ad_id,
                       coalesce(b.click_count, s.click_count) AS click_count
                FROM before s FULL OUTER JOIN batch b ON {_BOTH_KEYS}""",
        ),
        "upsert_accumulate": counts_sql,
        "replace_groups": replaced_sql,
        "sink_append": counts_sql,
        "sink_replace_groups": _with(
            f"{_CLICKS} before batch",
            """SELECT * FROM new_top3
               UNION ALL
               SELECT * FROM old_top3 WHERE date NOT IN (SELECT date FROM batch)""",
            **_OLD_NEW_TOP3,
        ),
        "ad_statistics_rerun": _with(_CLICKS, _RERUN_STAT, **_RERUN),
        "ad_statistics_corrected": _with(
            _CLICKS, _RERUN_STAT, **(_RERUN | {"final_clicks": "SELECT * FROM clicks"})
        ),
        "ad_lines_rejected": _with("e0 city_info", _REJECTED_COUNTS, broken_lines=_BROKEN_LINES),
        "stream_ad_lines_rejected": _with("e0 city_info", _REJECTED_COUNTS, broken_lines=_BROKEN_LINES),
        "stream_ad_line_outcomes": _with(
            f"{_CLICKS} user_counts",
            """SELECT 'allowed click' AS outcome, count(*) AS line_count FROM passed HAVING count(*) > 0
               UNION ALL
               SELECT 'click of a listed user', (SELECT count(*) FROM clicks) - (SELECT count(*) FROM passed)
               WHERE (SELECT count(*) FROM clicks) > (SELECT count(*) FROM passed)
               UNION ALL
               SELECT reason, count(*) FROM broken_lines GROUP BY reason""",
            clicks=_VIEWS["clicks"] + " AND event_id % 40 > 4",
            passed=_PASSED,
            broken_lines=_BROKEN_LINES,
        ),
        "stream_ad_stat": _streamed("SELECT * FROM passed_stat"),
        "stream_ad_user_click_count": _streamed(
            "SELECT date, user_id, ad_id, count(*) AS click_count FROM passed GROUP BY ALL"
        ),
        "stream_ad_clicks_allowed": _streamed(
            "SELECT click_ms, province, city, user_id, ad_id FROM passed"
        ),
        "stream_ad_blacklist": _streamed(
            "SELECT DISTINCT user_id FROM user_counts WHERE click_count >= 3 AND user_id IS NOT NULL"
        ),
        "stream_ad_province_top3": _streamed(_TOP3.format(source="passed_stat")),
        "stream_ad_click_trend": _with(_CLICKS, _TREND),
    }
