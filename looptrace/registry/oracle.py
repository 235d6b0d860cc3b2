"""The same questions as SQL for DuckDB, written on their own, over the same given files."""

from __future__ import annotations

from looptrace.registry.queries import KNN_K, KNN_KM, LOAN_DAYS, READ_DAYS, SALT
from looptrace.schemas import TABLES
from looptrace.sources.fixtures import (
    JSON_PATH, LOANS_AS_OF, POINT, PROJECTIONS, RAW_CHECKOUTS, RAW_LEDGER, RAW_READINGS,
    TELEMETRY_AS_OF, cte,
)

NOW = f"TIMESTAMP '{TELEMETRY_AS_OF}'"
THEN = f"TIMESTAMP '{LOANS_AS_OF}'"
LAT, LNG = POINT

HOURS = "date_diff('hour', checkout_time, return_time)"
DUE = "checkout_time + to_days(due_back_days)"

# One step of every item's state after the other.
LOOP_TABLES = "packaging_instances checkouts returns inspections wash_cycles"
LOOPS = """
        , log AS (
          SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY ts, step, id) AS n FROM (
            SELECT instance_id, birthed_at AS ts, 0 AS step, 'birth' AS event,
                   instance_id AS id, NULL::BOOLEAN AS passed FROM packaging_instances
            UNION ALL SELECT instance_id, checkout_time, 1, 'checkout', checkout_id, NULL
              FROM checkouts
            UNION ALL SELECT instance_id, return_time, 2, 'return', return_id, NULL FROM returns
            UNION ALL SELECT DISTINCT instance_id, start_time, 3, 'wash', wash_id, NULL
              FROM inspections JOIN wash_cycles USING (wash_id)
            UNION ALL SELECT instance_id, inspected_at, 4, 'inspection', inspection_id,
                             coalesce(result = 'pass', false) FROM inspections)),
        seen AS (
          FROM (
            WITH RECURSIVE walk AS (
              SELECT DISTINCT instance_id, 0::BIGINT AS n, NULL::TIMESTAMP AS ts, '' AS event,
                     NULL::BOOLEAN AS passed, '' AS state, 'unborn' AS after, 0::BIGINT AS loops
              FROM log
              UNION ALL
              SELECT l.instance_id, l.n, l.ts, l.event, l.passed, w.after,
                     CASE l.event WHEN 'checkout' THEN 'out' WHEN 'return' THEN 'back' ELSE
                       CASE w.after || ' ' || l.event
                         WHEN 'unborn birth' THEN 'ready'
                         WHEN 'unborn wash' THEN 'washed' WHEN 'ready wash' THEN 'washed'
                         WHEN 'back wash' THEN 'washed'
                         WHEN 'unborn inspection' THEN if(l.passed, 'ready', 'back')
                         WHEN 'ready inspection' THEN if(l.passed, 'ready', 'back')
                         WHEN 'back inspection' THEN if(l.passed, 'ready', 'back')
                         WHEN 'washed inspection' THEN if(l.passed, 'ready', 'back')
                         ELSE w.after END END,
                     w.loops + (l.event = 'checkout')::BIGINT
              FROM walk w JOIN log l ON l.instance_id = w.instance_id AND l.n = w.n + 1)
            SELECT *, (state || ' ' || event) IN ('unborn birth', 'ready checkout', 'out return',
                                                  'back wash', 'washed inspection') AS in_turn,
                   event || ' while ' || state AS named
            FROM walk WHERE n > 0)),
        parts AS (
          SELECT instance_id, loops AS loop_no, n, ts, true AS met,
                 in_turn AND (event = 'birth' OR coalesce(passed, false)) AS reached,
                 CASE WHEN NOT in_turn AND event <> 'checkout' THEN named END AS rule FROM seen
          UNION ALL
          SELECT instance_id, loops - 1, n, ts, false, false, named FROM seen
          WHERE NOT in_turn AND event = 'checkout'),
        loops AS (
          SELECT instance_id, loop_no, min(ts) FILTER (met) AS started_at,
                 count() FILTER (met) AS events, bool_or(reached) AND count(rule) = 0 AS complete,
                 count(rule) AS breaks, arg_min(ts, n) FILTER (rule IS NOT NULL) AS break_at,
                 arg_min(rule, n) FILTER (rule IS NOT NULL) AS rule
          FROM parts GROUP BY ALL)
"""

# key -> (tables, text)
REPORTS: dict[str, tuple[str, str]] = {
    # places
    "loc_counts_by_kind": (
        "locations",
        "SELECT kind, count() AS total FROM locations GROUP BY ALL",
    ),
    "loc_retailer_directory": (
        "retailers locations",
        "SELECT retailer_id, name AS retailer_name, address, lat, lng"
        " FROM retailers JOIN locations USING (location_id)",
    ),
    "loc_hub_directory": (
        "hubs locations",
        "SELECT hub_id, name AS hub_name, washer_model, address"
        " FROM hubs JOIN locations USING (location_id)",
    ),
    "loc_nearby_bbox": (
        "locations",
        "SELECT location_id, name, kind, lat, lng FROM locations"
        f" WHERE abs(lat - {LAT}::DECIMAL(9,6)) <= 0.05"
        f" AND abs(lng - {LNG}::DECIMAL(9,6)) <= 0.06",
    ),
    "loc_nearest_places": (
        "locations retailers",
        f"""
        SELECT location_id, name, address, round(km, 3) AS distance_km FROM (
          SELECT l.*, 6371.0 * acos(greatest(-1.0, least(1.0,
              sin(radians({LAT}::DOUBLE)) * sin(radians(lat::DOUBLE))
              + cos(radians({LAT}::DOUBLE)) * cos(radians(lat::DOUBLE))
                * cos(radians(lng::DOUBLE - {LNG}::DOUBLE))))) AS km
          FROM locations l SEMI JOIN retailers USING (location_id)
          WHERE lat + lng IS NOT NULL)
        ORDER BY km, location_id LIMIT 10""",
    ),
    # customers
    "cus_recent": (
        "customers",
        "SELECT customer_id, name, email, created_at FROM customers"
        f" WHERE created_at >= {NOW} - to_days(30)",
    ),
    "cus_without_checkouts": (
        "customers checkouts",
        "SELECT customer_id, name, email FROM customers ANTI JOIN checkouts USING (customer_id)",
    ),
    "cus_deposit_balances": (
        "customers deposit_accounts",
        "SELECT customer_id, name, balance_cents"
        " FROM customers LEFT JOIN deposit_accounts USING (customer_id)",
    ),
    "cus_running_balance": (
        "deposit_accounts customers deposit_transactions",
        """
        SELECT customer_id, name, t.created_at, delta_cents,
               sum(delta_cents) OVER ledger ::BIGINT AS running_balance_cents
        FROM deposit_transactions t JOIN deposit_accounts USING (account_id)
        JOIN customers USING (customer_id)
        WINDOW ledger AS (PARTITION BY account_id ORDER BY t.created_at, tx_id
                          ROWS UNBOUNDED PRECEDING)""",
    ),
    "cus_top_debits": (
        "customers deposit_accounts deposit_transactions",
        """
        SELECT customer_id, name, sum(greatest(-delta_cents, 0))::BIGINT AS total_penalties
        FROM deposit_transactions JOIN deposit_accounts USING (account_id)
        JOIN customers USING (customer_id)
        GROUP BY ALL ORDER BY total_penalties DESC, customer_id LIMIT 10""",
    ),
    # packaging
    "pkg_catalog_summary": (
        "packaging_catalog",
        "SELECT kind, material, count() AS items,"
        " round(avg(capacity_ml), 6) AS avg_capacity_ml FROM packaging_catalog GROUP BY ALL",
    ),
    "pkg_instances_by_state": (
        "packaging_instances",
        "SELECT state, count() AS instances FROM packaging_instances GROUP BY ALL",
    ),
    "pkg_instances_per_catalog": (
        "packaging_catalog packaging_instances",
        "SELECT sku, kind, count(instance_id) AS instances FROM packaging_catalog"
        " LEFT JOIN packaging_instances USING (catalog_id) GROUP BY ALL",
    ),
    "pkg_last_location": (
        "movements",
        "SELECT instance_id, arg_max(to_loc_id, (moved_at, mv_id)) AS to_loc_id,"
        " max(moved_at) AS moved_at FROM movements GROUP BY ALL",
    ),
    "pkg_last_location_names": (
        "packaging_instances movements locations",
        """
        SELECT instance_id, uid_code, name AS last_location
        FROM packaging_instances
        LEFT JOIN (SELECT instance_id, arg_max(to_loc_id, (moved_at, mv_id)) AS location_id
                   FROM movements GROUP BY ALL) USING (instance_id)
        LEFT JOIN locations USING (location_id)""",
    ),
    "pkg_overdue": (
        "checkouts packaging_instances returns",
        f"""
        SELECT checkout_id, uid_code, {DUE} AS due_date,
               date_diff('day', {DUE}, {THEN}) AS days_overdue
        FROM checkouts JOIN packaging_instances USING (instance_id)
        WHERE {DUE} < {THEN}
          AND checkout_id NOT IN (SELECT checkout_id FROM returns WHERE checkout_id IS NOT NULL)""",
    ),
    # cycles
    "cyc_duration_stats": (
        "checkouts returns",
        f"""
        SELECT (sum(h) // count(h))::BIGINT AS avg_hours, min(h) AS min_hours, max(h) AS max_hours
        FROM (SELECT {HOURS} AS h FROM returns r JOIN checkouts c USING (checkout_id))""",
    ),
    "cyc_duration_percentiles": (
        "checkouts returns packaging_instances packaging_catalog",
        f"""
        SELECT kind, round(quantile_cont(h, 0.5), 6) AS p50_h,
               round(quantile_cont(h, 0.9), 6) AS p90_h
        FROM (SELECT c.instance_id, {HOURS} AS h FROM returns r JOIN checkouts c USING (checkout_id))
        JOIN packaging_instances USING (instance_id) JOIN packaging_catalog USING (catalog_id)
        GROUP BY ALL""",
    ),
    "cyc_return_rate": (
        "checkouts retailers locations returns",
        """
        SELECT l.name AS retailer, round(count(return_id) / count(c.checkout_id), 6) AS return_rate
        FROM checkouts c JOIN retailers USING (retailer_id)
        JOIN locations l ON l.location_id = retailers.location_id
        LEFT JOIN returns r ON r.checkout_id = c.checkout_id GROUP BY ALL""",
    ),
    "cyc_return_status": (
        "checkouts returns",
        f"""
        SELECT CASE WHEN return_id IS NULL THEN 'open'
                    WHEN return_time > {DUE} THEN 'late' ELSE 'on_time' END AS return_status,
               count() AS totals
        FROM checkouts LEFT JOIN returns USING (checkout_id) GROUP BY ALL""",
    ),
    # washing
    "wsh_cycle_stats": (
        "wash_cycles",
        """
        SELECT count() AS cycles, (sum(m) // count(m))::BIGINT AS avg_minutes,
               round(avg(temp_c::DOUBLE), 6) AS avg_temp_c
        FROM (SELECT *, date_diff('minute', start_time, end_time) AS m FROM wash_cycles)""",
    ),
    "wsh_pass_rate_by_hub": (
        "inspections wash_cycles hubs locations",
        """
        SELECT name AS hub_name, round(avg((result = 'pass')::INT), 6) AS pass_rate
        FROM inspections LEFT JOIN wash_cycles USING (wash_id) LEFT JOIN hubs USING (hub_id)
        LEFT JOIN locations USING (location_id) GROUP BY ALL""",
    ),
    "wsh_latest_failures": (
        "inspections",
        """
        SELECT instance_id, last.result AS result, last.inspected_at AS inspected_at,
               last.notes AS notes
        FROM (SELECT instance_id, arg_max(i, (inspected_at, inspection_id)) AS last
              FROM inspections i GROUP BY instance_id)
        WHERE last.result = 'fail'""",
    ),
    # incidents
    "inc_recent_by_kind_severity": (
        "contamination_incidents",
        "SELECT kind, severity, count() AS incidents_30d FROM contamination_incidents"
        f" WHERE detected_at >= {NOW} - to_days(30) GROUP BY ALL",
    ),
    "inc_repeat_instances": (
        "contamination_incidents",
        "SELECT instance_id, count() AS total_incidents FROM contamination_incidents"
        " GROUP BY ALL HAVING total_incidents > 1",
    ),
    # sensors
    "sen_latest_reading": (
        "sensor_readings",
        "SELECT instance_id, sensor_type, value, measured_at FROM sensor_readings"
        " QUALIFY row_number() OVER (PARTITION BY instance_id, sensor_type"
        " ORDER BY measured_at DESC, reading_id DESC) = 1",
    ),
    "sen_temp_breaches": (
        "sensor_readings",
        f"""
        SELECT instance_id, max(value) AS max_temp_24h FROM sensor_readings
        WHERE sensor_type = 'temperature' AND measured_at >= {NOW} - to_hours(24)
        GROUP BY ALL HAVING max_temp_24h > 35""",
    ),
    "sen_daily_pivot": (
        "sensor_readings",
        "SELECT measured_at::DATE AS date, "
        + ", ".join(
            f"round(avg(value::DOUBLE) FILTER (sensor_type = '{kind}'), 6) AS {kind}"
            for kind in ("temperature", "humidity", "shock")
        )
        + f" FROM sensor_readings WHERE measured_at >= {NOW} - to_days(3) GROUP BY ALL",
    ),
    # movements
    "mov_scan": ("movements", "FROM movements"),
    "mov_flow_matrix": (
        "movements locations",
        """
        SELECT a.kind AS from_kind, b.kind AS to_kind, count() AS moves
        FROM movements LEFT JOIN locations a ON a.location_id = from_loc_id
        LEFT JOIN locations b ON b.location_id = to_loc_id GROUP BY ALL""",
    ),
    "mov_dwell": (
        "movements locations",
        """
        SELECT instance_id, name AS last_location,
               date_diff('hour', times[2], times[1]) AS dwell_hours
        FROM (SELECT instance_id, arg_max(to_loc_id, (moved_at, mv_id)) AS location_id,
                     list(moved_at ORDER BY moved_at DESC, mv_id DESC) AS times
              FROM movements GROUP BY ALL)
        LEFT JOIN locations USING (location_id)""",
    ),
    # audit
    "aud_event_counts": (
        "audit_logs",
        "SELECT event_type, count() AS cnt FROM audit_logs GROUP BY ALL",
    ),
    "aud_latest": (
        "audit_logs",
        "SELECT log_id, entity_id, event_type, created_at FROM audit_logs"
        " WHERE entity_type = 'instance' ORDER BY created_at DESC, log_id DESC LIMIT 20",
    ),
    "aud_notes_json": (
        "audit_logs",
        f"""
        SELECT log_id, created_at,
               CASE WHEN json_valid(detail) AND json_type(detail) IN ('OBJECT', 'ARRAY')
                     AND json_type(detail, '{JSON_PATH}') NOT IN ('OBJECT', 'ARRAY')
                    THEN json_extract_string(detail, '{JSON_PATH}') END AS note
        FROM audit_logs ORDER BY created_at DESC, log_id DESC LIMIT 20""",
    ),
    # key figures and views
    "kpi_daily": (
        "checkouts returns",
        "SELECT checkout_time::DATE AS date, count() AS total_checkouts,"
        " count(return_id) AS total_returns"
        " FROM checkouts LEFT JOIN returns USING (checkout_id) GROUP BY ALL",
    ),
    "kpi_state_rollup": (
        "packaging_instances",
        "SELECT state, count() AS cnt FROM packaging_instances GROUP BY state"
        " UNION ALL SELECT NULL, count() FROM packaging_instances",
    ),
    "kpi_retailer_dashboard": (
        "checkouts retailers locations returns",
        """
        SELECT l.name AS retailer, count(DISTINCT c.checkout_id) AS checkouts,
               count(DISTINCT return_id) AS returns,
               count() FILTER (return_id IS NULL) AS open_loans
        FROM checkouts c JOIN retailers USING (retailer_id)
        JOIN locations l ON l.location_id = retailers.location_id
        LEFT JOIN returns r ON r.checkout_id = c.checkout_id GROUP BY ALL""",
    ),
    "vw_checkout_enriched": (
        "checkouts customers packaging_instances packaging_catalog retailers locations",
        """
        SELECT checkout_id, checkout_time, due_back_days, customer_id,
               customers.name AS customer_name, instance_id, uid_code, state,
               packaging_catalog.kind AS kind, material, capacity_ml,
               location_id AS retailer_location_id, locations.name AS retailer_name
        FROM checkouts JOIN customers USING (customer_id)
        JOIN packaging_instances USING (instance_id) JOIN packaging_catalog USING (catalog_id)
        JOIN retailers USING (retailer_id) JOIN locations USING (location_id)""",
    ),
    "vw_customer_balances": (
        "customers deposit_accounts deposit_transactions",
        """
        SELECT customer_id, name, balance_cents,
               coalesce(sum(delta_cents), 0)::BIGINT AS ledger_sum_cents
        FROM customers LEFT JOIN deposit_accounts USING (customer_id)
        LEFT JOIN deposit_transactions USING (account_id) GROUP BY ALL""",
    ),
    # tracing
    "instance_timeline": (
        "packaging_instances checkouts retailers returns inspections wash_cycles hubs"
        " contamination_incidents movements",
        """
        SELECT instance_id, ts, event, ref_id, location_id,
               date_diff('hour', lag(ts) OVER item, ts) AS hours_since_prev
        FROM (
          SELECT instance_id, birthed_at AS ts, 0 AS step, 'birth' AS event,
                 instance_id AS ref_id, NULL::BIGINT AS location_id FROM packaging_instances
          UNION ALL SELECT instance_id, checkout_time, 1, 'checkout', checkout_id, location_id
            FROM checkouts LEFT JOIN retailers USING (retailer_id)
          UNION ALL SELECT instance_id, return_time, 2, 'return', return_id, location_id
            FROM returns
          UNION ALL SELECT DISTINCT instance_id, start_time, 3, 'wash', wash_id, location_id
            FROM inspections JOIN wash_cycles USING (wash_id) LEFT JOIN hubs USING (hub_id)
          UNION ALL SELECT instance_id, inspected_at, 4, 'inspection', inspection_id, NULL
            FROM inspections
          UNION ALL SELECT instance_id, detected_at, 5, 'incident', incident_id, NULL
            FROM contamination_incidents
          UNION ALL SELECT instance_id, moved_at, 6, 'movement', mv_id, to_loc_id FROM movements)
        WINDOW item AS (PARTITION BY instance_id ORDER BY ts, step, ref_id)""",
    ),
    "turnaround_by_retailer": (
        "checkouts returns packaging_instances packaging_catalog retailers locations",
        f"""
        SELECT l.name AS retailer, pc.kind AS kind, round(quantile_cont(h, 0.5), 6) AS p50_h,
               round(quantile_cont(h, 0.9), 6) AS p90_h, count() AS n
        FROM (SELECT c.instance_id, retailer_id, {HOURS} AS h
              FROM returns r JOIN checkouts c USING (checkout_id))
        JOIN packaging_instances USING (instance_id)
        JOIN packaging_catalog pc USING (catalog_id)
        JOIN retailers USING (retailer_id) JOIN locations l USING (location_id)
        GROUP BY ALL""",
    ),
    "ontime_by_retailer": (
        "checkouts returns retailers locations",
        f"""
        SELECT *, round(on_time / nullif(on_time + late, 0), 6) AS on_time_rate FROM (
          SELECT l.name AS retailer, count() FILTER (return_time <= {DUE}) AS on_time,
                 count() FILTER (return_time > {DUE}) AS late,
                 count() FILTER (return_id IS NULL) AS open
          FROM checkouts c LEFT JOIN returns r ON r.checkout_id = c.checkout_id
          JOIN retailers USING (retailer_id)
          JOIN locations l ON l.location_id = retailers.location_id
          GROUP BY ALL)""",
    ),
    "dwell_current": (
        "movements locations",
        f"""
        SELECT instance_id, name AS last_location,
               date_diff('hour', moved_at, {NOW}) AS dwell_hours
        FROM (SELECT instance_id, arg_max(to_loc_id, (moved_at, mv_id)) AS location_id,
                     max(moved_at) AS moved_at FROM movements GROUP BY ALL)
        LEFT JOIN locations USING (location_id)""",
    ),
    "loss_hotspots": (
        "packaging_instances movements checkouts returns contamination_incidents locations",
        f"""
        , last_place AS (
          SELECT instance_id, arg_max(to_loc_id, (moved_at, mv_id)) AS location_id
          FROM movements GROUP BY ALL),
        late AS (
          SELECT DISTINCT instance_id FROM checkouts
          WHERE {DUE} < {THEN}
            AND checkout_id NOT IN (SELECT checkout_id FROM returns
                                    WHERE checkout_id IS NOT NULL)),
        items AS (
          SELECT instance_id, (state IN ('lost', 'damaged'))::INT AS lost,
                 (instance_id IN (FROM late))::INT AS overdue,
                 (SELECT count() FROM contamination_incidents c
                  WHERE c.instance_id = i.instance_id) AS incidents
          FROM packaging_instances i),
        places AS (
          SELECT name AS location, sum(lost)::BIGINT AS lost, sum(overdue)::BIGINT AS overdue,
                 sum(incidents)::BIGINT AS incidents
          FROM items LEFT JOIN last_place USING (instance_id)
          LEFT JOIN locations USING (location_id)
          WHERE lost + overdue + incidents > 0 GROUP BY ALL)
        SELECT *, round((lost + overdue) / sum(lost + overdue) OVER (), 6) AS share,
               rank() OVER (ORDER BY lost + overdue DESC) AS rank
        FROM places""",
    ),
    "match_returns": (
        "checkouts returns",
        """
        , log AS (
          SELECT instance_id, checkout_time AS ts, 0 AS step, checkout_id AS id,
                 NULL::BIGINT AS link FROM checkouts
          UNION ALL SELECT instance_id, return_time, 1, return_id, checkout_id FROM returns),
        seen AS (
          SELECT *, lag(step) OVER item AS prev_step, lag(id) OVER item AS prev_id FROM log
          WINDOW item AS (PARTITION BY instance_id ORDER BY ts, step, id))
        SELECT id AS return_id, instance_id,
               CASE WHEN link IS NOT NULL THEN link
                    WHEN prev_step = 0 AND prev_id NOT IN
                      (SELECT checkout_id FROM returns WHERE checkout_id IS NOT NULL)
                    THEN prev_id END AS matched_checkout_id
        FROM seen WHERE step = 1""",
    ),
    "match_returns_nested": (
        "checkouts returns",
        """
        , log AS (
          SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY ts, step, id) AS n FROM (
            SELECT instance_id, checkout_time AS ts, 0 AS step, checkout_id AS id FROM checkouts
            WHERE checkout_id NOT IN
              (SELECT checkout_id FROM returns WHERE checkout_id IS NOT NULL)
            UNION ALL SELECT instance_id, return_time, 1, return_id FROM returns
            WHERE checkout_id IS NULL))
        SELECT r.return_id, r.instance_id, coalesce(checkout_id, got) AS matched_checkout_id
        FROM returns r LEFT JOIN (
          WITH RECURSIVE walk AS (
            SELECT DISTINCT instance_id, 0::BIGINT AS n, []::BIGINT[] AS held,
                   NULL::BIGINT AS return_id, NULL::BIGINT AS got FROM log
            UNION ALL
            SELECT l.instance_id, l.n,
                   CASE WHEN step = 0 THEN list_append(held, id) ELSE held[: len(held) - 1] END,
                   CASE WHEN step = 1 THEN id END, CASE WHEN step = 1 THEN held[-1] END
            FROM walk w JOIN log l ON l.instance_id = w.instance_id AND l.n = w.n + 1)
          SELECT return_id, got FROM walk WHERE return_id IS NOT NULL) m USING (return_id)""",
    ),
    "loop_conformance": (LOOP_TABLES, LOOPS + "SELECT * FROM loops"),
    "loop_breaks": (
        LOOP_TABLES,
        LOOPS
        + """SELECT rule, count() AS loops, count() FILTER (complete) AS complete,
                    min(break_at) AS first_at, max(break_at) AS last_at FROM loops GROUP BY rule""",
    ),
    "sen_percentiles_range": (
        "sensor_readings",
        f"""
        SELECT sensor_type, count(value) AS readings,
               quantile_disc(value::DOUBLE, 0.5) AS p50, quantile_disc(value::DOUBLE, 0.9) AS p90
        FROM sensor_readings
        WHERE measured_at::DATE BETWEEN '{READ_DAYS[0]}' AND '{READ_DAYS[1]}' GROUP BY ALL""",
    ),
    "kpi_dashboard_range": (
        "checkouts returns retailers locations",
        f"""
        SELECT l.name AS retailer, count(DISTINCT checkout_id) AS checkouts,
               count(DISTINCT checkout_id) FILTER (back) AS returned,
               count(DISTINCT checkout_id) FILTER (NOT back) AS open_loans
        FROM (SELECT checkout_id, retailer_id, checkout_id IN
                (SELECT r.checkout_id FROM returns r WHERE r.checkout_id IS NOT NULL
                 AND r.return_time::DATE <= '{LOAN_DAYS[1]}') AS back
              FROM checkouts
              WHERE checkout_time::DATE BETWEEN '{LOAN_DAYS[0]}' AND '{LOAN_DAYS[1]}')
        JOIN retailers USING (retailer_id) JOIN locations l USING (location_id)
        GROUP BY ALL""",
    ),
    "sink_batches": (
        "movements", "SELECT *, moved_at::DATE AS event_date FROM movements",
    ),
    "exposed_items": (
        "movements contamination_incidents",
        f"""
        , seen AS (
          SELECT instance_id, to_loc_id AS place, moved_at AS came,
                 coalesce(lead(moved_at) OVER (PARTITION BY instance_id ORDER BY moved_at, mv_id),
                          {NOW}) AS gone
          FROM movements WHERE moved_at <= {NOW} AND instance_id IS NOT NULL),
        stays AS (SELECT * FROM seen WHERE place IS NOT NULL),
        own AS (SELECT instance_id, min(detected_at) AS t FROM contamination_incidents
                WHERE severity >= 4 AND detected_at <= {NOW} GROUP BY ALL),
        hits AS (
          FROM (
            WITH RECURSIVE hit(instance_id, t) USING KEY (instance_id) AS (
              SELECT instance_id, t FROM own
              UNION
              SELECT n.instance_id, n.t FROM (
                SELECT j.instance_id, min(greatest(h.t, i.came, j.came)) AS t
                FROM hit h JOIN stays i ON i.instance_id = h.instance_id AND i.gone >= h.t
                JOIN stays j ON j.place = i.place
                 AND greatest(h.t, i.came, j.came) <= least(i.gone, j.gone)
                GROUP BY ALL) n
              LEFT JOIN recurring.hit r ON r.instance_id = n.instance_id
              WHERE r.t IS NULL OR n.t < r.t)
            SELECT * FROM hit))
        SELECT instance_id, hits.t AS exposed_at, coalesce(own.t <= hits.t, false) AS incident
        FROM hits LEFT JOIN own USING (instance_id)""",
    ),
    "alerts": (
        "checkouts returns sensor_readings inspections contamination_incidents",
        f"""
        , judged AS (
          SELECT instance_id, max(inspected_at) FILTER (result = 'pass') AS passed_at,
                 arg_max(result, (inspected_at, inspection_id)) AS result,
                 max(inspected_at) AS inspected_at
          FROM inspections GROUP BY ALL),
        grave AS (
          SELECT instance_id, max(detected_at) AS detected_at FROM contamination_incidents
          WHERE severity >= 4 GROUP BY ALL)
        SELECT 'overdue' AS alert, instance_id, 2 AS severity, {DUE} AS at,
               'checkout ' || checkout_id AS detail
        FROM checkouts
        WHERE {DUE} < {NOW}
          AND checkout_id NOT IN (SELECT checkout_id FROM returns WHERE checkout_id IS NOT NULL)
        UNION ALL
        SELECT 'breach', instance_id, 4, max(measured_at), 'peak ' || max(value)
        FROM sensor_readings
        WHERE sensor_type = 'temperature' AND measured_at >= {NOW} - to_hours(24) AND value > 35
        GROUP BY instance_id
        UNION ALL
        SELECT 'rewash', instance_id, 3, greatest(failed_at, risen_at),
               concat_ws(' and ', CASE WHEN failed_at IS NOT NULL THEN 'failed inspection' END,
                                  CASE WHEN risen_at IS NOT NULL THEN 'incident' END)
        FROM (SELECT instance_id, CASE WHEN result = 'fail' THEN inspected_at END AS failed_at,
                     CASE WHEN passed_at IS NULL OR detected_at > passed_at THEN detected_at END
                       AS risen_at
              FROM judged FULL JOIN grave USING (instance_id))
        WHERE failed_at IS NOT NULL OR risen_at IS NOT NULL""",
    ),
    "knn_places": (
        "locations retailers",
        f"""
        SELECT point_id, location_id, round(km, 6) AS distance_km,
               row_number() OVER point ::INTEGER AS rank
        FROM (
          SELECT p.location_id AS point_id, q.location_id,
                 2 * 6371.0 * asin(least(1.0, sqrt(
                   pow(sin(radians(q.lat::DOUBLE - p.lat::DOUBLE) / 2), 2)
                   + cos(radians(p.lat::DOUBLE)) * cos(radians(q.lat::DOUBLE))
                     * pow(sin(radians(q.lng::DOUBLE - p.lng::DOUBLE) / 2), 2)))) AS km
          FROM locations p, locations q
          WHERE p.kind <> 'retailer' AND p.lat + p.lng IS NOT NULL AND q.lat + q.lng IS NOT NULL
            AND q.location_id IN (SELECT location_id FROM retailers))
        WHERE km <= {KNN_KM}
        WINDOW point AS (PARTITION BY point_id ORDER BY round(km, 6), location_id)
        QUALIFY rank <= {KNN_K}""",
    ),
    "anonymized_export": (
        "checkouts",
        f"""
        SELECT sha256('{SALT}|checkouts|' || checkout_id) AS checkout_id,
               sha256('{SALT}|packaging_instances|' || instance_id) AS instance_id,
               sha256('{SALT}|retailers|' || retailer_id) AS retailer_id,
               sha256('{SALT}|customers|' || customer_id) AS customer_id,
               date_trunc('quarter', c.checkout_time)::TIMESTAMP AS checkout_time, due_back_days
        FROM checkouts c
        QUALIFY count() OVER (PARTITION BY c.retailer_id,
                              date_trunc('quarter', c.checkout_time)) >= 5""",
    ),
    "anonymized_export_customers": (
        "customers",
        f"""
        SELECT sha256('{SALT}|customers|' || customer_id) AS customer_id,
               date_trunc('day', c.created_at)::TIMESTAMP AS created_at
        FROM customers c
        QUALIFY count() OVER (PARTITION BY date_trunc('day', c.created_at)) >= 5""",
    ),
    "anonymized_export_returns": (
        "returns",
        f"""
        SELECT sha256('{SALT}|returns|' || return_id) AS return_id,
               sha256('{SALT}|packaging_instances|' || instance_id) AS instance_id,
               sha256('{SALT}|customers|' || customer_id) AS customer_id,
               sha256('{SALT}|locations|' || location_id) AS location_id,
               date_trunc('year', r.return_time)::TIMESTAMP AS return_time,
               sha256('{SALT}|checkouts|' || checkout_id) AS checkout_id
        FROM returns r
        QUALIFY count() OVER (PARTITION BY r.location_id,
                              date_trunc('year', r.return_time)) >= 3""",
    ),
    # deletes
    "ref_delete": (
        "customers deposit_accounts deposit_transactions checkouts returns",
        """
        , gone AS (SELECT customer_id FROM customers ANTI JOIN checkouts USING (customer_id)),
        shut AS (SELECT account_id FROM deposit_accounts SEMI JOIN gone USING (customer_id))
        SELECT 'delete' AS action, 'customers' AS "table", NULL::VARCHAR AS "column",
               customer_id AS key FROM gone
        UNION ALL SELECT 'delete', 'deposit_accounts', NULL, account_id FROM shut
        UNION ALL SELECT 'delete', 'deposit_transactions', NULL, tx_id
          FROM deposit_transactions SEMI JOIN shut USING (account_id)
        UNION ALL SELECT 'null', 'returns', 'customer_id', return_id
          FROM returns SEMI JOIN gone USING (customer_id)
        UNION ALL SELECT 'block', 'checkouts', 'customer_id', checkout_id
          FROM checkouts SEMI JOIN gone USING (customer_id)""",
    ),
    "ref_delete_blocked": (
        "customers deposit_accounts deposit_transactions checkouts returns",
        """
        , gone AS (SELECT customer_id FROM customers WHERE customer_id IN
                   (SELECT customer_id FROM deposit_accounts WHERE balance_cents < 0)),
        shut AS (SELECT account_id FROM deposit_accounts SEMI JOIN gone USING (customer_id))
        SELECT 'delete' AS action, 'customers' AS "table", NULL::VARCHAR AS "column",
               customer_id AS key FROM gone
        UNION ALL SELECT 'delete', 'deposit_accounts', NULL, account_id FROM shut
        UNION ALL SELECT 'delete', 'deposit_transactions', NULL, tx_id
          FROM deposit_transactions SEMI JOIN shut USING (account_id)
        UNION ALL SELECT 'null', 'returns', 'customer_id', return_id
          FROM returns SEMI JOIN gone USING (customer_id)
        UNION ALL SELECT 'block', 'checkouts', 'customer_id', checkout_id
          FROM checkouts SEMI JOIN gone USING (customer_id)""",
    ),
    "ref_delete_inspections": (
        "inspections wash_cycles",
        """
        SELECT inspection_id, instance_id,
               CASE WHEN wash_id NOT IN (SELECT wash_id FROM wash_cycles WHERE end_time IS NULL)
                    THEN wash_id END AS wash_id,
               inspector, result, notes, inspected_at
        FROM inspections""",
    ),
    # loading
    "ing_defaults": (
        "packaging_instances",
        f"SELECT instance_id, catalog_id, uid_code, 'available' AS state, {NOW} AS birthed_at,"
        " retired_at FROM packaging_instances",
    ),
    # streams: the batch answer over what the last watermark has closed
    "st_temp_breaches": (
        "sensor_readings",
        """
        , hot AS (SELECT * FROM sensor_readings WHERE sensor_type = 'temperature' AND value > 35),
        windows AS (
          SELECT date_trunc('hour', measured_at) - to_hours(unnest(range(24))) AS window_start,
                 instance_id, value FROM hot)
        SELECT window_start, window_start + to_hours(24) AS window_end, instance_id,
               max(value) AS max_temp
        FROM windows
        WHERE window_start + to_hours(24) <= (SELECT max(measured_at) - to_hours(1) FROM hot)
        GROUP BY ALL""",
    ),
    "st_latest_reading": (
        "sensor_readings",
        """
        SELECT instance_id, sensor_type,
               arg_max(value, (measured_at, reading_id)) AS value, max(measured_at) AS measured_at
        FROM sensor_readings
        WHERE date_trunc('hour', measured_at) + to_hours(1)
              <= (SELECT max(measured_at) - to_hours(1) FROM sensor_readings)
        GROUP BY ALL""",
    ),
    "st_latest_running": (
        "sensor_readings",
        "SELECT instance_id, sensor_type, arg_max(value, (measured_at, reading_id)) AS value,"
        " max(measured_at) AS measured_at FROM sensor_readings GROUP BY ALL",
    ),
    "st_overdue": (
        "checkouts returns",
        f"""
        , mark AS (
          SELECT least((SELECT max({DUE}) FROM checkouts),
                       (SELECT max(return_time) FROM returns WHERE checkout_id IS NOT NULL))
                 - to_minutes(90) AS closed_at)
        SELECT checkout_id, instance_id, {DUE} AS due_date
        FROM checkouts c, mark
        WHERE {DUE} < closed_at
          AND NOT EXISTS (FROM returns r
                          WHERE r.checkout_id = c.checkout_id AND return_time <= {DUE})""",
    ),
}


# The rules once more, for the checks alone: table -> key, then required columns; unique columns;
# rules on one row; longest texts; references.
REQUIRED = """
locations location_id name kind
retailers retailer_id location_id
hubs hub_id location_id
customers customer_id name created_at
packaging_catalog catalog_id kind material deposit_amount_cents
packaging_instances instance_id catalog_id uid_code state birthed_at
deposit_accounts account_id customer_id balance_cents
deposit_transactions tx_id account_id delta_cents reason created_at
checkouts checkout_id instance_id retailer_id customer_id checkout_time due_back_days
returns return_id instance_id location_id return_time
wash_cycles wash_id hub_id batch_code start_time
inspections inspection_id instance_id result inspected_at
contamination_incidents incident_id instance_id kind severity detected_at
sensor_readings reading_id sensor_type value measured_at
movements mv_id instance_id moved_at
audit_logs log_id entity_type entity_id event_type created_at
"""
UNIQUE = """
locations name
retailers location_id
hubs location_id
customers email
packaging_catalog sku
packaging_instances uid_code
deposit_accounts customer_id
"""
ONE_ROW = """
locations kind_allowed kind IN ('retailer', 'hub', 'dropbox')
packaging_catalog kind_allowed kind IN ('cup', 'box', 'jar')
packaging_catalog deposit_not_negative deposit_amount_cents >= 0
packaging_instances state_allowed state IN ('available', 'in_use', 'at_retailer', 'at_hub', 'washing', 'damaged', 'lost', 'retired')
inspections result_allowed result IN ('pass', 'fail')
contamination_incidents kind_allowed kind IN ('microbial', 'chemical', 'foreign_matter')
contamination_incidents severity_in_range severity >= 1 AND severity <= 5
sensor_readings sensor_type_allowed sensor_type IN ('temperature', 'humidity', 'shock')
"""
LONGEST = """
locations name=120 kind=20 address=255
retailers contact_email=190
hubs washer_model=80
customers name=120 email=190 phone=40
packaging_catalog sku=64 kind=20 material=30
packaging_instances uid_code=64 state=20
deposit_transactions reason=120 ref_table=40
wash_cycles batch_code=40 detergent=40
inspections inspector=80 result=12 notes=255
contamination_incidents kind=30 description=255
sensor_readings sensor_type=20
movements note=120
audit_logs entity_type=30 event_type=40
"""
REFERENCES = """
retailers location_id=locations
hubs location_id=locations
packaging_instances catalog_id=packaging_catalog
deposit_accounts customer_id=customers
deposit_transactions account_id=deposit_accounts
checkouts instance_id=packaging_instances retailer_id=retailers customer_id=customers
returns instance_id=packaging_instances customer_id=customers location_id=locations checkout_id=checkouts
wash_cycles hub_id=hubs
inspections instance_id=packaging_instances wash_id=wash_cycles
contamination_incidents instance_id=packaging_instances
sensor_readings instance_id=packaging_instances location_id=locations
movements instance_id=packaging_instances from_loc_id=locations to_loc_id=locations
"""
ROLES = """
retailers retailer
hubs hub
returns retailer dropbox
"""


def _lines(text: str) -> list[list[str]]:
    return [line.split() for line in text.strip().split("\n")]


def _checks() -> dict[str, str]:
    """Quality checks: one branch per rule, over the tables with faults."""
    keys = {table: key for table, key, *_ in _lines(REQUIRED)}

    def branch(rule: str, table: str, key: str, detail: str, rest: str) -> str:
        return (
            f"SELECT '{rule}' AS rule, '{table}' AS \"table\", ({key})::VARCHAR AS key,"
            f" {detail} AS detail FROM {table} {rest}"
        )

    not_null, primary, unique, check, foreign, role = [], [], [], [], [], []
    newest = []

    def is_new(key: str) -> str:
        return f"coalesce({key} % 7 = 0, true)"

    for t, key, *others in _lines(REQUIRED):
        not_null += [
            branch("not_null", t, key, f"'{c}'", f"WHERE {c} IS NULL") for c in (key, *others)
        ]
        primary.append(branch("primary_key", t, key, "count() || ' rows'",
                              f"WHERE {key} IS NOT NULL GROUP BY {key} HAVING count() > 1"))
        newest.append(f"{primary[-1]} AND {is_new(key)}")
    for t, column in _lines(UNIQUE):
        unique.append(branch("unique", t, column, f"'{column}: ' || count() || ' rows'",
                             f"GROUP BY {column} HAVING count() > 1"))
        newest.append(f"{unique[-1]} AND bool_or({is_new(keys[t])})")
    for line in ONE_ROW.strip().split("\n"):
        t, name, rule = line.split(" ", 2)
        check.append(branch("check", t, keys[t], f"'{name}'", f"WHERE NOT ({rule})"))
    for t, *sizes in _lines(LONGEST):
        for column, size in (s.split("=") for s in sizes):
            check.append(branch("check", t, keys[t], f"'{column}_length'",
                                f"WHERE length({column}) > {size}"))
    for t, *refs in _lines(REFERENCES):
        for column, parent in (r.split("=") for r in refs):
            known = f"SELECT {keys[parent]} FROM {parent} WHERE {keys[parent]} IS NOT NULL"
            foreign.append(branch("foreign_key", t, keys[t], f"'{column} -> {parent}: ' || {column}",
                                  f"WHERE {column} IS NOT NULL AND {column} NOT IN ({known})"))
            newest.append(f"{foreign[-1]} AND {is_new(keys[t])}")
    for t, *kinds in _lines(ROLES):
        listed = ", ".join(f"'{k}'" for k in kinds)
        role.append(branch("role_kind", t, keys[t], "'at a ' || kind",
                           f"JOIN locations USING (location_id) WHERE kind NOT IN ({listed})"))
    temporal = [
        branch("temporal", "returns", "return_id", "'returned before its checkout'",
               "JOIN checkouts USING (checkout_id) WHERE return_time < checkout_time"),
        branch("temporal", "wash_cycles", "wash_id", "'ended before its start'",
               "WHERE end_time < start_time"),
        branch("temporal", "packaging_instances", "instance_id", "'retired before its birth'",
               "WHERE retired_at < birthed_at"),
    ]
    whole = cte(*PROJECTIONS, dirty=True)
    return {
        name: whole + "\nUNION ALL ".join(parts)
        for name, parts in {
            "dq_not_null": not_null, "dq_primary_key": primary, "dq_unique": unique,
            "dq_check": check, "dq_foreign_key": foreign, "dq_role_kind": role,
            "dq_temporal": temporal, "dq_increment": newest,
        }.items()
    }


def _loads() -> dict[str, str]:
    casts = [
        ("reading_id", "BIGINT"), ("instance_id", "BIGINT"), ("location_id", "BIGINT"),
        ("sensor_type", "VARCHAR"), ("value", "DECIMAL(10,3)"), ("measured_at", "TIMESTAMP"),
    ]
    raw = f"WITH raw AS ({RAW_READINGS})\n"
    bad = [f"({c} IS NOT NULL AND TRY_CAST({c} AS {t}) IS NULL)" for c, t in casts]
    typed = ", ".join(f"TRY_CAST({c} AS {t}) AS {c}" for c, t in casts)
    named = ", ".join(f"CASE WHEN {b} THEN '{c}' END" for b, (c, _) in zip(bad, casts))
    return {
        "ing_typed_load": f"{raw}SELECT {typed} FROM raw WHERE NOT ({' OR '.join(bad)})",
        "ing_typed_load_rejects": f"{raw}SELECT *, concat_ws(',', {named}) AS faults FROM raw"
        f" WHERE {' OR '.join(bad)}",
    }


def _files() -> dict[str, str]:
    """Loads of raw files: which lines are rows is known from how the lines are made."""
    day = "CAST(created_at AS DATE) + to_hours(12)"
    loan_day = "CAST(checkout_time AS DATE) + to_hours(12)"
    ledger = ("tx_id", "account_id", "delta_cents", "reason", "ref_table", "ref_id", "created_at")
    loan = ("checkout_id", "instance_id", "retailer_id", "customer_id", "checkout_time",
            "due_back_days")

    def rejects(table: str, key: str, columns: tuple, shown: dict[str, str], lines: str,
                bad: str) -> str:
        text = ", ".join(f"{shown.get(c, c + '::VARCHAR')} AS {c}" for c in columns)
        empty = ", ".join(f"NULL::VARCHAR AS {c}" for c in columns)
        return (
            cte(table) + f", lines AS ({lines})\n"
            f"SELECT {empty}, line AS record, 'record' AS faults FROM lines WHERE {bad}"
            f" UNION ALL SELECT {text}, NULL, '{shown['faults']}' FROM {table}"
            f" WHERE {key} % 50 = 3"
        )

    return {
        "ing_csv_locations": cte("locations")
        + "SELECT location_id, name, kind, NULL::VARCHAR AS address, lat,"
        " NULL::DECIMAL(9,6) AS lng FROM locations",
        "ing_csv_ledger": cte("deposit_transactions")
        + f"SELECT * REPLACE ({day} AS created_at) FROM deposit_transactions"
        " WHERE tx_id % 50 NOT IN (1, 2, 3)",
        "ing_json_checkouts": cte("checkouts")
        + f"SELECT * REPLACE ({loan_day} AS checkout_time) FROM checkouts"
        " WHERE checkout_id % 50 NOT IN (1, 2, 3)",
        "ing_csv_ledger_rejects": rejects(
            "deposit_transactions", "tx_id", ledger,
            {"delta_cents": "'n/a'", "created_at": f"strftime({day}, '%Y-%m-%d %H:%M:%S')",
             "faults": "delta_cents"},
            RAW_LEDGER, "length(line) - length(replace(line, ',', '')) <> 6"),
        "ing_json_checkouts_rejects": rejects(
            "checkouts", "checkout_id", loan,
            {"due_back_days": "'soon'",
             "checkout_time": f"strftime({loan_day}, '%Y-%m-%d %H:%M:%S')",
             "faults": "due_back_days"},
            RAW_CHECKOUTS, "NOT json_valid(line)"),
    }


# Exported columns (id:domain, ~time, coordinate., number/step) and those that single a row out.
EXPORTED = {
    "checkouts": (
        "checkout_id:checkouts instance_id:packaging_instances retailer_id:retailers"
        " customer_id:customers ~checkout_time due_back_days", "retailer_id checkout_time"),
    "customers": ("customer_id:customers ~created_at", "created_at"),
    "returns": (
        "return_id:returns instance_id:packaging_instances customer_id:customers"
        " location_id:locations ~return_time checkout_id:checkouts", "location_id return_time"),
    "locations": ("location_id:locations kind lat. lng.", "kind lat lng"),
    "retailers": ("retailer_id:retailers location_id:locations", ""),
    "hubs": ("hub_id:hubs location_id:locations washer_model", "washer_model"),
    "packaging_catalog": (
        "catalog_id:packaging_catalog kind material capacity_ml/100 deposit_amount_cents",
        "kind material"),
    "packaging_instances": (
        "instance_id:packaging_instances catalog_id:packaging_catalog state ~birthed_at"
        " ~retired_at", "state birthed_at retired_at"),
    "deposit_accounts": (
        "account_id:deposit_accounts customer_id:customers balance_cents/10000",
        "balance_cents"),
    "deposit_transactions": (
        "tx_id:deposit_transactions account_id:deposit_accounts delta_cents/1000 reason"
        " ref_table ref_id:ref_id ~created_at", "reason delta_cents created_at"),
    "wash_cycles": (
        "wash_id:wash_cycles hub_id:hubs ~start_time ~end_time temp_c/5 detergent",
        "hub_id start_time end_time"),
    "inspections": (
        "inspection_id:inspections instance_id:packaging_instances wash_id:wash_cycles result"
        " ~inspected_at", "result inspected_at"),
    "contamination_incidents": (
        "incident_id:contamination_incidents instance_id:packaging_instances kind severity"
        " ~detected_at", "kind severity detected_at"),
    "sensor_readings": (
        "reading_id:sensor_readings instance_id:packaging_instances location_id:locations"
        " sensor_type value/5 ~measured_at", "sensor_type value measured_at"),
    "movements": (
        "mv_id:movements instance_id:packaging_instances from_loc_id:locations"
        " to_loc_id:locations ~moved_at", "to_loc_id moved_at"),
    "audit_logs": (
        "log_id:audit_logs entity_type entity_id:entity_id event_type ~created_at",
        "entity_type event_type created_at"),
}


def _coarse(column: str) -> tuple[str, str]:
    if column[0] == "~":
        return column[1:], f"date_trunc('month', {column[1:]})::TIMESTAMP"
    if column[-1] == ".":
        return column[:-1], f"round({column[:-1]}::DOUBLE, 2)"
    if "/" in column:
        name, step = column.split("/")
        return name, f"(floor({name}::DOUBLE / {step}) * {step})::BIGINT"
    return column.split(":")[0], column.split(":")[0]


def _pseudonym(column: str) -> str:
    if ":" not in column:
        return _coarse(column)[0]
    name, domain = column.split(":")
    return f"sha256('{SALT}|{domain}|' || {name}) AS {name}"


def _exports() -> dict[str, str]:
    """Exports by month, without groups below five; three have texts of their own above."""
    out = {}
    for name, (columns, group) in EXPORTED.items():
        if f"anonymized_export_{name}" in REPORTS or name == "checkouts":
            continue
        cut = ", ".join(f"{text} AS {c}" for c, text in map(_coarse, columns.split()))
        shown = ", ".join(map(_pseudonym, columns.split()))
        shared = (
            f" QUALIFY count() OVER (PARTITION BY {', '.join(f'cut.{g}' for g in group.split())})"
            " >= 5" if group else ""
        )
        out[f"anonymized_export_{name}"] = (
            cte(name) + f", cut AS (SELECT {cut} FROM {name})\nSELECT {shown} FROM cut{shared}"
        )
    return out


def _order(column: str, kind: str) -> str:
    """A column's order as a double; texts by their first six bytes."""
    if kind == "string":
        return f"('0x' || rpad(substr(hex({column}), 1, 12), 12, '0'))::BIGINT::DOUBLE"
    return f"epoch_us({column}) / 1e6" if kind == "timestamp" else f"{column}::DOUBLE"


def _generalized() -> dict[str, str]:
    """Exports by month in groups of five or more: median cuts one after the other."""
    out, k = {}, 5
    for name, (columns, group) in EXPORTED.items():
        kinds = {c.name: c.type.typeName() for c in TABLES[name].columns}
        single, listed = group.split(), columns.split()
        if not single:
            shown = ", ".join(f"{text} AS {c}" for c, text in map(_coarse, listed))
            last = ", ".join(map(_pseudonym, listed))
            out[f"generalized_export_{name}"] = (
                cte(name) + f", cut AS (SELECT {shown} FROM {name})\nSELECT {last} FROM cut")
            continue
        every = range(len(single))

        def each(text: str) -> str:
            return ", ".join(text.format(i=i, c=single[i]) for i in every)

        options = ", ".join(
            f"CASE WHEN {n}{i} BETWEEN {k} AND n - {k}"
            f" THEN {{'o': -s{i}, 'j': {i}, 'w': {w}, 'up': x{i} {sign} m{i}}} END"
            for i in every for n, w, sign in (("above", "false", ">"), ("from", "true", ">="))
        )
        coded = ", ".join(f"{_order(c, kinds[c])} AS x{i}" for i, c in enumerate(single))
        shown, named = [], []
        for c in listed:
            column = _coarse(c)[0]
            if column not in single:
                shown.append(f"{_coarse(c)[1]} AS {column}")
                named.append(_pseudonym(c))
            elif ":" in c or kinds[column] == "string":
                shown.append(
                    f"CASE WHEN min({column}) OVER g = max({column}) OVER g"
                    f" AND count({column}) OVER g = count(*) OVER g THEN {column} END AS {column}")
                named.append(_pseudonym(c))
            else:
                ends = [f"{column}_from", f"{column}_to"]
                shown += [f"{f}({column}) OVER g AS {e}" for f, e in zip(("min", "max"), ends)]
                named += ends
        out[f"generalized_export_{name}"] = cte(name) + f"""
        , coded AS (SELECT *, row_number() OVER () AS r, {coded} FROM {name}),
        ends AS (SELECT {each("coalesce(min(x{i}), 0) AS a{i}, coalesce(max(x{i}), 0) AS b{i},"
                              " coalesce(bool_or(x{i} IS NULL), false) AS n{i}")} FROM coded),
        nulls AS (SELECT *, {each("a{i} - greatest((b{i} - a{i}) / 16, 1.0) AS z{i}")} FROM ends),
        filled AS (
          SELECT r, {each("coalesce(x{i}, z{i}) AS x{i}")},
                 {each("coalesce(nullif(b{i} - if(n{i}, z{i}, a{i}), 0), 1.0) AS w{i}")}
          FROM coded, nulls),
        parts AS (
          FROM (
            WITH RECURSIVE cuts AS (
              SELECT *, '' AS part, true AS open FROM filled
              UNION ALL
              SELECT r, {each("x{i}")}, {each("w{i}")},
                     CASE WHEN best IS NULL THEN part ELSE part || best.up::INT END,
                     best IS NOT NULL
              FROM (
                SELECT *, list_sort(list_filter([{options}], lambda o: o IS NOT NULL))[1] AS best
                FROM (
                  SELECT *, {each("count(*) FILTER (x{i} > m{i}) OVER p AS above{i},"
                                  " count(*) FILTER (x{i} >= m{i}) OVER p AS from{i}")}
                  FROM (
                    SELECT *, count(*) OVER p AS n,
                           {each("(max(x{i}) OVER p - min(x{i}) OVER p) / w{i} AS s{i},"
                                 " quantile_disc(x{i}, 0.5) OVER p AS m{i}")}
                    FROM cuts WHERE open WINDOW p AS (PARTITION BY part))
                  WINDOW p AS (PARTITION BY part))))
            SELECT r, part FROM cuts WHERE NOT open)),
        cut AS (SELECT {", ".join(shown)} FROM coded JOIN parts USING (r)
                WINDOW g AS (PARTITION BY part)
                QUALIFY count(*) OVER g >= {k})
        SELECT {", ".join(named)} FROM cut"""
    return out


def oracle_sql() -> dict[str, str]:
    reports = {name: cte(*tables.split()) + text for name, (tables, text) in REPORTS.items()}
    return reports | _checks() | _loads() | _files() | _exports() | _generalized()
