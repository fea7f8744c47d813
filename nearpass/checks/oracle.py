"""SQL for DuckDB, one text per registered query, written on its own terms."""

from __future__ import annotations

# Entity-shaped tables out of the benchmark's tables, as common table expressions.
BRIDGE = {
    "approaches": """
        SELECT CAST(l_shipdate AS DATE) AS close_approach_date, CAST(l_partkey AS VARCHAR) AS asteroid_id,
               l_partkey || ' ' || p_name || ' (' || (1990 + l_partkey % 30) || ' AB' || l_partkey || ')' AS name,
               p_size / 100.0e0 AS estimated_diameter_km_min,
               CASE WHEN p_size % 7 <> 0 THEN p_size / 40.0e0 END AS estimated_diameter_km_max,
               l_returnflag = 'R' AS is_potentially_hazardous, l_linestatus = 'F' AS is_sentry_object,
               l_orderkey AS epoch_date_close_approach,
               CASE WHEN l_orderkey % 50 = 0 THEN l_quantity * 3 ELSE l_quantity END AS relative_velocity_km_s,
               CASE WHEN l_linenumber <> 7 THEN l_extendedprice * 1000 END AS miss_distance_km,
               15.0e0 + l_discount AS absolute_magnitude_h, 'Earth' AS orbiting_body,
               l_orderkey AS src_order, l_linenumber AS src_line
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "sbdb": """
        SELECT p_partkey AS row_no,
               CASE WHEN p_partkey % 3 = 0 THEN 'S' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS asteroid_id,
               CASE WHEN p_partkey % 3 = 0 THEN 'P-' || p_partkey
                    ELSE (1990 + p_partkey % 30) || ' AB' || p_partkey END AS designation,
               CASE WHEN p_size % 5 = 0 THEN p_partkey || ' ' || p_name END AS name,
               p_name AS fullname, CAST(20000000 + p_partkey AS VARCHAR) AS spkid,
               CASE p_size % 6 WHEN 0 THEN 'APO' WHEN 1 THEN 'AMO' WHEN 2 THEN 'ATE' WHEN 3 THEN 'IEO' WHEN 4 THEN 'XXX' END
                   AS orbit_class,
               CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS orbit_class_name, p_size > 40 AS is_pha,
               p_size / 10.0e0 AS diameter_km, p_retailprice / 10000.0e0 AS moid_au,
               (p_size % 10) / 10.0e0 AS eccentricity, 3.0e0 + p_size % 5 AS t_jup,
               DATE '2024-01-01' + CAST(p_partkey % 30 AS INTEGER) AS ingestion_date
        FROM part""",
    "sentry": """
        SELECT CAST(s_suppkey AS VARCHAR) AS asteroid_id,
               CASE s_nationkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'removed' ELSE 'not_found' END AS status,
               (1990 + s_suppkey % 30) || ' AB' || s_suppkey AS designation, s_name AS fullname,
               ABS(s_acctbal) / 1.0e7 AS impact_probability, s_nationkey % 11 AS torino_scale,
               CASE WHEN s_nationkey <> 3 THEN s_acctbal / -1000.0e0 END AS palermo_scale_cum,
               s_acctbal / -900.0e0 AS palermo_scale_max
        FROM supplier""",
    "esa": """
        SELECT CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'E' || c_custkey END AS asteroid_id,
               true AS on_risk_list, LOWER((1990 + (c_custkey + 1) % 30) || ' AB' || (c_custkey + 1)) AS esa_designation,
               c_acctbal / 10.0e0 AS diameter_m, c_acctbal / -1000.0e0 AS ps_cum, c_nationkey % 3 AS ts
        FROM customer""",
    "cad": """
        SELECT CAST(o_custkey AS VARCHAR) AS asteroid_id, CAST(o_orderdate AS DATE) AS approach_date,
               o_totalprice / 1.0e6 AS distance_au, CAST(o_orderkey % 40 AS DOUBLE) AS v_rel_km_s,
               o_orderpriority AS body, o_orderkey AS src_order
        FROM orders""",
    "fireball": """
        SELECT ts AS event_date, value AS impact_energy_kt, value / 10.0e0 AS velocity_km_s,
               CASE WHEN event_type <> 'view' THEN value / 5.0e0 END AS altitude_km
        FROM events""",
    "fetches": """
        SELECT CAST(user_id AS VARCHAR) AS asteroid_id,
               CASE event_id % 4 WHEN 0 THEN 'JPL_SBDB' WHEN 1 THEN 'JPL_Sentry' WHEN 2 THEN 'JPL_CAD' ELSE 'ESA_NEOCC' END AS source,
               CASE event_type WHEN 'error' THEN 404 WHEN 'click' THEN 200 WHEN 'view' THEN 429 WHEN 'signup' THEN 400 ELSE 503 END
                   AS http_status,
               event_type, value, ts AS checked_at, event_id
        FROM events""",
    "statuses": """
        SELECT event_id, asteroid_id, source, checked_at,
               CASE WHEN event_type = 'signup' AND value > 10 THEN 404
                    WHEN event_type = 'click' AND value > 30 AND value <= 40 THEN 404 ELSE http_status END AS status_code,
               CASE WHEN event_type = 'error' OR (event_type = 'signup' AND value > 10)
                         OR (event_type = 'click' AND value > 30 AND value <= 40) THEN 'not_found'
                    WHEN event_type = 'click' AND value > 40 THEN 'removed'
                    WHEN event_type = 'click' AND value < 1 THEN 'invalid_json'
                    WHEN event_type = 'view' THEN 'rate_limited'
                    WHEN event_type = 'signup' THEN 'client_error'
                    WHEN event_type <> 'click' THEN 'server_error' END AS last_failure_type
        FROM fetches""",
    "last_statuses": """
        SELECT * FROM statuses
        QUALIFY ROW_NUMBER() OVER (PARTITION BY asteroid_id, source ORDER BY checked_at DESC, event_id DESC) = 1""",
    "holds": """
        SELECT asteroid_id, source, checked_at + INTERVAL 30 DAY AS not_found_until FROM last_statuses
        WHERE status_code = 404 AND checked_at + INTERVAL 30 DAY > TIMESTAMP '2024-02-15'""",
    "ledger": """
        SELECT window_start, window_start + 6 AS window_end, any_key, records, 1 + any_key % 3 AS attempt,
               CASE any_key % 4 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'SKIPPED' ELSE 'PENDING' END AS status
        FROM (SELECT CAST(o_orderdate AS DATE) AS window_start, MIN(o_orderkey) AS any_key, COUNT(*) AS records
              FROM orders GROUP BY 1)""",
    "calendar": """
        SELECT s AS window_start, LEAST(s + 6, hi) AS window_end
        FROM (SELECT CAST(UNNEST(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS s, hi
              FROM (SELECT MIN(window_start) AS lo, MAX(window_start) AS hi FROM ledger))""",
    "planned": """
        SELECT c.window_start, c.window_end,
               CASE WHEN h.window_start IS NOT NULL THEN 'SKIPPED' ELSE 'PENDING' END AS status,
               CASE WHEN h.window_start IS NOT NULL THEN COALESCE(l.attempt, 1) ELSE 1 END AS attempt
        FROM calendar c
        LEFT JOIN ledger l ON l.window_start = c.window_start AND l.window_end = c.window_end
        LEFT JOIN (SELECT window_start, window_end FROM ledger
                   WHERE window_start + CAST(any_key % 2000 AS INTEGER) > DATE '1998-06-01') h
               ON h.window_start = c.window_start AND h.window_end = c.window_end
        WHERE l.status IS DISTINCT FROM 'SUCCESS'""",
    "deduped": """
        SELECT * FROM approaches
        QUALIFY ROW_NUMBER() OVER (PARTITION BY close_approach_date, asteroid_id
            ORDER BY miss_distance_km NULLS LAST, epoch_date_close_approach) = 1""",
    "incoming": """
        SELECT close_approach_date, CASE WHEN src_line = 1 THEN 'N' ELSE '' END || asteroid_id AS asteroid_id,
               CASE WHEN src_line = 2 THEN 'Moon' ELSE orbiting_body END AS orbiting_body, src_line
        FROM deduped""",
    "objects": """
        SELECT asteroid_id, MAX_BY(name, close_approach_date) AS name FROM approaches GROUP BY asteroid_id""",
    # Identifiers of an object by place; names start with the object's number.
    "tries": """
        SELECT asteroid_id, 0 AS pos, regexp_extract(name, '^(\\d+)\\s', 1) AS cand FROM objects
        UNION ALL
        SELECT asteroid_id, 1, regexp_extract(name, '\\((\\d{4}\\s[A-Z]{2}\\d*)\\)', 1) FROM objects
        UNION ALL
        SELECT asteroid_id, 2, trim(regexp_replace(name, '\\(.*?\\)', '', 'g')) FROM objects""",
    "orbit_keys": """
        SELECT key, MAX_BY(row_no, row_no * 3 + i) AS row_no FROM (
            SELECT designation AS key, row_no, 0 AS i FROM sbdb
            UNION ALL SELECT spkid, row_no, 1 FROM sbdb
            UNION ALL SELECT LOWER(name), row_no, 2 FROM sbdb WHERE name IS NOT NULL)
        GROUP BY key""",
    "orbit_hits": """
        SELECT t.asteroid_id, s.asteroid_id AS sbdb_id, s.designation, s.spkid, t.pos, t.form
        FROM (SELECT asteroid_id, pos, 0 AS form, cand AS key FROM tries WHERE cand <> ''
              UNION ALL SELECT asteroid_id, pos, 1, LOWER(cand) FROM tries WHERE cand <> '') t
        JOIN orbit_keys k ON k.key = t.key JOIN sbdb s ON s.row_no = k.row_no
        QUALIFY ROW_NUMBER() OVER (PARTITION BY t.asteroid_id ORDER BY t.pos, t.form) = 1""",
}

# Which other expressions each one reads.
NEEDS = {
    "statuses": ["fetches"],
    "last_statuses": ["statuses"],
    "holds": ["last_statuses"],
    "calendar": ["ledger"],
    "planned": ["calendar"],
    "deduped": ["approaches"],
    "incoming": ["deduped"],
    "objects": ["approaches"],
    "tries": ["objects"],
    "orbit_keys": ["sbdb"],
    "orbit_hits": ["tries", "orbit_keys"],
}


def _with(names: str, body: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({BRIDGE[n]})" for n in ordered) + body if ordered else body


SQL: dict[str, str] = {}


def sql(name: str, uses: str, body: str) -> None:
    SQL[name] = _with(uses, body)


# --- aggregates ---------------------------------------------------------------------

sql("daily_metrics", "approaches", """
    , rows_ AS (
        SELECT close_approach_date AS day, COALESCE(estimated_diameter_km_max, estimated_diameter_km_min) AS d,
               relative_velocity_km_s AS v, miss_distance_km AS m, is_potentially_hazardous AS h,
               CASE WHEN miss_distance_km IS NULL THEN 0.0e0 ELSE LEAST(1.0e0, GREATEST(0.0e0,
                   COALESCE(relative_velocity_km_s, 0) / 40.0e0 * 0.35e0
                   + COALESCE(estimated_diameter_km_max, 0) / 5.0e0 * 0.35e0
                   + 1.0e0 / GREATEST(miss_distance_km, 1.0e0) * 1000000.0e0 * 0.30e0
                   + CASE WHEN is_potentially_hazardous THEN 0.15e0 ELSE 0.0e0 END)) END AS risk
        FROM approaches),
    whole AS (
        SELECT AVG(d) AS da, STDDEV_POP(d) AS ds, AVG(v) AS va, STDDEV_POP(v) AS vs, AVG(m) AS ma, STDDEV_POP(m) AS ms
        FROM rows_)
    SELECT day AS metric_date, COUNT(*) AS asteroid_count, COUNT(*) FILTER (WHERE h) AS hazardous_count,
           ROUND(AVG(v), 9) AS avg_velocity_km_s, ROUND(AVG(d), 9) AS avg_diameter_km,
           COUNT(*) FILTER (WHERE risk >= 0.6) AS high_risk_count, ROUND(AVG(risk), 9) AS avg_risk_score,
           ROUND(MAX(v), 9) AS max_velocity_km_s, ROUND(MAX(d), 9) AS max_diameter_km,
           ROUND(MIN(m), 4) AS min_miss_distance_km, ROUND(AVG(m), 4) AS avg_miss_distance_km,
           COUNT(*) FILTER (WHERE ABS((d - da) / ds) > 2 OR ABS((v - va) / vs) > 2 OR ABS((m - ma) / ms) > 2) AS anomaly_count
    FROM rows_ CROSS JOIN whole GROUP BY day""")

sql("object_zscores", "sbdb", """
    SELECT asteroid_id, orbit_class, ROUND(diameter_km, 6) AS diameter_km, ROUND(t_jup, 6) AS t_jup,
           ROUND(CASE WHEN STDDEV_POP(diameter_km) OVER () = 0 THEN 0
                 ELSE (diameter_km - AVG(diameter_km) OVER ()) / STDDEV_POP(diameter_km) OVER () END, 6) AS diameter_z,
           ROUND(CASE WHEN STDDEV_POP(t_jup) OVER (PARTITION BY orbit_class) = 0 THEN 0
                 ELSE (t_jup - AVG(t_jup) OVER (PARTITION BY orbit_class)) / STDDEV_POP(t_jup) OVER (PARTITION BY orbit_class)
                 END, 6) AS t_jup_z
    FROM sbdb""")

sql("approach_stats", "approaches", """
    SELECT COUNT(*) AS total_records, COUNT(DISTINCT asteroid_id) AS unique_asteroids,
           MIN(close_approach_date) AS earliest_date, MAX(close_approach_date) AS latest_date,
           COUNT(*) FILTER (WHERE is_potentially_hazardous) AS hazardous_approaches
    FROM approaches""")

sql("estimated_objects", "approaches", """
    SELECT CAST(YEAR(close_approach_date) AS INTEGER) AS year, COUNT(*) AS n_records, true AS is_near FROM approaches GROUP BY 1
    UNION ALL SELECT NULL, COUNT(*), true FROM approaches""")

sql("approach_summary", "approaches", """
    SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE is_potentially_hazardous) AS hazardous,
           ROUND(MIN(miss_distance_km), 4) AS closest_approach_km, MAX(relative_velocity_km_s) AS fastest_km_s
    FROM approaches""")

sql("velocity_histogram", "approaches", """
    SELECT CAST(CASE WHEN relative_velocity_km_s < 0 THEN 0 WHEN relative_velocity_km_s >= 40 THEN 9
                ELSE FLOOR(relative_velocity_km_s / 5) + 1 END AS BIGINT) AS bucket,
           COUNT(*) AS count, ROUND(AVG(relative_velocity_km_s), 2) AS avg_vel
    FROM approaches WHERE relative_velocity_km_s IS NOT NULL GROUP BY 1""")

sql("size_classes", "approaches", """
    SELECT CASE WHEN estimated_diameter_km_max < 0.01 THEN '<10m' WHEN estimated_diameter_km_max < 0.1 THEN '10-100m'
                WHEN estimated_diameter_km_max < 0.5 THEN '100-500m' WHEN estimated_diameter_km_max < 1 THEN '500m-1km'
                ELSE '>1km' END AS size_class, COUNT(*) AS count
    FROM approaches WHERE estimated_diameter_km_max IS NOT NULL GROUP BY 1""")

sql("approach_window", "approaches", """
    SELECT asteroid_id, name, close_approach_date, is_potentially_hazardous,
           ROUND(estimated_diameter_km_max, 9) AS estimated_diameter_km_max,
           ROUND(relative_velocity_km_s, 9) AS relative_velocity_km_s, ROUND(miss_distance_km, 4) AS miss_distance_km,
           ROUND(absolute_magnitude_h, 9) AS absolute_magnitude_h
    FROM approaches WHERE close_approach_date BETWEEN DATE '1998-06-01' AND DATE '1998-06-08'""")

sql("approach_window_summary", "approaches", """
    SELECT COUNT(*) AS count, COUNT(*) FILTER (WHERE is_potentially_hazardous) AS hazardous_count
    FROM approaches WHERE close_approach_date BETWEEN DATE '1998-06-01' AND DATE '1998-07-01'""")

sql("orbit_class_dist", "sbdb", """
    SELECT orbit_class,
           CASE orbit_class WHEN 'APO' THEN 'Apollo' WHEN 'AMO' THEN 'Amor' WHEN 'ATE' THEN 'Aten' WHEN 'IEO' THEN 'Atira'
                ELSE COALESCE(NULLIF(orbit_class_name, ''), orbit_class) END AS orbit_class_name,
           COUNT(*) AS total, COUNT(*) FILTER (WHERE is_pha) AS pha_count, ROUND(AVG(diameter_km), 9) AS avg_diameter_km,
           ROUND(AVG(moid_au), 9) AS avg_moid_au, ROUND(AVG(eccentricity), 9) AS avg_eccentricity,
           ROUND(AVG(t_jup), 9) AS avg_t_jup
    FROM sbdb WHERE orbit_class IS NOT NULL GROUP BY 1, 2""")

sql("fireball_annual", "fireball", """
    SELECT CAST(YEAR(event_date) AS INTEGER) AS year, COUNT(*) AS event_count, ROUND(SUM(impact_energy_kt), 4) AS total_energy_kt,
           MAX(impact_energy_kt) AS max_energy_kt, ROUND(AVG(velocity_km_s), 4) AS avg_velocity_km_s,
           ROUND(AVG(altitude_km), 4) AS avg_altitude_km
    FROM fireball GROUP BY 1""")

sql("fireball_daily", "fireball", """
    SELECT CAST(event_date AS DATE) AS day, COUNT(*) AS event_count, ROUND(SUM(impact_energy_kt), 6) AS total_energy_kt,
           ROUND(MAX(impact_energy_kt), 6) AS max_energy_kt, ROUND(AVG(velocity_km_s), 6) AS avg_velocity_km_s,
           ROUND(AVG(altitude_km), 6) AS avg_altitude_km
    FROM fireball GROUP BY 1""")

sql("fireball_latest", "fireball", """
    SELECT event_date, ROUND(impact_energy_kt, 9) AS impact_energy_kt, ROUND(velocity_km_s, 9) AS velocity_km_s,
           ROUND(altitude_km, 9) AS altitude_km
    FROM fireball ORDER BY event_date DESC LIMIT 20""")

sql("agency_table_counts", "sbdb sentry cad esa", """
    SELECT 'sbdb' AS source, COUNT(*) AS count FROM sbdb UNION ALL SELECT 'sentry', COUNT(*) FROM sentry
    UNION ALL SELECT 'cad', COUNT(*) FROM cad UNION ALL SELECT 'esa', COUNT(*) FROM esa""")

sql("text_profile", "", """
    SELECT source, SUM(LENGTH(text)) > 0 AS available, CAST(SUM(LENGTH(text)) AS BIGINT) AS n_chars
    FROM documents GROUP BY source""")

# --- keyed picks and profiles --------------------------------------------------------

LATEST = """
    SELECT * FROM approaches QUALIFY ROW_NUMBER() OVER (PARTITION BY asteroid_id
        ORDER BY close_approach_date DESC, miss_distance_km NULLS LAST, epoch_date_close_approach) = 1"""

sql("latest_approach", "approaches", f"""
    SELECT asteroid_id, name, close_approach_date, ROUND(miss_distance_km, 4) AS miss_distance_km FROM ({LATEST})""")

sql("dedupe_approaches", "deduped", """
    SELECT close_approach_date, asteroid_id, epoch_date_close_approach, ROUND(miss_distance_km, 4) AS miss_distance_km
    FROM deduped""")

sql("dedupe_passages", "cad", """
    SELECT asteroid_id, approach_date, ROUND(distance_au, 9) AS distance_au, v_rel_km_s, body, src_order FROM cad
    QUALIFY ROW_NUMBER() OVER (PARTITION BY asteroid_id, approach_date ORDER BY src_order DESC) = 1""")

sql("object_profile", "approaches sbdb sentry esa", f"""
    SELECT n.asteroid_id, n.name, n.is_potentially_hazardous, n.close_approach_date AS last_close_approach,
           s.designation AS sbdb_designation, s.spkid, s.orbit_class, ROUND(s.moid_au, 9) AS moid_au, s.is_pha,
           r.status AS sentry_status, ROUND(r.impact_probability, 9) AS impact_probability, r.torino_scale,
           ROUND(r.palermo_scale_cum, 9) AS palermo_scale_cum, e.on_risk_list AS esa_on_risk_list,
           ROUND(e.ps_cum, 9) AS esa_ps_cum, e.ts AS esa_torino_scale, ROUND(e.diameter_m, 9) AS esa_diameter_m
    FROM ({LATEST}) n
    LEFT JOIN sbdb s ON s.asteroid_id = n.asteroid_id
    LEFT JOIN sentry r ON r.asteroid_id = n.asteroid_id
    LEFT JOIN esa e ON e.asteroid_id = n.asteroid_id OR LOWER(e.esa_designation) = LOWER(s.designation)""")

sql("cad_enriched", "cad sbdb sentry esa", """
    SELECT c.asteroid_id, c.approach_date, ROUND(c.distance_au, 9) AS distance_au, c.v_rel_km_s, c.body,
           COALESCE(r.status = 'active', false) AS on_sentry_watchlist, ROUND(r.palermo_scale_cum, 9) AS palermo_scale_cum,
           r.torino_scale, e.on_risk_list AS esa_risk
    FROM cad c
    LEFT JOIN sentry r ON r.asteroid_id = c.asteroid_id
    LEFT JOIN sbdb s ON s.asteroid_id = c.asteroid_id
    LEFT JOIN esa e ON e.asteroid_id = c.asteroid_id OR LOWER(e.esa_designation) = LOWER(s.designation)""")

sql("cad_range", "cad", """
    SELECT asteroid_id, approach_date, ROUND(distance_au, 9) AS distance_au, v_rel_km_s, body FROM cad
    WHERE approach_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND distance_au <= 0.3e0""")

sql("recent_passages", "cad", """
    SELECT asteroid_id, approach_date, ROUND(distance_au, 9) AS distance_au FROM cad
    QUALIFY ROW_NUMBER() OVER (PARTITION BY asteroid_id ORDER BY approach_date DESC, distance_au) <= 50""")

sql("profile_document", "approaches sbdb sentry cad esa", """
    SELECT o.asteroid_id, COALESCE(NULLIF(s.fullname, ''), o.asteroid_id) AS name, s.is_pha, s.designation,
           ROUND(s.moid_au, 9) AS moid_au, CASE WHEN s.asteroid_id IS NOT NULL THEN 'AU' END AS moid_units,
           r.status AS sentry_status, c.n_passages, CAST(c.last_passage AS VARCHAR) AS last_passage,
           e.esa_designation, e.asteroid_id IS NOT NULL AS has_esa
    FROM (SELECT DISTINCT asteroid_id FROM approaches) o
    LEFT JOIN sbdb s USING (asteroid_id)
    LEFT JOIN sentry r USING (asteroid_id)
    LEFT JOIN (SELECT asteroid_id, LEAST(COUNT(*), 50) AS n_passages, MAX(approach_date) AS last_passage
               FROM cad GROUP BY asteroid_id) c USING (asteroid_id)
    LEFT JOIN esa e USING (asteroid_id)""")

sql("json_safe_rows", "fireball", """
    SELECT strftime(event_date, '%Y-%m-%dT%H:%M:%S.%f') AS event_date, ROUND(impact_energy_kt, 9) AS impact_energy_kt,
           CAST(CAST(event_date AS DATE) AS VARCHAR) AS day FROM fireball""")

# --- watchlists ------------------------------------------------------------------------

sql("sentry_watchlist", "sentry", """
    SELECT asteroid_id, fullname, designation, ROUND(impact_probability, 9) AS impact_probability, torino_scale,
           ROUND(palermo_scale_cum, 9) AS palermo_scale_cum, ROUND(palermo_scale_max, 9) AS palermo_scale_max
    FROM sentry WHERE status = 'active'""")

ENTRIES = """
    SELECT designation, ip AS impact_probability, torino_scale, arrival, first_seen FROM (
        SELECT *, MIN(arrival) OVER (PARTITION BY designation) AS first_seen,
               ROW_NUMBER() OVER (PARTITION BY designation ORDER BY ip DESC, arrival) AS place
        FROM (SELECT (1990 + o_custkey % 30) || ' AB' || o_custkey AS designation, ROUND(o_totalprice / 1.0e4, 0) AS ip,
                     CAST(o_orderkey % 11 AS INTEGER) AS torino_scale, o_orderkey AS arrival FROM orders))
    WHERE place = 1"""

sql("best_per_designation", "", ENTRIES)

sql("watchlist_top100", "", f"""
    SELECT *, CASE WHEN torino_scale <= 0 THEN '0' WHEN torino_scale <= 1 THEN '1' WHEN torino_scale <= 4 THEN '2-4'
                   WHEN torino_scale <= 7 THEN '5-7' ELSE '8+' END AS torino_band
    FROM ({ENTRIES}) ORDER BY impact_probability DESC, first_seen LIMIT 100""")

sql("torino_bands", "sentry", """
    SELECT CASE WHEN torino_scale = 0 THEN '0' WHEN torino_scale = 1 THEN '1' WHEN torino_scale < 5 THEN '2-4'
                WHEN torino_scale < 8 THEN '5-7' ELSE '8+' END AS band, COUNT(*) AS n_objects
    FROM sentry GROUP BY 1""")

# --- expressions -------------------------------------------------------------------------

sql("object_names", "objects", " SELECT asteroid_id, name FROM objects")

CANDIDATES = """
    SELECT asteroid_id, array_to_string(list(cand ORDER BY pos), '|') AS candidates FROM (
        SELECT asteroid_id, pos, cand FROM tries WHERE cand <> ''
        QUALIFY ROW_NUMBER() OVER (PARTITION BY asteroid_id, cand ORDER BY pos) = 1)
    GROUP BY asteroid_id"""

sql("candidates", "tries", CANDIDATES)

sql("normalised_names", "objects", """
    SELECT asteroid_id, LOWER(REPLACE(REPLACE(name, '(', ''), ')', '')) AS key,
           REPLACE(LOWER(REPLACE(REPLACE(name, '(', ''), ')', '')), ' ', '') AS bare, asteroid_id AS number
    FROM objects""")

sql("safe_casts", "", """
    SELECT o_orderkey AS n,
           CASE o_orderkey % 8 WHEN 0 THEN CAST(o_custkey AS DOUBLE) WHEN 1 THEN CAST(o_custkey AS DOUBLE)
                WHEN 2 THEN ROUND(CAST(o_custkey || 'E-3' AS DOUBLE), 9)
                WHEN 5 THEN ROUND(CAST('-0.' || o_custkey AS DOUBLE), 9) END AS as_double,
           CASE o_orderkey % 8 WHEN 0 THEN CAST(o_custkey AS INTEGER) END AS as_int
    FROM orders""")

sql("cad_dates", "", """
    SELECT o_orderkey AS n, CASE WHEN o_orderkey % 4 <> 2 THEN CAST(o_orderdate AS DATE) END AS passage_date,
           CASE WHEN o_orderkey % 4 = 3 THEN CAST(o_orderdate AS DATE) END AS iso_date
    FROM orders""")

sql("row_hashes", "approaches", """
    SELECT src_order, src_line,
           md5(concat_ws('||', asteroid_id, close_approach_date, epoch_date_close_approach,
                         CASE WHEN src_line <> 3 THEN name END, orbiting_body)) AS loose,
           md5(concat_ws('||', asteroid_id, close_approach_date, epoch_date_close_approach,
                         CASE WHEN src_line <> 3 THEN name ELSE '~' END, orbiting_body)) AS strict
    FROM approaches""")

# --- readers --------------------------------------------------------------------------------

sql("flatten_messages", "deduped", """
    SELECT close_approach_date, asteroid_id, name, is_potentially_hazardous,
           ROUND(estimated_diameter_km_max, 9) AS estimated_diameter_km_max, relative_velocity_km_s,
           ROUND(miss_distance_km, 4) AS miss_distance_km, epoch_date_close_approach
    FROM deduped""")

sql("feed_documents", "approaches", """
    SELECT close_approach_date AS day, COUNT(*) AS n_messages, COUNT(DISTINCT asteroid_id) AS n_objects
    FROM approaches GROUP BY 1""")

sql("feed_days", "approaches", """
    SELECT close_approach_date AS day, asteroid_id, COUNT(*) AS n_messages, ROUND(SUM(miss_distance_km), 2) AS miss_km
    FROM approaches GROUP BY 1, 2""")

sql("row_rejects", "approaches", """
    SELECT CASE WHEN src_order % 13 = 0 OR src_order % 17 = 0 THEN 'unreadable' WHEN src_order % 19 = 0 THEN 'missing' END AS date_fault,
           CASE WHEN src_line = 5 THEN 'missing' END AS id_fault, COUNT(*) AS n_rows
    FROM approaches GROUP BY 1, 2""")

sql("published_keys", "approaches", """
    SELECT CAST(close_approach_date AS VARCHAR) AS key, COUNT(*) AS n_messages, COUNT(DISTINCT asteroid_id) AS n_objects, true AS agrees
    FROM approaches GROUP BY 1""")

sql("record_hashes", "", """
    SELECT p_partkey AS id, md5(
        's' || '10:attributes' || 'm2:' || least(a, b) || greatest(a, b) || '2:id' || 'v' || length(CAST(p_partkey AS VARCHAR)) || ':' || p_partkey
        || '8:measured' || 's' || '4:mark' || CASE WHEN p_size % 3 = 0 THEN 'v0:' ELSE 'n' END
        || '4:size' || 'v' || length(CAST(p_size AS VARCHAR)) || ':' || p_size
        || '5:parts' || CASE WHEN p_size % 5 = 0 THEN 'n' ELSE 'a3:v' || length(p_name) || ':' || p_name || 'n' || 'v2:||' END) AS hash
    FROM (SELECT *, 'v1:bv' || length(p_type) || ':' || p_type AS b, 'v5:a||1:v' || length(p_brand) || ':' || p_brand AS a FROM part)""")

sql("malformed_messages", "", """
    SELECT CASE WHEN l_partkey % 5 = 0 THEN 'malformed' WHEN l_partkey % 7 = 0 THEN 'no asteroid' ELSE 'good' END AS verdict,
           COUNT(*) AS n_messages
    FROM lineitem GROUP BY 1""")

sql("sbdb_bulk", "", """
    SELECT (1990 + p_partkey % 30) || ' AB' || p_partkey AS designation, CAST(20000000 + p_partkey AS VARCHAR) AS spkid,
           p_name AS fullname, p_size % 2 = 0 AS is_neo, p_size > 40 AS is_pha,
           CASE WHEN p_size % 6 = 0 THEN 'APO' ELSE 'AMO' END AS orbit_class, 'J2000' AS equinox,
           ROUND((p_size % 10) / 10.0e0, 9) AS eccentricity, ROUND(p_retailprice / 10000.0e0, 9) AS moid_au,
           CASE WHEN p_size % 4 <> 0 AND p_size % 3 <> 0 THEN p_size END AS n_obs_used,
           CASE WHEN p_size % 4 <> 0 THEN 17.25e0 END AS absolute_magnitude_h
    FROM part WHERE p_size <> 13""")

sql("bulk_documents", "", """
    SELECT (1990 + p_partkey % 30) || ' AB' || p_partkey AS designation, CAST(20000000 + p_partkey AS VARCHAR) AS spkid,
           p_name AS fullname, p_size % 2 = 0 AS is_neo, p_size > 40 AS is_pha,
           CASE WHEN p_size % 6 = 0 THEN 'APO' ELSE 'AMO' END AS orbit_class,
           ROUND((p_size % 10) / 10.0e0, 9) AS eccentricity,
           CASE WHEN p_size % 4 <> 0 AND p_size % 3 <> 0 THEN p_size END AS n_obs_used,
           CASE WHEN p_size % 4 <> 0 THEN 17.25e0 END AS absolute_magnitude_h
    FROM part WHERE p_size <> 13""")

sql("zip_fields", "", """
    SELECT p_partkey AS payload, CASE WHEN p_size = 13 THEN '' ELSE (1990 + p_partkey % 30) || ' AB' || p_partkey END AS pdes,
           CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS full_name,
           CASE WHEN p_size % 4 <> 0 THEN '17.25' END AS h,
           CASE WHEN p_size % 4 = 0 THEN 9 ELSE 11 END - CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS n_cells
    FROM part""")

sql("sbdb_documents", "", """
    SELECT (1990 + p_partkey % 30) || ' AB' || p_partkey AS designation, CAST(20000000 + p_partkey AS VARCHAR) AS spkid,
           CASE WHEN p_size % 2 = 0 THEN 'orb' ELSE 'obj' END AS orbit_id, p_size % 3 = 0 AS is_neo, p_size > 40 AS is_pha,
           'APO' AS orbit_class, p_type AS orbit_class_name,
           CASE WHEN p_size % 5 = 0 THEN '[{"des":"' || p_brand || '"}]' END AS des_alt, p_size AS data_arc_days,
           ROUND(p_size / 50.0e0, 6) AS eccentricity, ROUND(p_partkey / 7.0e0, 6) AS semi_major_axis_au,
           CASE WHEN p_size % 7 <> 0 THEN 17.5e0 END AS absolute_magnitude_h,
           CASE WHEN p_size % 7 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN 'S' ELSE 'Sq' END END AS spectral_type
    FROM part""")

sql("cad_payloads", "", """
    SELECT (1990 + o_custkey % 30) || ' AB' || o_custkey AS designation, CAST(o_orderdate AS DATE) AS approach_date,
           ROUND(o_totalprice / 1.0e6, 9) AS distance_au, o_orderpriority AS fullname, 'Earth' AS body
    FROM orders WHERE o_orderkey % 4 < 2""")

sql("cad_designations", "", """
    SELECT (1990 + o_custkey % 30) || ' AB' || o_custkey AS designation, COUNT(*) AS n_records,
           MIN(CAST(o_orderdate AS DATE)) AS first_date, MAX(CAST(o_orderdate AS DATE)) AS last_date,
           ROUND(MIN(o_totalprice / 1.0e6), 9) AS nearest_au
    FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")

sql("fireball_payloads", "", """
    SELECT CAST(ts AS DATE) AS day, 'N' AS latitude_dir, COUNT(*) AS n_events, ROUND(SUM(value), 6) AS energy_kt
    FROM events WHERE event_type <> 'error' GROUP BY 1""")

LISTED = """
    SELECT c_custkey AS line_no, LOWER((1990 + c_custkey % 30) || 'AB' || c_custkey) AS key,
           (1990 + c_custkey % 30) || 'AB' || c_custkey AS esa_designation,
           CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS esa_name, ROUND(c_acctbal / 10.0e0, 9) AS diameter_m,
           c_custkey % 2 = 0 AS diameter_certain, '2044-11-08 17:08' AS vi_date, ROUND(c_nationkey / 1000.0e0, 9) AS ip_max,
           ROUND(c_acctbal / -1000.0e0, 9) AS ps_max, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey % 3 END AS ts,
           '2044-2049' AS years, -2.67e0 AS ps_cum
    FROM customer WHERE c_custkey % 50 NOT BETWEEN 1 AND 5"""

sql("esa_parse", "", LISTED)

sql("esa_overlay", "", f"""
    SELECT COALESCE(s.key, l.key) AS key, CASE WHEN s.key IS NULL THEN l.esa_name ELSE 'Special' END AS esa_name,
           CASE WHEN s.key IS NULL THEN l.diameter_m ELSE 7.0e0 END AS diameter_m,
           CASE WHEN s.key IS NULL THEN l.ip_max ELSE 0.1e0 END AS ip_max, s.key IS NOT NULL AS is_special
    FROM ({LISTED}) l
    FULL JOIN (SELECT LOWER((1990 + s_suppkey % 30) || 'AB' || s_suppkey) AS key FROM supplier) s ON s.key = l.key""")

sql("sentry_active", "sentry", """
    SELECT designation, 'active' AS status, fullname, ROUND(impact_probability, 9) AS impact_probability, torino_scale,
           ROUND(palermo_scale_cum, 9) AS palermo_scale_cum, CAST(NULL AS INTEGER) AS n_impacts
    FROM sentry""")

sql("sentry_removed", "", """
    SELECT LOWER((1990 + k % 30) || ' AB' || k) AS key, MAX_BY(c_name, c_custkey) AS removed_date
    FROM (SELECT c_custkey // 3 AS k, c_name, c_custkey FROM customer) GROUP BY 1""")

sql("sentry_documents", "", """
    SELECT CASE WHEN s_nationkey % 4 = 3 THEN (1990 + s_suppkey % 30) || ' AB' || s_suppkey ELSE s_name END AS designation,
           CASE s_nationkey % 4 WHEN 0 THEN 'removed' WHEN 3 THEN 'active' ELSE 'not_found' END AS status,
           CASE WHEN s_nationkey % 4 = 3 THEN ROUND(ABS(s_acctbal) / 1.0e7, 9) END AS impact_probability,
           CASE WHEN s_nationkey % 4 = 3 THEN s_nationkey END AS n_obs,
           CASE WHEN s_nationkey % 4 = 0 THEN '2021-05-01' END AS removed_date
    FROM supplier""")

# --- resolution ----------------------------------------------------------------------------------

# Identifiers after the orbit hit: its designation first, its spk id last.
EXTENDED = """
    SELECT t.asteroid_id, t.pos, t.cand FROM tries t LEFT JOIN {hits} h USING (asteroid_id)
    WHERE t.cand <> '' AND t.cand IS DISTINCT FROM h.designation
    QUALIFY ROW_NUMBER() OVER (PARTITION BY t.asteroid_id, t.cand ORDER BY t.pos) = 1
    UNION ALL SELECT asteroid_id, -1, designation FROM {hits}
    UNION ALL SELECT asteroid_id, 9, spkid FROM {hits}"""

sql("resolve_sbdb", "orbit_hits", f"""
    , ext AS ({EXTENDED.format(hits="orbit_hits")})
    SELECT o.asteroid_id, h.sbdb_id, h.pos, h.form,
           (SELECT array_to_string(list(cand ORDER BY pos), '|') FROM ext e WHERE e.asteroid_id = o.asteroid_id) AS candidates
    FROM objects o LEFT JOIN orbit_hits h USING (asteroid_id)""")

sql("sbdb_coverage", "orbit_hits", """
    SELECT COUNT(*) AS n_objects, COUNT(h.sbdb_id) AS bulk_hits, COUNT(*) - COUNT(h.sbdb_id) AS gap_fill
    FROM objects o LEFT JOIN orbit_hits h USING (asteroid_id)""")

sql("gap_fill", "orbit_hits", """
    SELECT t.asteroid_id, CAST(ROW_NUMBER() OVER (PARTITION BY t.asteroid_id ORDER BY t.pos) - 1 AS INTEGER) AS try_no,
           t.cand AS lookup_value
    FROM tries t ANTI JOIN orbit_hits h USING (asteroid_id) WHERE t.cand <> ''""")

sql("index_collisions", "sbdb", """
    SELECT key, MAX_BY(asteroid_id, row_no) AS sbdb_id, COUNT(*) AS n_records FROM (
        SELECT designation AS key, asteroid_id, row_no FROM sbdb UNION ALL SELECT spkid, asteroid_id, row_no FROM sbdb
        UNION ALL SELECT LOWER(fullname), asteroid_id, row_no FROM sbdb)
    GROUP BY key HAVING COUNT(*) > 1""")

# The catalogues behind the orbits, by the candidates in `ext` (asteroid_id, pos, cand) and the orbit hits in `hits`.
OTHERS = """
    norm AS (SELECT *, LOWER(translate(cand, '()''', '')) AS key FROM ext),
    risk AS (
        SELECT n.asteroid_id, r.status, n.cand, n.key, r.fullname FROM norm n
        JOIN sentry r ON LOWER(r.designation) = n.key AND r.status IN ('active', 'removed')
        QUALIFY ROW_NUMBER() OVER (PARTITION BY n.asteroid_id ORDER BY n.pos, r.status) = 1),
    cad_des AS (SELECT DISTINCT (1990 + o_custkey % 30) || ' AB' || o_custkey AS designation FROM orders),
    near AS (
        SELECT n.asteroid_id, c.designation FROM norm n JOIN cad_des c ON c.designation = n.cand
        QUALIFY ROW_NUMBER() OVER (PARTITION BY n.asteroid_id ORDER BY n.pos) = 1),
    list_keys AS (SELECT CASE WHEN asteroid_id LIKE 'E%' THEN REPLACE(esa_designation, ' ', '') ELSE esa_designation END AS key FROM esa),
    listed AS (
        SELECT n.asteroid_id, k.key FROM norm n
        JOIN list_keys k ON REPLACE(k.key, ' ', '') = REPLACE(n.key, ' ', '')
        QUALIFY ROW_NUMBER() OVER (PARTITION BY n.asteroid_id ORDER BY n.pos) = 1)"""

HELD = """
    , held AS (SELECT asteroid_id, bool_or(source = 'JPL_SBDB') AS s, bool_or(source = 'JPL_Sentry') AS r,
                      bool_or(source = 'JPL_CAD') AS c, bool_or(source = 'ESA_NEOCC') AS e FROM holds GROUP BY asteroid_id)"""

PROFILES = """
    SELECT o.asteroid_id,
           (SELECT array_to_string(list(cand ORDER BY pos), '|') FROM ext e WHERE e.asteroid_id = o.asteroid_id) AS candidates,
           hits.sbdb_id, {more}
           CASE WHEN held.r IS NOT TRUE THEN COALESCE(risk.status, 'not_found') END AS sentry_status,
           CASE WHEN held.r IS NOT TRUE THEN COALESCE(risk.cand,
                (SELECT MIN_BY(cand, pos) FROM ext e WHERE e.asteroid_id = o.asteroid_id)) END AS sentry_designation,
           CASE WHEN held.r IS NOT TRUE AND risk.status = 'active' THEN risk.key END AS sentry_key,
           CASE WHEN held.r IS NOT TRUE AND risk.status = 'removed' THEN risk.fullname END AS removed_date,
           CASE WHEN held.c IS NOT TRUE THEN near.designation END AS cad_designation,
           CASE WHEN held.e IS NOT TRUE THEN listed.key IS NOT NULL END AS on_risk_list,
           CASE WHEN held.e IS NOT TRUE THEN listed.key END AS esa_key
    FROM objects o LEFT JOIN held USING (asteroid_id) LEFT JOIN hits USING (asteroid_id) LEFT JOIN risk USING (asteroid_id)
    LEFT JOIN near USING (asteroid_id) LEFT JOIN listed USING (asteroid_id)"""

sql("resolve_profiles", "orbit_hits holds sentry esa", f"""{HELD},
    hits AS (SELECT h.* FROM orbit_hits h LEFT JOIN held USING (asteroid_id) WHERE held.s IS NOT TRUE),
    ext AS ({EXTENDED.format(hits="hits")}),{OTHERS}{PROFILES.format(more="")}""")

# Responses to the misses of the first pass, by identifier, and the tries up to the first answer.
LANDED = """
    landed AS (
        SELECT CAST(p_partkey AS VARCHAR) AS lookup_value, CASE WHEN p_size % 4 < 2 THEN 200 ELSE 404 END AS http_status,
               p_size % 4 = 0 AS ok, CASE WHEN p_size % 8 < 4 THEN (1990 + (p_partkey + 1) % 30) || ' AB' || (p_partkey + 1) END AS des,
               CAST(p_partkey + 30000000 AS VARCHAR) AS spkid FROM part
        UNION ALL
        SELECT (1990 + p_partkey % 30) || ' AB' || p_partkey, CASE WHEN p_size % 4 < 3 THEN 200 ELSE 503 END, p_size % 4 < 3,
               (1990 + p_partkey * 2 % 30) || ' AB' || (p_partkey * 2), CAST(p_partkey AS VARCHAR) FROM part),
    met AS (
        SELECT t.asteroid_id, t.try_no, l.* FROM (
            SELECT asteroid_id, cand, ROW_NUMBER() OVER (PARTITION BY asteroid_id ORDER BY pos) - 1 AS try_no FROM (
                SELECT * FROM tries WHERE cand <> '' QUALIFY ROW_NUMBER() OVER (PARTITION BY asteroid_id, cand ORDER BY pos) = 1)) t
        JOIN landed l ON l.lookup_value = t.cand
        LEFT JOIN held h USING (asteroid_id) ANTI JOIN orbit USING (asteroid_id) WHERE h.s IS NOT TRUE),
    first_answer AS (SELECT asteroid_id, MIN(try_no) AS n FROM met WHERE ok GROUP BY asteroid_id),
    answers AS (SELECT m.* FROM met m JOIN first_answer f ON f.asteroid_id = m.asteroid_id AND f.n = m.try_no)"""

sql("resolve_second_pass", "orbit_hits holds sentry esa", f"""{HELD},
    orbit AS (SELECT h.* FROM orbit_hits h LEFT JOIN held USING (asteroid_id) WHERE held.s IS NOT TRUE),{LANDED},
    hits AS (
        SELECT asteroid_id, sbdb_id, designation, spkid, CAST(NULL AS VARCHAR) AS answered_by FROM orbit
        UNION ALL SELECT asteroid_id, NULL, des, spkid, lookup_value FROM answers),
    ext AS (
        SELECT t.asteroid_id, t.pos, t.cand FROM tries t LEFT JOIN hits h USING (asteroid_id)
        WHERE t.cand <> '' AND t.cand IS DISTINCT FROM h.designation
        QUALIFY ROW_NUMBER() OVER (PARTITION BY t.asteroid_id, t.cand ORDER BY t.pos) = 1
        UNION ALL SELECT asteroid_id, -1, designation FROM hits WHERE designation IS NOT NULL
        UNION ALL SELECT asteroid_id, 9, spkid FROM hits h
        WHERE spkid IS DISTINCT FROM designation
          AND NOT EXISTS (SELECT 1 FROM tries t WHERE t.asteroid_id = h.asteroid_id AND t.cand = h.spkid)
    ),{OTHERS}{PROFILES.format(more="hits.answered_by,")}""")

sql("gap_fill_tries", "orbit_hits holds", f"""{HELD},
    orbit AS (SELECT h.* FROM orbit_hits h LEFT JOIN held USING (asteroid_id) WHERE held.s IS NOT TRUE),{LANDED}
    SELECT m.asteroid_id, CAST(m.try_no AS INTEGER) AS try_no, m.lookup_value, COALESCE(m.try_no = f.n, false) AS is_answer,
           m.http_status AS status_code,
           CASE WHEN m.http_status = 404 THEN 'not_found' WHEN m.http_status = 503 THEN 'server_error'
                WHEN NOT m.ok THEN 'invalid_json' END AS last_failure_type
    FROM met m LEFT JOIN first_answer f USING (asteroid_id) WHERE f.n IS NULL OR m.try_no <= f.n""")

sql("risk_name_lookup", "", """
    WITH known AS (
        SELECT CAST(s_suppkey AS VARCHAR) AS asteroid_id,
               CASE WHEN (s_nationkey % 11) % 2 = 0 THEN CAST(s_suppkey AS VARCHAR)
                    ELSE LOWER((1990 + s_suppkey % 30) || ' AB' || s_suppkey) END AS key
        FROM supplier)
    SELECT c_custkey AS query_id, COALESCE(w.asteroid_id, f.asteroid_id) AS asteroid_id
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN LOWER((1990 + c_custkey % 30) || ' AB' || c_custkey)
                                 ELSE c_custkey || ' somewhere' END AS whole,
                 CASE WHEN c_custkey % 2 = 1 THEN CAST(c_custkey AS VARCHAR) END AS front FROM customer) q
    LEFT JOIN known w ON w.key = q.whole LEFT JOIN known f ON f.key = q.front""")

sql("removed_names", "objects sentry", """
    SELECT o.asteroid_id FROM objects o JOIN sentry r ON r.asteroid_id = o.asteroid_id WHERE r.status = 'removed'""")

CASCADE = """
    , q AS (SELECT p_partkey AS query_id, CASE p_partkey % 8
            WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN (1990 + p_partkey % 30) || ' AB' || p_partkey
            WHEN 2 THEN CAST(20000000 + p_partkey AS VARCHAR)
            WHEN 3 THEN 'SUPPLIER#0000000' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0')
            WHEN 4 THEN UPPER(p_name || ' (1995') WHEN 5 THEN 'no such object ' || p_partkey
            WHEN 6 THEN substring(p_name, 1, 2) ELSE (p_partkey % 50) || '%' || substring(p_name, 2, 4) END AS query
        FROM part),
    asked AS (SELECT DISTINCT query FROM q),
    named AS (SELECT DISTINCT asteroid_id, name FROM approaches),
    hits AS (
        SELECT query, 1 AS level, asteroid_id FROM asked JOIN sbdb ON asteroid_id = query
        UNION ALL SELECT query, 2, asteroid_id FROM asked JOIN sbdb ON designation = query OR spkid = query
        UNION ALL SELECT query, 3, asteroid_id FROM asked JOIN sentry ON designation = query OR fullname ILIKE '%' || query || '%'
        UNION ALL SELECT query, 4, asteroid_id FROM asked JOIN named ON asteroid_id = query OR name ILIKE '%' || query || '%'),
    best AS (SELECT * FROM hits QUALIFY ROW_NUMBER() OVER (PARTITION BY query ORDER BY level, asteroid_id) = 1),
    answers AS (SELECT q.query_id, q.query, best.level, best.asteroid_id FROM q LEFT JOIN best ON best.query = q.query)"""

sql("identifier_cascade", "approaches sbdb sentry", CASCADE + " SELECT * FROM answers")

sql("cascade_outcomes", "approaches sbdb sentry", CASCADE + """,
    outside AS (
        SELECT 'X' || c_custkey AS des, CASE WHEN c_custkey % 2 = 0 THEN 'No Such OBJECT ' || c_custkey ELSE c_name END AS name,
               CASE WHEN c_custkey % 2 = 0 THEN 'no such object ' || c_custkey END AS k1,
               CASE WHEN c_custkey % 3 = 0 THEN 'no such object ' || (c_custkey + 1) END AS k2
        FROM customer),
    outside_keys AS (
        SELECT key, MIN(des) AS des FROM (SELECT k1 AS key, des FROM outside UNION ALL SELECT k2, des FROM outside
                                          UNION ALL SELECT LOWER(des), des FROM outside) GROUP BY key)
    SELECT a.query_id, a.level,
           CASE WHEN a.level IS NOT NULL THEN 'ingested' WHEN k.des IS NOT NULL THEN 'catalogue_only' ELSE 'pending' END AS outcome,
           k.des AS catalogue_designation, o.name AS catalogue_name
    FROM answers a LEFT JOIN outside_keys k ON k.key = LOWER(a.query) AND a.level IS NULL LEFT JOIN outside o ON o.des = k.des""")

sql("wildcard_names", "objects", r"""
    , asked AS (
        SELECT DISTINCT CASE p_partkey % 8
            WHEN 0 THEN repeat('_', p_size + 10) WHEN 1 THEN '%' || repeat('_%', p_size) WHEN 2 THEN '%%'
            WHEN 3 THEN '\%' || repeat('_', p_size % 3) WHEN 4 THEN 'A\_'
            WHEN 5 THEN substring(p_name, 1, 3) || '_' || substring(p_name, 5, 2)
            WHEN 6 THEN '100\%' || repeat('%', p_size % 2) ELSE substring(p_name, 1, 4) || '\\' END AS query
        FROM part),
    labels AS (
        SELECT asteroid_id, name || CASE WHEN CAST(asteroid_id AS BIGINT) % 5 = 0 THEN ' 100%'
                                         WHEN CAST(asteroid_id AS BIGINT) % 7 = 0 THEN ' a_b' ELSE '' END AS label FROM objects)
    SELECT query, MIN(asteroid_id) AS asteroid_id FROM asked JOIN labels ON label ILIKE '%' || query || '%' ESCAPE '\' GROUP BY query""")

SEARCH = """
    SELECT asteroid_id, name, is_potentially_hazardous, ROUND(estimated_diameter_km_max, 9) AS estimated_diameter_km_max,
           close_approach_date, 'local_db' AS source
    FROM ({latest}) WHERE name ILIKE '%{q}%' OR asteroid_id ILIKE '%{q}%' ORDER BY asteroid_id LIMIT 10"""

sql("object_search", "approaches", SEARCH.format(latest=LATEST, q="BOLT (199"))

sql("object_search_catalogue", "approaches sbdb", f"""
    , local_ AS ({SEARCH.format(latest=LATEST, q="20000013")})
    SELECT * FROM local_
    UNION ALL
    SELECT designation, fullname, is_pha, NULL, NULL, 'jpl_sbdb' FROM sbdb
    WHERE spkid = '20000013' AND (SELECT COUNT(*) FROM local_) < 5""")

# --- changes ------------------------------------------------------------------------------------------

sql("change_detection", "incoming", """
    SELECT close_approach_date, asteroid_id, orbiting_body, CASE WHEN src_line = 1 THEN 'INSERT' ELSE 'UPDATE' END AS change_type
    FROM incoming WHERE src_line IN (1, 2)""")

sql("upsert_current", "incoming", """
    SELECT close_approach_date, asteroid_id, CASE WHEN src_line = 2 THEN 'Moon' ELSE orbiting_body END AS orbiting_body FROM deduped
    UNION ALL SELECT close_approach_date, asteroid_id, orbiting_body FROM incoming WHERE src_line = 1""")

# --- ledgers and work lists -------------------------------------------------------------------------------

sql("classified_fetches", "statuses", """
    SELECT event_id, asteroid_id, source, status_code, last_failure_type,
           CASE WHEN status_code = 404 THEN checked_at + INTERVAL 30 DAY END AS not_found_until
    FROM statuses""")

sql("fetch_status_counts", "last_statuses", """
    SELECT source, status_code, COUNT(*) AS count FROM last_statuses GROUP BY 1, 2""")

sql("active_holds", "holds", " SELECT asteroid_id, source, not_found_until FROM holds")

sql("work_without_held", "holds", """
    SELECT DISTINCT f.asteroid_id, f.source FROM fetches f ANTI JOIN holds h USING (asteroid_id, source)""")

sql("never_profiled", "approaches sbdb", """
    SELECT DISTINCT a.asteroid_id FROM approaches a WHERE NOT EXISTS (SELECT 1 FROM sbdb s WHERE s.asteroid_id = a.asteroid_id)""")

sql("refresh_worklist", "objects sbdb", """
    SELECT w.asteroid_id, o.name, w.priority, w.last_seen FROM (
        SELECT asteroid_id, 0 AS priority, ingestion_date AS last_seen FROM sbdb
        WHERE ingestion_date < TIMESTAMP '2024-01-25' - INTERVAL 7 DAY
        UNION ALL
        SELECT asteroid_id, 1, NULL FROM objects o WHERE NOT EXISTS (SELECT 1 FROM sbdb s WHERE s.asteroid_id = o.asteroid_id)
        ORDER BY priority, last_seen NULLS LAST, asteroid_id LIMIT 1500) w
    LEFT JOIN objects o USING (asteroid_id)""")

sql("window_calendar", "calendar", " SELECT window_start, window_end FROM calendar")

sql("delta_windows", "", """
    SELECT s AS window_start, LEAST(s + 6, hi) AS window_end FROM (
        SELECT CAST(UNNEST(generate_series(d - 1, d + 14, INTERVAL 7 DAY)) AS DATE) AS s, d + 14 AS hi
        FROM (SELECT CAST(MAX(o_orderdate) AS DATE) AS d FROM orders))""")

sql("planned_windows", "planned", " SELECT window_start, window_end, status, CAST(attempt AS INTEGER) AS attempt FROM planned")

sql("pending_windows", "planned", " SELECT window_start, window_end FROM planned WHERE status = 'PENDING'")

sql("retryable_windows", "ledger", """
    SELECT window_start, 'PENDING' AS status, attempt + 1 AS attempt FROM ledger WHERE status = 'FAILED' AND attempt < 3""")

sql("window_outcomes", "ledger", """
    SELECT window_start, window_end,
           CASE any_key % 5 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'SUCCESS' WHEN 2 THEN 'SKIPPED'
                WHEN 3 THEN CASE WHEN attempt = 1 THEN 'PENDING' ELSE 'FAILED' END ELSE 'FAILED' END AS status,
           CASE WHEN any_key % 5 < 2 THEN records ELSE 0 END AS records,
           CASE WHEN any_key % 5 = 4 THEN 'broken pipe' WHEN any_key % 5 = 3 AND attempt > 1 THEN 'Rate limited on retry' END AS error,
           CASE WHEN any_key % 5 = 2 THEN '404; retry held until 1998-07-01' END AS reason,
           CAST(attempt AS INTEGER) AS attempt
    FROM ledger""")

sql("window_holds", "ledger", """
    SELECT window_start, window_end, 404 AS last_status_code, DATE '1998-07-01' AS until FROM ledger WHERE any_key % 5 = 2""")

sql("run_stats", "ledger", """
    SELECT COUNT(*) AS total_windows, COUNT(*) FILTER (WHERE status = 'SUCCESS') AS successful_windows,
           COUNT(*) FILTER (WHERE status = 'FAILED') AS failed_windows, COUNT(*) FILTER (WHERE status = 'SKIPPED') AS skipped_windows,
           COUNT(*) FILTER (WHERE status = 'PENDING') AS pending_windows,
           CAST(SUM(CASE WHEN status = 'SUCCESS' THEN records ELSE 0 END) AS BIGINT) AS total_records_sent,
           MIN(window_start) AS start_date, MAX_BY(window_end, window_start) AS end_date,
           COUNT(*) FILTER (WHERE attempt > 1) AS retried_windows
    FROM ledger""")

sql("latest_run_id", "", """
    SELECT MAX('run_' || strftime(o_orderdate, '%Y%m%d')) AS run_id FROM orders WHERE o_orderstatus = 'F'""")

# --- envelopes and streams ------------------------------------------------------------------------------------

# Rows per agency table: one orbit, risk and risk-list row per object whose
# source is not on hold, and every approach record and fireball.
PARTS = """
    , held AS (SELECT asteroid_id, bool_or(source = 'JPL_SBDB') AS s, bool_or(source = 'JPL_Sentry') AS r,
                      bool_or(source = 'JPL_CAD') AS c, bool_or(source = 'ESA_NEOCC') AS e FROM holds GROUP BY asteroid_id),
    near AS (
        SELECT DISTINCT o.asteroid_id, c.o_custkey, CAST(c.o_orderdate AS DATE) AS day, c.o_orderkey
        FROM objects o LEFT JOIN held USING (asteroid_id) JOIN orders c ON CAST(c.o_custkey AS VARCHAR) = o.asteroid_id
        WHERE held.c IS NOT TRUE),
    counts AS (
        SELECT 'sbdb' AS source, COUNT(*) AS count FROM orbit_hits LEFT JOIN held USING (asteroid_id) WHERE held.s IS NOT TRUE
        UNION ALL SELECT 'sentry', COUNT(*) FROM objects LEFT JOIN held USING (asteroid_id) WHERE held.r IS NOT TRUE
        UNION ALL SELECT 'cad', COUNT({cad}) FROM near
        UNION ALL SELECT 'esa', COUNT(*) FROM objects LEFT JOIN held USING (asteroid_id) WHERE held.e IS NOT TRUE
        UNION ALL SELECT 'fireball', COUNT(DISTINCT event_date) FROM fireball)
    SELECT source, count FROM counts"""

sql("envelope_route_counts", "orbit_hits holds fireball", PARTS.format(cad="*"))

sql("stream_agencies", "orbit_hits holds fireball", PARTS.format(cad="DISTINCT (asteroid_id, day)"))

sql("ingest_measured", "orbit_hits holds fireball", """
    SELECT source, count AS n_inserted, true AS agrees, true AS timed, CAST(0 AS BIGINT) AS n_rejected FROM ("""
    + PARTS.format(cad="DISTINCT (asteroid_id, day)").replace("    , held AS", "    WITH held AS", 1) + ")")

sql("envelope_risk_rows", "objects holds sentry", """
    , open_ AS (SELECT asteroid_id FROM objects ANTI JOIN (SELECT * FROM holds WHERE source = 'JPL_Sentry') USING (asteroid_id))
    SELECT COALESCE(r.status, 'not_found') AS status, COUNT(*) AS n_rows, COUNT(DISTINCT o.asteroid_id) AS n_designations
    FROM open_ o LEFT JOIN sentry r ON r.asteroid_id = o.asteroid_id AND r.status <> 'not_found' GROUP BY 1""")

ROUNDS = """
    SELECT close_approach_date, asteroid_id, name, CASE WHEN src_line = 2 THEN 'Moon' ELSE orbiting_body END AS orbiting_body,
           epoch_date_close_approach, miss_distance_km, src_line, false AS moved FROM deduped
    UNION ALL
    SELECT close_approach_date, 'N' || asteroid_id, name, orbiting_body, epoch_date_close_approach, miss_distance_km, src_line, true
    FROM deduped WHERE src_line = 1"""

for name in ("stream_upsert", "stream_small_batches", "stream_new_checkpoint"):
    sql(name, "deduped", f"""
    SELECT close_approach_date, asteroid_id, name, orbiting_body, epoch_date_close_approach,
           ROUND(miss_distance_km, 4) AS miss_distance_km FROM ({ROUNDS})""")

sql("stream_history", "deduped", f"""
    SELECT change_type, orbiting_body, COUNT(*) AS n_rows, COUNT(DISTINCT asteroid_id) AS n_objects FROM (
        SELECT 'INSERT' AS change_type, CASE WHEN moved THEN orbiting_body ELSE 'Earth' END AS orbiting_body, asteroid_id
        FROM ({ROUNDS})
        UNION ALL SELECT 'UPDATE', orbiting_body, asteroid_id FROM ({ROUNDS}) WHERE src_line = 2)
    GROUP BY 1, 2""")

sql("ingest_metrics", "", """
    WITH batches AS (
        SELECT MIN(event_id) AS batch_id, COUNT(*) AS n, ROUND(SUM(value), 2) AS s, 1000000 - MIN(event_id) AS lag
        FROM events GROUP BY date_trunc('hour', ts)),
    totals AS (
        SELECT CAST(SUM(n) AS BIGINT) AS n_messages, COUNT(*) AS n_batches, SUM(s) AS elapsed, MIN_BY(lag, batch_id) AS initial_lag,
               MAX_BY(lag, batch_id) AS current_lag, SUM(n) / SUM(s) AS throughput FROM batches)
    SELECT n_messages, n_batches, ROUND(elapsed, 4) AS elapsed_s, initial_lag, current_lag, ROUND(throughput, 4) AS throughput,
           ROUND((SELECT AVG(s) FROM (SELECT s FROM batches ORDER BY batch_id DESC LIMIT 50)), 4) AS avg_batch_s,
           ROUND(current_lag / throughput, 4) AS eta_s,
           ROUND((1 - current_lag / (initial_lag + n_messages)) * 100, 4) AS progress_pct
    FROM totals""")

# --- stored tables ------------------------------------------------------------------------------------------------

sql("stored_scan", "deduped", """
    SELECT close_approach_date, asteroid_id, name, ROUND(miss_distance_km, 4) AS miss_distance_km FROM deduped
    WHERE close_approach_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")

sql("status_ledger", "last_statuses", " SELECT asteroid_id, source, status_code, last_failure_type FROM last_statuses")

sql("window_ledger_table", "ledger", """
    SELECT CASE any_key % 5 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'SUCCESS' WHEN 2 THEN 'SKIPPED'
                WHEN 3 THEN CASE WHEN attempt = 1 THEN 'PENDING' ELSE 'FAILED' END ELSE 'FAILED' END AS status,
           CAST(attempt AS INTEGER) AS attempt, COUNT(*) AS n_windows,
           CAST(SUM(CASE WHEN any_key % 5 < 2 THEN records ELSE 0 END) AS BIGINT) AS n_records
    FROM ledger GROUP BY 1, 2""")

sql("stale_objects", "sbdb", """
    SELECT asteroid_id, ingestion_date AS last_seen FROM sbdb WHERE ingestion_date < DATE '2024-01-18'""")

sql("distinct_objects", "approaches", " SELECT DISTINCT asteroid_id FROM approaches")

sql("sql_views", "approaches sbdb sentry esa cad fireball", f"""
    , z AS (SELECT close_approach_date AS day, COALESCE(estimated_diameter_km_max, estimated_diameter_km_min) AS d,
                   relative_velocity_km_s AS v, miss_distance_km AS m FROM approaches),
    w AS (SELECT AVG(d) AS da, STDDEV_POP(d) AS ds, AVG(v) AS va, STDDEV_POP(v) AS vs, AVG(m) AS ma, STDDEV_POP(m) AS ms FROM z)
    SELECT 'days' AS what, COUNT(DISTINCT day) AS n,
           COUNT(*) FILTER (WHERE ABS((d - da) / ds) > 2 OR ABS((v - va) / vs) > 2 OR ABS((m - ma) / ms) > 2) AS total
    FROM z CROSS JOIN w
    UNION ALL
    SELECT 'profiles', COUNT(*), COUNT(e.on_risk_list) FROM ({LATEST}) n LEFT JOIN sbdb s USING (asteroid_id)
    LEFT JOIN esa e ON e.asteroid_id = n.asteroid_id OR LOWER(e.esa_designation) = LOWER(s.designation)
    UNION ALL
    SELECT 'watched', COUNT(*), COUNT(palermo_scale_cum) FROM sentry WHERE status = 'active'
    UNION ALL
    SELECT 'passages', COUNT(*), COUNT(*) FILTER (WHERE r.status = 'active') FROM cad c
    LEFT JOIN sentry r ON r.asteroid_id = c.asteroid_id LEFT JOIN sbdb s ON s.asteroid_id = c.asteroid_id
    LEFT JOIN esa e ON e.asteroid_id = c.asteroid_id OR LOWER(e.esa_designation) = LOWER(s.designation)
    UNION ALL
    SELECT 'classes', COUNT(*), CAST(SUM(n) AS BIGINT) FROM (
        SELECT COUNT(*) FILTER (WHERE is_pha) AS n FROM sbdb WHERE orbit_class IS NOT NULL
        GROUP BY orbit_class, CASE WHEN orbit_class = 'XXX' THEN COALESCE(NULLIF(orbit_class_name, ''), 'XXX') ELSE 'known' END)
    UNION ALL
    SELECT 'years', COUNT(DISTINCT YEAR(event_date)), COUNT(*) FROM fireball""")
