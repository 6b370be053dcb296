"""The registered queries once more, as plain SQL over the same parquet tables.

Written straight from the definitions (distinct counts, outer joins, self joins), not from the
Spark plans, so that the two can be compared.
"""

from __future__ import annotations

SOURCES = """
line AS MATERIALIZED (
  SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS day_,
         year(l_shipdate) * 100 + month(l_shipdate) AS ym
  FROM lineitem
),
place AS (
  SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
),
specs AS (
  SELECT l_suppkey, ym, string_agg(spec, ' ' ORDER BY spec) AS event_specs
  FROM (SELECT DISTINCT l_suppkey, ym, lower(p_type) AS spec
        FROM line JOIN part ON l_partkey = p_partkey)
  GROUP BY l_suppkey, ym
),
months AS (
  SELECT l_suppkey, ym, min(day_) AS start_date, max(day_) AS end_date FROM line GROUP BY l_suppkey, ym
),
competitions AS MATERIALIZED (
  SELECT l_suppkey || '-' || ym AS id,
         CASE WHEN l_suppkey % 5 = 0 THEN s_name || ' Edition ' || ym
              WHEN l_suppkey % 5 IN (1, 2) THEN s_name || ' ' || year(start_date)
              ELSE s_name || ' ' || month(start_date) || ' ' || year(start_date) END AS name,
         n_name || ' ' || (l_suppkey % 10) AS cell_name,
         n_name AS city_name, r_name AS country_id,
         CAST(year(start_date) AS INTEGER) AS year, CAST(month(start_date) AS INTEGER) AS month,
         CAST(day(start_date) AS INTEGER) AS day, start_date, end_date,
         CASE WHEN (l_suppkey * 31 + ym) % 17 = 0 THEN 1 ELSE 0 END AS cancelled,
         CASE WHEN l_suppkey % 11 <> 0 THEN
           CAST(49000000 + (s_nationkey % 5) * 1200000 + (l_suppkey % 3) * 50000 AS BIGINT)
         END AS latitude_microdegrees,
         CASE WHEN l_suppkey % 11 <> 0 THEN
           CAST(14000000 + CASE s_nationkey // 5 WHEN 0 THEN 0 WHEN 1 THEN 900000
                ELSE 2000000 * (s_nationkey // 5) END + (l_suppkey % 4) * 150000 AS BIGINT)
         END AS longitude_microdegrees,
         CASE WHEN l_suppkey % 13 <> 0 THEN event_specs END AS event_specs
  FROM months JOIN supplier ON l_suppkey = s_suppkey JOIN place ON s_nationkey = n_nationkey
       LEFT JOIN specs USING (l_suppkey, ym)
),
results AS MATERIALIZED (
  SELECT l_suppkey || '-' || ym AS competition_id,
         'P' || o_custkey || '-' || (l_partkey % 8) AS person_id, r_name AS person_country_id
  FROM line JOIN orders ON l_orderkey = o_orderkey
       LEFT JOIN (SELECT c_custkey, r_name FROM customer JOIN place ON c_nationkey = n_nationkey)
       ON o_custkey = c_custkey
),
persons AS MATERIALIZED (
  SELECT DISTINCT 'P' || o_custkey || '-' || (l_partkey % 8) AS person_id, sub_id,
         CASE sub_id WHEN 1 THEN c_name ELSE 'old' END AS name, r_name AS country_id
  FROM line JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN place ON c_nationkey = n_nationkey JOIN (VALUES (1), (2)) AS v(sub_id)
       ON sub_id = 1 OR o_custkey % 10 = 0
)"""

ATTENDANCE = """
all_comps AS (SELECT *, id AS competition_id, make_date(year, month, day) AS date FROM competitions),
home AS MATERIALIZED (
  SELECT *, CAST((month - 1) // 3 + 1 AS INTEGER) AS quarter
  FROM all_comps WHERE country_id = 'AMERICA' AND cancelled = 0
),
first_comp AS MATERIALIZED (
  SELECT person_id, min(date) AS first_comp_date
  FROM (SELECT DISTINCT competition_id, person_id FROM results) JOIN all_comps USING (competition_id)
  GROUP BY person_id
),
every_att AS MATERIALIZED (
  SELECT r.competition_id, r.person_id, h.date, h.year, h.month, h.quarter, h.city_name,
         h.latitude_microdegrees, h.longitude_microdegrees, f.first_comp_date,
         h.date = f.first_comp_date AS is_newcomer
  FROM (SELECT DISTINCT competition_id, person_id FROM results) r
       JOIN home h USING (competition_id) JOIN first_comp f USING (person_id)
)"""

DEBUTS = """
debuts AS MATERIALIZED (
  SELECT person_id, date AS debut_date, year AS debut_year, month AS debut_month,
         quarter AS debut_quarter
  FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY date, competition_id) AS rn
        FROM att WHERE is_newcomer) WHERE rn = 1
),
followup AS MATERIALIZED (
  SELECT a.person_id, a.competition_id, a.date, d.debut_date, d.debut_year, d.debut_month,
         d.debut_quarter, CAST(a.date - d.debut_date AS INTEGER) AS days_after
  FROM att a JOIN debuts d USING (person_id)
)"""

STARTS = """
starts AS MATERIALIZED (
  SELECT person_id, year, count(DISTINCT competition_id) AS n_comps FROM att GROUP BY person_id, year
)"""

RETURNS = """
returns_of AS MATERIALIZED (
  SELECT person_id, count(DISTINCT CASE WHEN days_after > 0 THEN competition_id END) AS returns
  FROM followup GROUP BY person_id
)"""

SERIES = """
named AS MATERIALIZED (
  SELECT c.competition_id, c.year, c.month,
         regexp_replace(trim(regexp_replace(c.name, '\\b\\d{4}\\b', '', 'g')), '\\s+', ' ', 'g') AS series,
         coalesce(a.n, 0) AS n_competitors
  FROM comps c LEFT JOIN
       (SELECT competition_id, count(DISTINCT person_id) AS n FROM att GROUP BY competition_id) a
       USING (competition_id)
),
rec AS MATERIALIZED (
  SELECT * FROM named WHERE series IN
    (SELECT series FROM named GROUP BY series HAVING count(DISTINCT year) >= 3)
),
cells AS MATERIALIZED (
  SELECT s.series, y.year, CAST(coalesce(sum(r.n_competitors), 0) AS BIGINT) AS n_competitors
  FROM (SELECT DISTINCT series FROM rec) s CROSS JOIN (SELECT DISTINCT year FROM rec) y
       LEFT JOIN rec r ON r.series = s.series AND r.year = y.year
  GROUP BY s.series, y.year
),
ranked AS MATERIALIZED (
  SELECT series, editions, total, label,
         CAST(row_number() OVER (ORDER BY editions DESC, total DESC, series) AS INTEGER) AS rank
  FROM (SELECT series, count(*) FILTER (n_competitors > 0) AS editions,
               CAST(sum(n_competitors) AS BIGINT) AS total FROM cells GROUP BY series)
       JOIN (SELECT series, series || ' (' ||
               ['Sty', 'Lut', 'Mar', 'Kwi', 'Maj', 'Cze', 'Lip', 'Sie', 'Wrz', 'Paź', 'Lis', 'Gru']
               [CAST(round_even(median(month), 0) AS INTEGER)] || ')' AS label
             FROM rec GROUP BY series) USING (series)
)"""

STATS = """
stats AS MATERIALIZED (
  SELECT competition_id, total, newcomers, newcomers / total * 100 AS pct_newcomers,
         name, city_name, year, month, latitude_microdegrees, longitude_microdegrees, event_specs
  FROM (SELECT competition_id, count(DISTINCT person_id) AS total,
               count(*) FILTER (is_newcomer) AS newcomers FROM att GROUP BY competition_id)
       JOIN comps USING (competition_id)
)"""


def _km(a: str, b: str) -> str:
    return (
        f"2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) "
        f"+ cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
    )


MAP = """
ev AS MATERIALIZED (
  SELECT id AS competition_id, cell_name, city_name,
         latitude_microdegrees / 1e6 AS lat, longitude_microdegrees / 1e6 AS lon
  FROM competitions
  WHERE country_id = 'AMERICA' AND year = 1998 AND cancelled = 0
    AND latitude_microdegrees IS NOT NULL AND longitude_microdegrees IS NOT NULL
),
map_att AS MATERIALIZED (
  SELECT competition_id, person_id, cell_name, lat, lon, p.name, p.country_id
  FROM (SELECT DISTINCT competition_id, person_id FROM results)
       JOIN ev USING (competition_id) JOIN (SELECT * FROM persons WHERE sub_id = 1) p USING (person_id)
)"""

REGIONS = f"""
spots AS MATERIALIZED (SELECT DISTINCT lat, lon FROM ev),
near AS MATERIALIZED (
  SELECT a.lat AS a_lat, a.lon AS a_lon, b.lat AS b_lat, b.lon AS b_lon
  FROM spots a, spots b WHERE {_km("a.", "b.")} <= 50
),
reach(a_lat, a_lon, b_lat, b_lon) AS (
  SELECT lat, lon, lat, lon FROM spots
  UNION
  SELECT r.a_lat, r.a_lon, n.b_lat, n.b_lon
  FROM reach r JOIN near n ON r.b_lat = n.a_lat AND r.b_lon = n.a_lon
),
regions AS MATERIALIZED (
  SELECT e.competition_id, min(o.competition_id) AS region
  FROM ev e JOIN reach r ON e.lat = r.a_lat AND e.lon = r.a_lon
       JOIN ev o ON o.lat = r.b_lat AND o.lon = r.b_lon
  GROUP BY e.competition_id
)"""

SPREAD = f"""
own AS MATERIALIZED (
  SELECT person_id, name, competition_id, lat, lon, region
  FROM map_att JOIN regions USING (competition_id) WHERE country_id = 'AMERICA'
),
spread AS MATERIALIZED (
  SELECT person_id, any_value(name) AS name, count(*) AS n_starts,
         count(DISTINCT region) AS n_regions, any_value(km) AS spread_km,
         any_value(km) <= 250 AND count(DISTINCT region) <= 3 AS is_local
  FROM own JOIN (SELECT a.person_id, max({_km("a.", "b.")}) AS km
                 FROM own a JOIN own b USING (person_id) GROUP BY a.person_id) USING (person_id)
  GROUP BY person_id
)"""


def _with(body: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",".join((SOURCES, *parts)) + "\n" + body


def _model(body: str, *parts: str, years: int | None = None) -> str:
    kept = "" if years is None else f" WHERE year >= (SELECT max(year) FROM home) - {years - 1}"
    period = (
        f"\ncomps AS MATERIALIZED (SELECT * FROM home{kept})",
        "\natt AS MATERIALIZED (SELECT * FROM every_att"
        " WHERE competition_id IN (SELECT competition_id FROM comps))",
    )
    return _with(body, ATTENDANCE, *period, *parts)


LABEL = "year || ' Q' || quarter AS label"


def _per_month(table: str, year: str, month: str) -> str:
    return f"""
SELECT y.year, CAST(m.month AS INTEGER) AS month, count(t.y) AS n
FROM (SELECT DISTINCT {year} AS year FROM {table}) y CROSS JOIN range(1, 13) m(month)
     LEFT JOIN (SELECT {year} AS y, {month} AS m FROM {table}) t ON t.y = y.year AND t.m = m.month
GROUP BY y.year, m.month"""


def q01(years=None):
    return _model(f"SELECT year, quarter, {LABEL}, count(*) AS n FROM comps GROUP BY year, quarter", years=years)


def q02(years=None):
    return _model(_per_month("comps", "year", "month"), years=years)


def q03(years=None):
    return _model(
        "SELECT year, month, CAST(sum(n) OVER (PARTITION BY year ORDER BY month) AS BIGINT) AS n_ytd "
        f"FROM ({_per_month('comps', 'year', 'month')})",
        years=years,
    )


def q04(years=None):
    return _model(
        f"""SELECT year, quarter, {LABEL}, round(avg(n), 6) AS mean_n, round(median(n), 6) AS median_n
        FROM (SELECT competition_id, count(DISTINCT person_id) AS n FROM att GROUP BY competition_id)
             JOIN comps USING (competition_id) GROUP BY year, quarter""",
        years=years,
    )


def q05(years=None):
    return _model(
        f"SELECT year, quarter, {LABEL}, count(DISTINCT person_id) AS n FROM att GROUP BY year, quarter",
        years=years,
    )


NEW_RETURNING = """(
  SELECT year, quarter, coalesce(newcomers, 0) AS newcomers, coalesce(returning_, 0) AS returning_
  FROM (SELECT year, quarter, count(DISTINCT person_id) AS newcomers FROM att
        WHERE is_newcomer GROUP BY year, quarter)
  FULL OUTER JOIN
       (SELECT year, quarter, count(DISTINCT person_id) AS returning_ FROM att
        WHERE NOT is_newcomer GROUP BY year, quarter) USING (year, quarter))"""


def q06(years=None):
    return _model(
        f'SELECT year, quarter, {LABEL}, newcomers, returning_ AS "returning" FROM {NEW_RETURNING}',
        years=years,
    )


def q07(years=None):
    return _model(
        f"""SELECT year, quarter, {LABEL}, round(pct, 6) AS pct_new, round(avg(pct) OVER (), 6) AS avg_pct_new
        FROM (SELECT *, newcomers / (newcomers + returning_) * 100 AS pct FROM {NEW_RETURNING})""",
        years=years,
    )


def q08(years=None, cap=10**9):
    return _model(
        f"""SELECT y.year, b.bin AS n_comps, count(s.bin) AS n_persons, round(y.median_n, 6) AS median_n
        FROM (SELECT year, median(n_comps) AS median_n, least(max(n_comps), {cap}) AS top FROM starts GROUP BY year) y
             JOIN range(1, (SELECT max(n_comps) FROM starts) + 1) b(bin) ON b.bin <= y.top
             LEFT JOIN (SELECT year, least(n_comps, {cap}) AS bin FROM starts) s
             ON s.year = y.year AND s.bin = b.bin
        GROUP BY y.year, b.bin, y.median_n""",
        STARTS,
        years=years,
    )


def q09(years=None):
    return _model(
        """SELECT year, count(*) AS n FROM
        (SELECT person_id, year FROM att GROUP BY person_id, year HAVING count(DISTINCT quarter) >= 3)
        GROUP BY year""",
        years=years,
    )


def q10(years=None):
    return _model(
        """SELECT year, round(avg(n_comps), 6) AS mean_n, round(median(n_comps), 6) AS median_n,
        round(quantile_cont(n_comps, 0.75), 6) AS q75_n FROM starts GROUP BY year""",
        STARTS,
        years=years,
    )


def q11(years=None):
    return _model(
        f"SELECT year, quarter, {LABEL}, newcomers FROM (SELECT debut_year AS year, "
        "debut_quarter AS quarter, count(*) AS newcomers FROM debuts GROUP BY ALL)",
        DEBUTS,
        years=years,
    )


def q12(years=None):
    return _model(_per_month("debuts", "debut_year", "debut_month"), DEBUTS, years=years)


def q13(years=None):
    windows = {"3m": 90, "6m": 180, "12m": 365}
    counts = ", ".join(
        f"count(DISTINCT CASE WHEN days_after > 0 AND days_after <= {days} THEN person_id END) AS ret_{key}"
        for key, days in windows.items()
    )
    shown = ", ".join(
        f"ret_{key}, floor((2000 * ret_{key} + newcomers) // (2 * newcomers)) / 10.0 AS pct_{key}"
        for key in windows
    )
    last = "(SELECT max(date) FROM att)"
    flags = ", ".join(
        f"CAST(last_day(make_date(year, 3 * quarter, 1)) AS DATE) + {days} <= {last} AS complete_{key}"
        for key, days in windows.items()
    )
    return _model(
        f"""SELECT year, quarter, {LABEL}, newcomers, {shown}, {flags} FROM
        (SELECT debut_year AS year, debut_quarter AS quarter, count(DISTINCT person_id) AS newcomers, {counts}
         FROM followup GROUP BY debut_year, debut_quarter)""",
        DEBUTS,
        years=years,
    )


def q15(years=None, cap=10**9):
    return _model(
        f"""SELECT b.bin AS returns, count(r.bin) AS n_persons, n_never, n_total,
               round(n_never / n_total * 100, 6) AS pct_never
        FROM (SELECT count(*) FILTER (returns = 0) AS n_never, count(*) AS n_total,
                     least(max(returns), {cap}) AS top FROM returns_of) t
             JOIN range(0, (SELECT max(returns) FROM returns_of) + 1) b(bin) ON b.bin <= t.top
             LEFT JOIN (SELECT least(returns, {cap}) AS bin FROM returns_of) r ON r.bin = b.bin
        GROUP BY b.bin, n_never, n_total""",
        DEBUTS,
        RETURNS,
        years=years,
    )


def q16(years=None):
    return _model(
        """SELECT rank, series, label, year, n_competitors, editions, total,
               CASE WHEN n_competitors > 0 THEN CAST(n_competitors AS VARCHAR) ELSE '—' END AS cell_text,
               CASE WHEN n_competitors > 0.65 * max(n_competitors) OVER () THEN 'dark'
                    WHEN n_competitors > 0 THEN 'light' ELSE 'empty' END AS shade
        FROM ranked JOIN cells USING (series) WHERE rank <= 30""",
        SERIES,
        years=years,
    )


def q17(years=None):
    return _model(
        """SELECT rank, CASE WHEN length(label) > 38 THEN left(label, 35) || '...' ELSE label END AS label,
               year, n_competitors
        FROM ranked JOIN cells USING (series) WHERE rank <= 10 AND n_competitors > 0""",
        SERIES,
        years=years,
    )


def q18(years=None):
    return _model(
        """SELECT CAST(row_number() OVER (ORDER BY newcomers DESC, competition_id) AS INTEGER) AS rank,
               competition_id, name, year, newcomers
        FROM stats QUALIFY rank <= 20""",
        STATS,
        years=years,
    )


def q19(years=None):
    return _model(
        """SELECT CAST(row_number() OVER (ORDER BY pct_newcomers DESC, competition_id) AS INTEGER) AS rank,
               competition_id, name, year, total, round(pct_newcomers, 6) AS pct_newcomers
        FROM stats WHERE total >= 10 QUALIFY rank <= 20""",
        STATS,
        years=years,
    )


def q20(years=None):
    return _model(
        """SELECT city_name, total_newcomers, round(avg_newcomers, 6) AS avg_newcomers, n_comps,
               round(lat, 6) AS lat, round(lon, 6) AS lon,
               CAST(total_newcomers * 2.5 AS DOUBLE) AS bubble_size,
               row_number() OVER (ORDER BY total_newcomers DESC, city_name) <= 20 AS is_labelled
        FROM (SELECT city_name, CAST(sum(newcomers) AS BIGINT) AS total_newcomers,
                     avg(newcomers) AS avg_newcomers, count(DISTINCT competition_id) AS n_comps,
                     avg(latitude_microdegrees / 1e6) AS lat, avg(longitude_microdegrees / 1e6) AS lon
              FROM stats WHERE city_name IS NOT NULL GROUP BY city_name)""",
        STATS,
        years=years,
    )


def q21(years=None):
    return _model(
        """SELECT month, round(avg(newcomers), 6) AS avg_count, round(avg(pct_newcomers), 6) AS avg_pct
        FROM stats GROUP BY month""",
        STATS,
        years=years,
    )


def q22(years=None):
    names = {
        "333": "3x3x3", "222": "2x2x2", "444": "4x4x4", "555": "5x5x5", "666": "6x6x6",
        "777": "7x7x7", "333bf": "3x3 Blindfolded", "333oh": "3x3 One-Handed", "clock": "Clock",
        "minx": "Megaminx", "pyram": "Pyraminx", "skewb": "Skewb", "sq1": "Square-1",
        "444bf": "4x4 Blindfolded", "555bf": "5x5 Blindfolded", "333mbf": "Multi-Blind",
        "333ft": "3x3 With Feet",
    }
    whens = " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in names.items())
    return _model(
        f"""SELECT event_id, CASE event_id {whens} ELSE event_id END AS event_name,
               round(avg_pct, 6) AS avg_pct, n_comps, round(overall, 6) AS overall_avg,
               CASE WHEN round(avg_pct, 9) >= round(overall, 9) THEN 'above' ELSE 'below' END AS band
        FROM (SELECT event_id, avg(pct_newcomers) AS avg_pct, count(DISTINCT competition_id) AS n_comps
              FROM (SELECT competition_id, pct_newcomers, unnest(string_split(event_specs, ' ')) AS event_id
                    FROM stats WHERE event_specs IS NOT NULL)
              WHERE event_id <> '' GROUP BY event_id),
             (SELECT avg(pct_newcomers) AS overall FROM stats)""",
        STATS,
        years=years,
    )


def q23():
    return _with(
        """SELECT c.id AS competition_id, c.name AS competition_name, count(n.person_id) AS newcomers,
               count(*) FILTER (n.comps > 1) AS returned_newcomers
        FROM competitions c LEFT JOIN
             (SELECT DISTINCT r.competition_id, r.person_id, e.comps
              FROM results r JOIN competitions x ON r.competition_id = x.id
                   JOIN (SELECT person_id, min(start_date) AS first_date
                         FROM results JOIN competitions ON competition_id = id GROUP BY person_id) f
                   ON r.person_id = f.person_id AND x.start_date = f.first_date
                   JOIN (SELECT person_id, count(DISTINCT competition_id) AS comps
                         FROM results GROUP BY person_id) e ON e.person_id = r.person_id) n
             ON n.competition_id = c.id
        WHERE year(c.end_date) = 1998 AND c.country_id = 'AMERICA'
        GROUP BY c.id, c.name"""
    )


def _density(table: str) -> str:
    return f"""SELECT competition_id, cell_name, round(lat, 6) AS lat, round(lon, 6) AS lon,
       count(DISTINCT person_id) AS n, cell_name || ': ' || count(DISTINCT person_id) AS popup
FROM {table} WHERE cell_name IS NOT NULL GROUP BY competition_id, cell_name, map_att.lat, map_att.lon"""


def q24():
    return _with(_density("map_att"), MAP)


def q25():
    return _with("SELECT competition_id, region FROM regions", MAP, REGIONS)


def q26():
    return _with(
        "SELECT person_id, n_starts, n_regions, round(spread_km, 6) AS spread_km, is_local FROM spread",
        MAP, REGIONS, SPREAD,
    )


def q27():
    return _with(
        """SELECT CAST(row_number() OVER (ORDER BY spread_km DESC, person_id) AS INTEGER) AS rank, name,
               n_starts, n_regions, round(spread_km, 6) AS spread_km
        FROM (SELECT * REPLACE (round(spread_km, 6) AS spread_km) FROM spread) QUALIFY rank <= 10""",
        MAP, REGIONS, SPREAD,
    )


def q28():
    return _with(
        _density("map_att SEMI JOIN (SELECT person_id FROM spread WHERE is_local) USING (person_id)"),
        MAP, REGIONS, SPREAD,
    )


def q29():
    return _with(
        """SELECT CAST(row_number() OVER (ORDER BY n DESC, region) AS INTEGER) AS rank, region, n,
               round(lat, 6) AS lat, round(lon, 6) AS lon
        FROM (SELECT region, count(DISTINCT person_id) AS n FROM own
              WHERE person_id IN (SELECT person_id FROM spread WHERE is_local) GROUP BY region)
             JOIN (SELECT region, avg(lat) AS lat, avg(lon) AS lon FROM ev JOIN regions USING (competition_id)
                   GROUP BY region) USING (region)""",
        MAP, REGIONS, SPREAD,
    )


def q30():
    return _model(
        """SELECT period, yr_min, yr_max, n_comps, n_att, n_persons FROM (
          SELECT 'all' AS period, min(year) AS yr_min, max(year) AS yr_max, count(*) AS n_comps,
                 (SELECT count(*) FROM every_att) AS n_att,
                 (SELECT count(DISTINCT person_id) FROM every_att) AS n_persons FROM home
          UNION ALL
          SELECT 'last5y', min(year), max(year), count(*), (SELECT count(*) FROM att),
                 (SELECT count(DISTINCT person_id) FROM att) FROM comps)""",
        years=5,
    )


def q31():
    return _with(
        """SELECT (SELECT count(*) FROM ev) AS n_comps, (SELECT count(*) FROM map_att) AS n_starts,
               (SELECT count(DISTINCT person_id) FROM map_att) AS n_persons,
               (SELECT count(*) FROM spread) AS n_own,
               (SELECT count(*) FROM spread WHERE is_local) AS n_locals""",
        MAP, REGIONS, SPREAD,
    )


def table_series_matrix():
    columns = ", ".join(
        f'CAST(coalesce(sum(n_competitors) FILTER (year = {y}), 0) AS BIGINT) AS "{y}"' for y in range(1995, 2002)
    )
    return _model(
        f"SELECT label AS series, {columns} FROM ranked JOIN cells USING (series) GROUP BY series, label",
        SERIES,
    )


def persons_by_span():
    return _model(
        """SELECT kind, CAST(year AS INTEGER) AS year, CAST(quarter AS INTEGER) AS quarter, n_persons FROM (
          SELECT 'last 4 quarters' AS kind, e.k // 4 AS year, e.k % 4 + 1 AS quarter, count(DISTINCT person_id) AS n_persons
          FROM (SELECT unnest(range(min(year * 4 + quarter - 1), max(year * 4 + quarter - 1) + 1)) AS k FROM att) e
               JOIN att ON year * 4 + quarter - 1 BETWEEN e.k - 3 AND e.k GROUP BY e.k
          UNION ALL SELECT 'year', year, NULL, count(DISTINCT person_id) FROM att GROUP BY year
          UNION ALL SELECT 'to date', e.y, NULL, count(DISTINCT person_id)
          FROM (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM att) e JOIN att ON year <= e.y GROUP BY e.y)"""
    )


def quarantine_report():
    faults = {
        "competitions": {
            "missing id": "n % 59 = 0", "wrong day": "n % 43 = 0", "wrong cancelled": "n % 47 = 0",
            "wrong latitude_microdegrees": "n % 53 = 0", "no such date": "n % 41 = 0 AND n % 43 <> 0",
        },
        "results": {"missing person_id": "n % 61 = 0", "missing competition_id": "n % 67 = 0"},
        "persons": {"wrong sub_id": "n % 71 = 0", "missing person_id": "n % 73 = 0"},
    }
    numbered = {
        "competitions": "SELECT CAST(split_part(id, '-', 1) AS BIGINT) * 31 + CAST(split_part(id, '-', 2) AS BIGINT) AS n FROM competitions",
        "results": "SELECT CAST(split_part(substr(person_id, 2), '-', 1) AS BIGINT) AS n FROM results",
        "persons": "SELECT CAST(split_part(substr(person_id, 2), '-', 1) AS BIGINT) AS n FROM persons",
    }
    counts = []
    for table, reasons in faults.items():
        bad = " OR ".join(f"({where})" for where in reasons.values())
        for reason, where in {**reasons, "rejected": bad, "accepted": f"NOT ({bad})"}.items():
            counts.append(f"SELECT '{table}' AS \"table\", '{reason}' AS reason, count(*) AS n FROM ({numbered[table]}) WHERE {where}")
    return _with(f"SELECT * FROM ({' UNION ALL '.join(counts)}) WHERE n > 0")


def all_oracles() -> dict[str, str]:
    return {
        "q01_comps_per_quarter": q01(),
        "q02_comps_per_month": q02(),
        "q03_comps_ytd": q03(),
        "q04_attendance_stats": q04(),
        "q05_unique_competitors": q05(),
        "q06_new_vs_returning": q06(),
        "q07_newcomer_share": q07(),
        "q08_starts_histogram": q08(),
        "q09_consistently_active": q09(),
        "q10_activity_trend": q10(),
        "q11_debuts_per_quarter": q11(),
        "q12_debuts_per_month": q12(),
        "q13_cohort_retention": q13(),
        "q15_return_distribution": q15(),
        "q16_series_heatmap": q16(),
        "q17_series_trend": q17(),
        "q18_top_by_newcomers": q18(),
        "q19_top_by_share": q19(),
        "q20_city_bubbles": q20(),
        "q21_by_calendar_month": q21(),
        "q22_by_event": q22(),
        "q23_returning_newcomers": q23(),
        "q24_density_all": q24(),
        "q25_regions": q25(),
        "q26_person_spread": q26(),
        "q27_globetrotters": q27(),
        "q28_density_locals": q28(),
        "q29_region_summary": q29(),
        "q30_period_summary": q30(),
        "q31_map_summary": q31(),
        "q01_comps_per_quarter_last5": q01(5),
        "q02_comps_per_month_last1": q02(1),
        "q03_comps_ytd_last3": q03(3),
        "q04_attendance_stats_last5": q04(5),
        "q05_unique_competitors_last5": q05(5),
        "q06_new_vs_returning_last5": q06(5),
        "q07_newcomer_share_last3": q07(3),
        "q08_starts_histogram_last2": q08(2),
        "q09_consistently_active_last5": q09(5),
        "q10_activity_trend_last99": q10(99),
        "q11_debuts_per_quarter_last5": q11(5),
        "q12_debuts_per_month_last2": q12(2),
        "q13_cohort_retention_last5": q13(5),
        "q15_return_distribution_last5": q15(5),
        "q16_series_heatmap_last5": q16(5),
        "q16_series_heatmap_last2": q16(2),
        "q17_series_trend_last3": q17(3),
        "q18_top_by_newcomers_last5": q18(5),
        "q19_top_by_share_last5": q19(5),
        "q20_city_bubbles_last1": q20(1),
        "q21_by_calendar_month_last5": q21(5),
        "q22_by_event_last5": q22(5),
        "q08_starts_histogram_cap3": q08(cap=3),
        "q15_return_distribution_cap4": q15(cap=4),
        "q25_regions_fine_boxes": q25(),
        "q26_person_spread_fine_boxes": q26(),
        "table_competitions": _with("SELECT * FROM competitions"),
        "table_results": _with("SELECT * FROM results"),
        "table_persons": _with("SELECT * FROM persons"),
        "table_current_persons": _with(
            "SELECT person_id, name, country_id AS person_country FROM persons WHERE sub_id = 1"
        ),
        "table_first_dates": _model("SELECT * FROM first_comp"),
        "table_attendance": _model("SELECT * FROM att"),
        "table_attendance_last2": _model("SELECT * FROM att", years=2),
        "table_debuts": _model("SELECT * FROM debuts", DEBUTS),
        "table_followups": _model("SELECT * FROM followup", DEBUTS),
        "table_return_counts": _model("SELECT * FROM returns_of", DEBUTS, RETURNS),
        "table_competition_stats": _model(
            "SELECT * REPLACE (round(pct_newcomers, 6) AS pct_newcomers) FROM stats", STATS
        ),
        "table_series_by_year": _model(
            "SELECT series, label, year, n_competitors, editions, total FROM ranked JOIN cells USING (series)",
            SERIES,
        ),
        "table_series_matrix": table_series_matrix(),
        "ledger_attendance": _model("SELECT * EXCLUDE (first_comp_date) FROM every_att"),
        "ledger_first_dates": _model("SELECT * FROM first_comp"),
        "growing_regions": q25(),
        "stored_retention": q13(),
        "stored_return_distribution": q15(),
        "stored_followups": _model("SELECT * FROM followup", DEBUTS),
        "stored_starts_last2": q08(2),
        "persons_by_span": persons_by_span(),
        "quarantine_report": quarantine_report(),
    }
