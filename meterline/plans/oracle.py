"""SQL twins of the views, as common table expressions for DuckDB."""

VIEWS = """WITH _r AS (
  SELECT *, l_orderkey * 7 + l_linenumber * 13 + l_partkey * 3 AS k FROM lineitem
), _d AS (
  SELECT *, l_quantity * (l_partkey % 10) / 20.0::DOUBLE
      * CASE WHEN k % 31 = 0 THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS trip_distance,
    l_shipdate + to_minutes(k % 1440) AS tpep_pickup_datetime
  FROM _r
), _f AS (
  SELECT *, CASE WHEN k % 29 = 0 THEN -5.0::DOUBLE
      ELSE (floor(trip_distance * 250) + floor(l_extendedprice) % 500 + 200) / 100.0::DOUBLE
        * CASE WHEN k % 23 = 0 THEN 9.0::DOUBLE ELSE 1.0::DOUBLE END END AS fare_amount
  FROM _d
), trips AS (
  SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
      round(l_extendedprice * 100)::BIGINT)) AS trip_id,
    1 + k % 2 AS VendorID,
    tpep_pickup_datetime,
    tpep_pickup_datetime + to_seconds(floor(trip_distance * 240)::BIGINT + (l_suppkey * 5) % 600
      - CASE WHEN k % 37 = 0 THEN 3600 ELSE 0 END) AS tpep_dropoff_datetime,
    CASE WHEN k % 19 = 0 THEN NULL ELSE (k % 8)::DOUBLE END AS passenger_count,
    trip_distance,
    1 + l_partkey % 265 AS PULocationID,
    1 + (l_suppkey * 31 + l_linenumber * 17) % 265 AS DOLocationID,
    1 + k % 4 AS payment_type,
    fare_amount,
    fare_amount * l_discount AS tip_amount,
    CASE WHEN k % 11 = 0 THEN 6.5::DOUBLE ELSE 0.0::DOUBLE END AS tolls_amount,
    fare_amount + fare_amount * l_discount
      + CASE WHEN k % 11 = 0 THEN 6.5::DOUBLE ELSE 0.0::DOUBLE END AS total_amount
  FROM _f
), timed AS (
  SELECT *, hour(tpep_pickup_datetime)::INT AS pickup_hour,
    day(tpep_pickup_datetime)::INT AS pickup_day,
    (isodow(tpep_pickup_datetime) - 1)::INT AS pickup_dayofweek,
    month(tpep_pickup_datetime)::INT AS pickup_month,
    year(tpep_pickup_datetime)::INT AS pickup_year,
    date_diff('microsecond', tpep_pickup_datetime, tpep_dropoff_datetime) / 60000000.0::DOUBLE
      AS trip_duration_minutes
  FROM trips
), clean AS (
  SELECT * FROM timed
  WHERE passenger_count IS NOT NULL AND fare_amount BETWEEN 2.5 AND 500
    AND trip_distance BETWEEN 0.1 AND 100 AND passenger_count BETWEEN 1 AND 6
    AND total_amount BETWEEN 2.5 AND 1000
), _s AS (
  SELECT *, trip_distance / (trip_duration_minutes / 60.0::DOUBLE) AS avg_speed_mph
  FROM clean WHERE trip_duration_minutes BETWEEN 1 AND 180
), scored AS (
  SELECT *, CASE WHEN pickup_dayofweek >= 5 THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN b < 70 THEN 'train' WHEN b < 80 THEN 'val' ELSE 'test' END AS split,
    3.0 + 2.6 * trip_distance AS predicted, 4.0 + 2.4 * trip_distance AS predicted_b
  FROM (SELECT *, ('0x' || substr(trip_id, 1, 8))::BIGINT % 100 AS b FROM _s
    WHERE avg_speed_mph BETWEEN 1 AND 60)
), train AS (SELECT * FROM scored WHERE split = 'train'
), test AS (SELECT * FROM scored WHERE split = 'test'
), _i AS (
  SELECT * REPLACE (coalesce(passenger_count, 1.0::DOUBLE) AS passenger_count) FROM timed
  WHERE fare_amount BETWEEN 2.5 AND 500 AND trip_distance BETWEEN 0.1 AND 100
    AND coalesce(passenger_count, 1.0) BETWEEN 1 AND 6 AND total_amount BETWEEN 2.5 AND 1000
    AND trip_duration_minutes BETWEEN 1 AND 180
), imputed AS (
  SELECT * FROM (
    SELECT *, trip_distance / (trip_duration_minutes / 60.0::DOUBLE) AS avg_speed_mph FROM _i)
  WHERE avg_speed_mph BETWEEN 1 AND 70
), log AS (
  SELECT event_id, ts, value / 10.0::DOUBLE AS trip_distance,
    (props->>'$.k')::BIGINT % 6 + 1 AS passenger_count,
    user_id % 265 + 1 AS PULocationID, event_id % 265 + 1 AS DOLocationID,
    hour(ts)::INT AS pickup_hour, (isodow(ts) - 1)::INT AS pickup_dayofweek,
    month(ts)::INT AS pickup_month,
    3.0 + 2.6 * (value / 10.0::DOUBLE) AS prediction
  FROM events
), zones AS (
  SELECT n_nationkey::BIGINT AS LocationID, r_name AS Borough, n_name AS Zone
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 24
), routes AS (
  SELECT PULocationID, DOLocationID, avg(trip_distance) AS avg_distance, count(*) AS trips
  FROM train GROUP BY ALL
)
"""


def sql(body: str) -> str:
    return VIEWS + body
