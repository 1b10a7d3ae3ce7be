"""The driver tables read as a station network: suppliers are stations, ship dates are days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The same two views for the SQL side.
STATIONS_SQL = """
stations as (
  select s_suppkey as station,
         14 + cast((s_suppkey * 37) % 1900 as double) / 100 as latitude,
         -117 + cast((s_suppkey * 53) % 3100 as double) / 100 as longitude,
         abs(s_acctbal) / 4 as altitude
  from supplier)"""

RAW_SQL = """
raw as (
  select l.l_suppkey as station, cast(l.l_shipdate as date) as date,
         s.latitude, s.longitude, s.altitude,
         case when l.l_returnflag = 'R' then null else l.l_quantity end as prec,
         l.l_extendedprice / 1999 as prectotcorr
  from lineitem l join stations s on s.station = l.l_suppkey)"""

OBS_SQL = """
obs as (
  select station, date, max(latitude) as latitude, max(longitude) as longitude, max(altitude) as altitude,
         sum(prec) as prec, avg(prectotcorr) as prectotcorr
  from raw group by station, date)"""

NETWORK_SQL = f"with {STATIONS_SQL}, {RAW_SQL}, {OBS_SQL}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("station"),
        (14 + F.pmod(key * 37, F.lit(1900)).cast("double") / 100).alias("latitude"),
        (-117 + F.pmod(key * 53, F.lit(3100)).cast("double") / 100).alias("longitude"),
        (F.abs("s_acctbal") / 4).alias("altitude"),
    )


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows per station and day; a third of the rows lack the target."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("station"),
        F.to_date("l_shipdate").alias("date"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("prec"),
        (F.col("l_extendedprice") / 1999).alias("prectotcorr"),
    )
    return rows.join(stations(spark, sf_dir), "station").select(
        "station", "date", "latitude", "longitude", "altitude", "prec", "prectotcorr"
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per station and day, with gaps and missing targets."""
    coords = [F.max(c).alias(c) for c in ("latitude", "longitude", "altitude")]
    return (
        raw_rows(spark, sf_dir)
        .groupBy("station", "date")
        .agg(*coords, F.sum("prec").alias("prec"), F.avg("prectotcorr").alias("prectotcorr"))
    )
