"""Calendar and standings used when the live documents cannot be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The seed season, its events with their sessions in UTC, and its standings.
SEASONS = ["2026", "current"]
SEED = "local_seed"
EVENTS = [
    (2026, 9, "British Grand Prix", "Silverstone Circuit", "United Kingdom", [
        ("Practice 1", "2026-07-03T11:30:00Z"), ("Practice 2", "2026-07-03T15:00:00Z"),
        ("Practice 3", "2026-07-04T10:30:00Z"), ("Qualifying", "2026-07-04T14:00:00Z"), ("Race", "2026-07-05T14:00:00Z"),
    ]),
    (2026, 10, "Belgian Grand Prix", "Spa-Francorchamps", "Belgium", [
        ("Practice 1", "2026-07-17T11:30:00Z"), ("Practice 2", "2026-07-17T15:00:00Z"),
        ("Practice 3", "2026-07-18T10:30:00Z"), ("Qualifying", "2026-07-18T14:00:00Z"), ("Race", "2026-07-19T14:00:00Z"),
    ]),
]
DRIVERS = [
    (1, "Andrea Kimi Antonelli", "Mercedes", 171),
    (2, "George Russell", "Mercedes", 131),
    (3, "Charles Leclerc", "Ferrari", 112),
]
TEAMS = [(1, "Mercedes", 302), (2, "Ferrari", 204), (3, "McLaren", 159)]


def _seasonal(df: DataFrame, season: int | str) -> DataFrame:
    return df.withColumn("source", F.lit(SEED)) if str(season) in SEASONS else df.withColumn("source", F.lit(SEED)).limit(0)


def seed_calendar(spark: SparkSession, season: int | str) -> DataFrame:
    raw = spark.createDataFrame(
        EVENTS,
        "season int, round_number int, grand_prix_name string, circuit_name string, country string, "
        "_s array<struct<name: string, at: string>>",
    )
    sessions = F.transform("_s", lambda s: F.struct(s["name"].alias("name"), F.to_timestamp(s["at"]).alias("start_time")))
    timed = raw.withColumn("sessions", sessions)
    return _seasonal(
        timed.select(
            "season", "round_number", "grand_prix_name", "circuit_name", "country",
            F.get("sessions", 0)["start_time"].alias("start_date"),
            F.element_at("sessions", -1)["start_time"].alias("end_date"),
            "sessions",
        ),
        season,
    )


def seed_drivers(spark: SparkSession, season: int | str) -> DataFrame:
    return _seasonal(spark.createDataFrame(DRIVERS, "position int, driver_name string, team_name string, points int"), season)


def seed_teams(spark: SparkSession, season: int | str) -> DataFrame:
    return _seasonal(spark.createDataFrame(TEAMS, "position int, team_name string, points int"), season)
