"""Calendar and standings: parsing, time lookups and picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import dates
from lectern.functions import text as tx

SESSION = "struct<date: string, time: string>"
RACE = (
    "struct<season: string, round: string, raceName: string, "
    "Circuit: struct<circuitName: string, Location: struct<country: string>>, date: string, time: string, "
    + ", ".join(f"{field}: {SESSION}" for field, _ in vocab.SESSION_FIELDS)
    + ">"
)
CALENDAR = f"struct<MRData: struct<RaceTable: struct<Races: array<{RACE}>>>>"
DRIVER_STANDING = (
    "struct<position: string, points: string, Driver: struct<givenName: string, familyName: string>, "
    "Constructors: array<struct<name: string>>>"
)
TEAM_STANDING = "struct<position: string, points: string, Constructor: struct<name: string>>"
STANDINGS = (
    "struct<MRData: struct<StandingsTable: struct<StandingsLists: array<struct<"
    f"DriverStandings: array<{DRIVER_STANDING}>, ConstructorStandings: array<{TEAM_STANDING}>>>>>>"
)


def event_sessions(race: Column) -> Column:
    """Sessions present in a calendar entry and its main session, by start time."""
    start = F.transform(
        F.array(*[F.struct(F.lit(label).alias("name"), race[field].alias("at")) for field, label in vocab.SESSION_FIELDS]),
        lambda s: F.struct(s["name"].alias("name"), dates.combine_date_time(s["at"]["date"], s["at"]["time"]).alias("start_time")),
    )
    main = F.struct(
        F.lit(vocab.MAIN_SESSION).alias("name"), dates.combine_date_time(race["date"], race["time"]).alias("start_time")
    )
    present = F.filter(start, lambda s: s["start_time"].isNotNull())
    # Sessions that start together keep the order of the labels, the main session last.
    numbered = F.transform(
        F.concat(present, F.array(main)),
        lambda s, i: F.struct(s["start_time"].alias("start_time"), i.alias("i"), s["name"].alias("name")),
    )
    return F.transform(
        F.array_sort(numbered), lambda s: F.struct(s["name"].alias("name"), s["start_time"].alias("start_time"))
    )


def parse_calendar(rows: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """Events of calendar documents held in a JSON column."""
    parsed = rows.select(*keep, F.from_json(column, CALENDAR).alias("_doc"))
    races = parsed.select(*keep, F.explode("_doc.MRData.RaceTable.Races").alias("_race"))
    race = F.col("_race")
    return races.withColumn("sessions", event_sessions(race)).select(
        *keep,
        race["season"].try_cast("int").alias("season"),
        race["round"].try_cast("int").alias("round_number"),
        race["raceName"].alias("grand_prix_name"),
        race["Circuit"]["circuitName"].alias("circuit_name"),
        race["Circuit"]["Location"]["country"].alias("country"),
        F.get("sessions", 0)["start_time"].alias("start_date"),
        dates.combine_date_time(race["date"], race["time"]).alias("end_date"),
        "sessions",
    )


def whole_points(points: Column) -> Column:
    """Half points are cut off."""
    return points.try_cast("double").try_cast("int")


def driver_standing(item: Column) -> Column:
    return F.struct(
        item["position"].try_cast("int").alias("position"),
        F.concat_ws(" ", item["Driver"]["givenName"], item["Driver"]["familyName"]).alias("driver_name"),
        F.coalesce(F.get(item["Constructors"], 0)["name"], F.lit(vocab.UNKNOWN_TEAM)).alias("team_name"),
        whole_points(item["points"]).alias("points"),
    )


def team_standing(item: Column) -> Column:
    return F.struct(
        item["position"].try_cast("int").alias("position"),
        item["Constructor"]["name"].alias("team_name"),
        whole_points(item["points"]).alias("points"),
    )


def parse_standings(rows: DataFrame, column: str, kind: str = "driver", keep: Sequence[str] = ()) -> DataFrame:
    """Standings of the first list of each document; ``kind`` is ``driver`` or ``constructor``."""
    first = F.get(F.from_json(column, STANDINGS)["MRData"]["StandingsTable"]["StandingsLists"], 0)
    field, shape = ("DriverStandings", driver_standing) if kind == "driver" else ("ConstructorStandings", team_standing)
    items = rows.select(*keep, first.alias("_list")).select(*keep, F.explode(f"_list.{field}").alias("_item"))
    return items.select(*keep, shape(F.col("_item")).alias("_s")).select(*keep, "_s.*")


def next_events(events: DataFrame, now: Column, keys: Sequence[str] = (), columns: Sequence[str] = ("event_id",)) -> DataFrame:
    """Per key, the event that starts first among those not over; one partial minimum per task and key."""
    row = F.struct("start_date", "event_id", *[c for c in columns if c != "event_id"])
    chosen = events.filter(F.col("end_date") >= now).groupBy(*keys).agg(F.min(row).alias("_e"))
    return chosen.filter(F.col("_e").isNotNull()).select(*keys, "_e.*")


def previous_events(events: DataFrame, now: Column, keys: Sequence[str] = (), columns: Sequence[str] = ("event_id",)) -> DataFrame:
    """Per key, the event that ended last; the lower id on ties."""
    order = F.struct(F.col("end_date"), -F.col("event_id"))
    row = F.struct("end_date", "event_id", *[c for c in columns if c != "event_id"])
    chosen = events.filter(F.col("end_date") < now).groupBy(*keys).agg(F.max_by(row, order).alias("_e"))
    return chosen.filter(F.col("_e").isNotNull()).select(*keys, "_e.*")


def pick_position(standings: Column, position: Column) -> Column:
    """Entry of a standings array with the position, else the entry at that place."""
    return tx.let(
        position,
        lambda p: F.coalesce(
            F.get(F.filter(standings, lambda e: e["position"] == p), 0),
            F.when(p > 0, F.get(standings, (p - 1).cast("int"))),
        ),
    )


def match_entry(message: Column | str, standings: Column, name: str, aliases: Sequence[tuple[str, str]]) -> Column:
    """First entry of a standings array that the message names, by name or alias.

    Earlier lines are part of the message, so they need no pass of their own.
    """
    table = (
        F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(n.lower()).alias("name")) for a, n in aliases])
        if aliases
        else F.array().cast("array<struct<alias: string, name: string>>")
    )

    def found(text: Column) -> Column:
        used = F.filter(table, lambda a: F.contains(text, a["alias"]))
        return tx.let(
            used,
            lambda u: F.get(
                F.filter(
                    standings,
                    lambda e: F.contains(text, F.lower(e[name]))
                    | F.exists(u, lambda a: F.contains(F.lower(e[name]), a["name"])),
                ),
                0,
            ),
        )

    return tx.let(F.lower(tx.col(message)), found)


def chinese_number(value: Column | str) -> Column:
    """One to ninety-nine in Chinese numerals; null when unreadable."""
    text = tx.col(value)
    digits = F.create_map(*[F.lit(x) for pair in vocab.CHINESE_DIGITS.items() for x in pair])

    def digit(part: Column) -> Column:
        return F.try_element_at(digits, part)

    before, after = F.substring_index(text, "十", 1), F.regexp_replace(text, "^[^十]*十", "")
    tens = F.when(before == "", F.lit(1)).otherwise(digit(before))
    return F.coalesce(
        digit(text), F.when(F.contains(text, F.lit("十")), tens * 10 + F.coalesce(digit(after), F.lit(0)))
    )


def requested_position(message: Column | str) -> Column:
    """Position asked for: a known word, else a numeral, else the first."""
    text, lowered = tx.col(message), F.lower(tx.col(message))
    table = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(p).alias("position")) for w, p in vocab.POSITION_WORDS])
    known = tx.let(lowered, lambda t: F.get(F.filter(table, lambda w: F.contains(t, w["word"])), 0)["position"])
    return F.coalesce(
        known,
        F.regexp_extract(text, vocab.POSITION_PATTERN, 1).try_cast("int"),
        F.regexp_extract(lowered, vocab.POSITION_ENGLISH_PATTERN, 1).try_cast("int"),
        F.lit(1),
    )


def requested_top(message: Column | str) -> Column:
    """Number of entries asked for, at least one; null when the message names none."""
    digits = F.regexp_extract(F.lower(tx.col(message)), vocab.TOP_N_PATTERN, 1).try_cast("int")
    numeral = F.regexp_extract(tx.col(message), vocab.TOP_N_CHINESE_PATTERN, 1)
    return F.coalesce(F.greatest(digits, F.when(digits.isNotNull(), F.lit(1))), chinese_number(numeral))


def _mentions(message: Column | str, *lists: Sequence[str]) -> Column:
    lowered = F.lower(tx.col(message))
    found = F.lit(True)
    for words in lists:
        found = found & tx.contains_any(lowered, words)
    return found


def wants_full_standings(message: Column | str) -> Column:
    return _mentions(message, vocab.STANDINGS_WORDS, vocab.FULL_LIST_WORDS)


def wants_full_schedule(message: Column | str) -> Column:
    return _mentions(message, vocab.SCHEDULE_WORDS, [*vocab.FULL_LIST_WORDS, *vocab.FULL_SEASON_WORDS])


def wants_session_times(message: Column | str) -> Column:
    return _mentions(message, vocab.SESSION_TIME_WORDS)
