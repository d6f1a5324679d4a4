"""Batch form of the day and entity reads: weather of a date, ranking, trajectory, search, exports."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.functions.calendar import date_features
from panelrisk.functions.scalars import split_label, threshold_class
from panelrisk.functions.text import SAINT, expand_abbreviation, fold_accents, search_form
from panelrisk.operators.features import day_before, history_at
from panelrisk.operators.ranks import percentile_rank
from panelrisk.session import spread

#: Entities of a cell that are joined as a block.
ENTITIES_PER_BLOCK = 1024
#: Lengths of the pieces by which names are found: a text is looked up by the longest that it has.
PIECES = (1, 2, 3, 6)


def measures_on(
    climate: DataFrame, factors: DataFrame, day: str, scenario: str, columns: Sequence[str], variant: str = "k"
) -> DataFrame:
    """Ordinary day of the reference season at the level of its year; the class is taken after scaling."""
    at = F.lit(day).cast("date")
    k = factors.filter((F.col("scenario") == scenario) & (F.col("year") == F.year(at)))
    k = k.select("cell", F.col(variant).alias("_k"))
    base = climate.filter(F.col("doy") == F.least(F.dayofyear(at), F.lit(366))).join(k, "cell", "left")
    level = F.coalesce("_k", F.lit(1.0))
    out = base.withColumns({c: F.col(c) * level for c in columns}).drop("_k")
    return out.withColumn("danger_class", threshold_class("fwi"))


def observed_on(measures: DataFrame, day: str, columns: Sequence[str]) -> DataFrame:
    """Measured weather of a date with the day before it; two days are read."""
    at = F.lit(day).cast("date")
    two = measures.filter(F.col("day").between(F.date_sub(at, 1), at))
    out = day_before(two, [c for c in ("fwi", "ffmc") if c in columns]).filter(F.col("day") == at)
    return out.withColumn("danger_class", threshold_class("fwi"))


def day_features(entities: DataFrame, weather: DataFrame, days: DataFrame, day: str) -> DataFrame:
    """Every entity of a day with its weather, calendar and strict-past history."""
    rows = entities.join(weather.drop("day", "doy"), "cell").withColumn("day", F.lit(day).cast("date"))
    return date_features(rows).join(history_at(days, entities, day), "entity")


def rank_day(features: DataFrame, score: Column) -> DataFrame:
    """Score every entity of a day and give its percentile rank."""
    return percentile_rank(features.withColumn("score", score), "score")


def trajectory(
    entities: DataFrame, climate: DataFrame, factors: DataFrame, doy: int, columns: Sequence[str], last_observed: int
) -> DataFrame:
    """One day of the year followed over the years, per entity, scenario and variant.

    The band (low, high) exists for projected years only; a missing band value reads the centre.
    """
    base = climate.filter(F.col("doy") == doy)
    band = F.array(
        F.struct(F.lit("centre").alias("variant"), F.col("k").alias("k")),
        F.struct(F.lit("low").alias("variant"), F.coalesce("k_low", "k").alias("k")),
        F.struct(F.lit("high").alias("variant"), F.coalesce("k_high", "k").alias("k")),
    )
    long = factors.select("cell", "year", "scenario", F.explode(band).alias("_v"))
    observed = F.col("year") <= last_observed
    long = long.filter(~observed | (F.col("_v.variant") == "centre"))
    scaled = [(F.col(c) * F.col("_v.k")).alias(c) for c in columns]
    rows = long.join(base, "cell").select("cell", "year", "scenario", F.col("_v.variant").alias("variant"), observed.alias("observed"), *scaled)
    values = [c for c in rows.columns if c != "cell"]
    # A cell's rows are one array for each block of its entities: a crowded cell is dealt over many tasks, and its
    # entities are moved before they grow.
    located = entities.select("entity", "cell")
    blocks = located.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(ENTITIES_PER_BLOCK)).cast("int").alias("_blocks"))
    packed = rows.groupBy("cell").agg(F.collect_list(F.struct(*values)).alias("_rows")).join(blocks, "cell")
    packed = packed.select("cell", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), "_rows")
    located = located.join(blocks, "cell").select("entity", "cell", F.pmod(F.xxhash64("entity"), F.col("_blocks")).cast("int").alias("_block"))
    out = spread(located, "cell", "_block").join(spread(packed, "cell", "_block"), ["cell", "_block"])
    out = out.select("entity", F.explode("_rows").alias("_r")).select("entity", *[F.col(f"_r.{c}").alias(c) for c in values])
    return out.withColumn("danger_class", threshold_class("fwi"))


def search(entities: DataFrame, text: str, limit: int = 12, code: str = "code", name: str = "name") -> DataFrame:
    """Entities whose code starts with the text, else whose folded name contains it; largest population first."""
    q = text.strip()
    if not q:
        return entities.limit(0)
    plain = q.lower()
    by_code = F.upper(F.col(code)).startswith(q.upper())
    # The abbreviation is expanded before spaces become hyphens. A prefix match is also a contained one.
    wanted = search_form(F.lit(expand_abbreviation(plain)))
    by_name = search_form(name).contains(wanted)
    rows = entities.withColumn("_code", by_code).withColumn("_name", by_name).filter("_code OR _name")
    any_code = rows.filter("_code").agg((F.count("*") > 0).alias("c"))
    hit = F.when(any_code.scalar(), F.col("_code")).otherwise(F.col("_name"))
    return rows.filter(hit).drop("_code", "_name").orderBy(F.desc("population"), F.asc("entity")).limit(limit)


def _prefixes(codes: Sequence[str]) -> Column:
    """The distinct prefixes of an entity's codes."""

    def of(code: str) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(code)), lambda n: F.substring(F.upper(code), F.lit(1), n))
        return F.when(F.length(code) > 0, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*map(of, codes))))


def _pieces(text: str, width: Column) -> Column:
    """The distinct runs of ``width`` characters of a text that has so many."""
    starts = F.sequence(F.lit(1), F.length(text) - width + 1)
    return F.when(F.length(text) >= width, F.array_distinct(F.transform(starts, lambda n: F.substring(F.col(text), n, width))))


def search_all(
    entities: DataFrame, searches: DataFrame, limit: int = 12, codes: Sequence[str] = ("postcode", "code"), name: str = "name"
) -> DataFrame:
    """(query_id, rank, entity, kind) of the first ``limit`` entities of every search text, all searches in one join.

    ``searches`` has (query_id, text), one row each. Entities with a code that starts with the text are found; only if
    there is none, those whose folded name contains it. The larger population comes first, among equal ones the name that
    begins with the text, then the smaller entity. Null and blank texts find nothing. Codes are looked up by their
    prefixes; names by the run of ``PIECES`` characters of the text that the fewest names have, and then compared.
    Equal texts are searched once, and of equal names and prefixes only the first ``limit`` entities are joined.
    """
    texts = searches.select("query_id", F.trim("text").alias("_text")).filter("_text <> ''")
    # The abbreviation is expanded before spaces become hyphens.
    plain = F.regexp_replace(fold_accents("_text"), SAINT.pattern, "saint$1")
    texts = texts.select("query_id", F.upper("_text").alias("_code"), F.replace(plain, F.lit(" "), F.lit("-")).alias("_wanted"))
    found = "entity", "population"
    largest = F.desc("population"), F.asc("entity")

    def first_of(rows: DataFrame, *keys: str) -> DataFrame:
        """Entities that share a prefix or a name are alike to every text: the first ``limit`` of them are enough."""
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*largest))
        return rows.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")

    prefixes = entities.select("entity", "population", F.explode(_prefixes(codes)).alias("_code"))
    by_code = first_of(prefixes, "_code").join(texts.select("_code").distinct(), "_code")
    by_code = by_code.select("_code", *found, F.lit("code").alias("kind"), F.lit(False).alias("_begins"))
    named = first_of(entities.select("entity", "population", search_form(name).alias("_name")).filter("_name IS NOT NULL"), "_name")
    names = named.select("_name").distinct()
    widths = F.explode(F.array(*map(F.lit, PIECES))).alias("_width")
    postings = names.select("*", widths).select("_name", F.explode(_pieces("_name", F.col("_width"))).alias("_piece"))
    common = postings.groupBy("_piece").agg(F.count("*").alias("_n"))
    longest = F.greatest(*[F.when(F.length("_wanted") >= w, F.lit(w)) for w in PIECES], F.lit(0))
    pieces = texts.select("_wanted").distinct().select("_wanted", F.explode(_pieces("_wanted", longest)).alias("_piece"))
    # A piece that no name has rules the text out: the left join finds it with a count of 0, and it joins no posting.
    counted = pieces.join(common, "_piece", "left").select("_wanted", "_piece", F.coalesce("_n", F.lit(0)).alias("_n"))
    rarest = counted.groupBy("_wanted").agg(F.min(F.struct("_n", "_piece"))["_piece"].alias("_piece"))
    matched = postings.join(rarest, "_piece").filter(F.contains("_name", "_wanted"))
    by_name = matched.select("_wanted", "_name", F.startswith("_name", "_wanted").alias("_begins")).join(named, "_name")
    by_name = by_name.select("_wanted", *found, F.lit("name").alias("kind"), "_begins")
    order = "kind", F.desc("population"), F.desc("_begins"), "entity"

    def ranked(rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= limit)

    # A query that is listed twice with one text finds the names once.
    coded = texts.select("query_id", "_code").join(ranked(by_code, "_code").drop("rank"), "_code").drop("_code")
    named = texts.select("query_id", "_wanted").distinct().join(ranked(by_name, "_wanted").drop("rank"), "_wanted").drop("_wanted")
    first = ranked(coded.unionByName(named), "query_id")
    best = F.min("kind").over(Window.partitionBy("query_id"))
    return first.withColumn("_best", best).filter("kind = _best").select("query_id", "rank", "entity", "kind")


def weather_export(measures: DataFrame, start: str, end: str, columns: Sequence[str]) -> DataFrame:
    """Measured weather of a period and of the day before it, in narrow types."""
    first = F.date_sub(F.lit(start).cast("date"), 1)
    rows = measures.filter(F.col("day").between(first, F.lit(end).cast("date")))
    return rows.select(F.col("cell").cast("smallint").alias("cell"), "day", *[F.col(c).cast("float").alias(c) for c in columns])


def model_allowed(year: int, bounds: tuple[int, int, int], model: str = "v3") -> str:
    """Period of a year; a model built on event history may only be shown on the test period.

    ``bounds`` is (first train year, last train year, last validation year).
    """
    first, train_end, val_end = bounds
    period = "before" if year < first else "train" if year <= train_end else "val" if year <= val_end else "test"
    if model == "v3" and period != "test":
        raise ValueError(f"{year} lies in the {period!r} period: the history model is judged on test only")
    return period


def allowed_rows(df: DataFrame, train_end: int, val_end: int, year: str = "year") -> DataFrame:
    """Keep the rows whose period lets a history model be shown."""
    return df.filter(split_label(year, train_end, val_end) == "test")


def serving_entities(
    entities: DataFrame, shares: DataFrame, rates: DataFrame, transfer: DataFrame, totals: DataFrame, share_key: str = "dep"
) -> DataFrame:
    """The entity table served to readers: reference, shares, full-period rates, shifted risk and event totals.

    Every right side is one row per key, so the chain of left joins keeps one row per entity.
    """
    full = rates.filter(F.col("excluded_year") == 0).drop("excluded_year")
    out = entities.join(shares, share_key, "left").join(full, "entity", "left")
    out = out.join(transfer, "entity", "left").join(totals, "entity", "left")
    return out.withColumn("events", F.coalesce("events", F.lit(0)))
