"""The repository catalogue: shards, candidates and the summary report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwake.functions import text as tx
from starwake.operators import rollups as ru
from starwake.operators.ranking import rank_all, top_k_ranked

RANGE = "struct<lo:bigint,hi:bigint>"


def _halvings(value: Column, low: Column, high: Column) -> Column:
    """All ranges that contain ``value`` while ``[low, high]`` is halved down to one number.

    The list has about log2(high - low) entries.
    """
    start = F.array(F.struct(low.alias("lo"), high.alias("hi")).cast(RANGE))
    steps = F.ceil(F.log2((high - low + 1).cast("double"))).cast("int")
    depth = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(
        F.array().cast("array<int>")
    )

    def halve(ranges: Column, _: Column) -> Column:
        last = F.element_at(ranges, -1)
        lo, hi = last.getField("lo"), last.getField("hi")
        middle = F.floor((lo + hi) / 2)
        child = F.when(
            value <= middle, F.struct(lo.alias("lo"), F.least(middle, hi).alias("hi"))
        ).otherwise(F.struct((middle + 1).alias("lo"), hi.alias("hi")))
        return F.when(lo >= hi, ranges).otherwise(F.concat(ranges, F.array(child.cast(RANGE))))

    return F.aggregate(depth, start, halve)


def _leaves(
    cells: DataFrame, groups: list[str], value: str, low: Column, high: Column, max_size: int
) -> DataFrame:
    """For every value the widest halved range with at most ``max_size`` rows.

    ``cells`` holds counts ``n`` per value. A range that cannot be halved any more is a leaf too,
    whatever its size.
    """
    ranges = cells.select(
        *groups, value, "n", F.posexplode(_halvings(F.col(value), low, high)).alias("depth", "range")
    )
    sizes = ranges.groupBy(*groups, "depth", "range").agg(F.sum("n").alias("size"))
    fitting = sizes.where((F.col("size") <= max_size) | (F.col("range.lo") == F.col("range.hi")))
    return (
        ranges.drop("n")
        .join(fitting, [*groups, "depth", "range"])
        .groupBy(*groups, value)
        .agg(F.min_by(F.struct("range", "size"), "depth").alias("leaf"))
        .select(*groups, value, "leaf.range.lo", "leaf.range.hi", "leaf.size")
    )


def assign_catalog_shards(
    repos: DataFrame, min_stars: int, max_shard_size: int, start_date: date, today: date
) -> DataFrame:
    """The shard of every (stars, creation day) that occurs.

    Star ranges are halved first; a single star number that is still too large is split by halving
    the range of creation days. The work is done on counts per (stars, day), never on the
    repositories themselves, and takes a fixed number of shuffles instead of one per level.
    """
    epoch = date(1970, 1, 1)
    first, last = (start_date - epoch).days, (today - epoch).days
    in_range = (F.col("stars") >= min_stars) & F.col("created").between(first, last)
    cells = (
        repos.select(
            F.col("stargazers_count").cast("bigint").alias("stars"),
            F.unix_date(F.to_date("github_created_at")).cast("bigint").alias("created"),
        )
        .where(in_range)
        .groupBy("stars", "created")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = cells.select(F.max("stars").alias("top")).scalar()
    per_stars = cells.groupBy("stars").agg(F.sum("n").alias("n")).withColumn("_top", top)
    lowest = F.lit(min_stars).cast("bigint")
    by_stars = _leaves(per_stars, [], "stars", lowest, F.col("_top"), max_shard_size)
    small = by_stars.where(F.col("size") <= max_shard_size)
    large = by_stars.where(F.col("size") > max_shard_size).select("stars")
    by_day = _leaves(
        cells.join(large, "stars"),
        ["stars"],
        "created",
        F.lit(first).cast("bigint"),
        F.lit(last).cast("bigint"),
        max_shard_size,
    )
    whole = small.select(
        "stars",
        F.lit(None).cast("bigint").alias("created"),
        F.col("lo").alias("min_stars"),
        F.col("hi").alias("max_stars"),
        F.lit(first).cast("bigint").alias("_from"),
        F.lit(last).cast("bigint").alias("_to"),
        F.col("size").alias("matched_count"),
    )
    dated = by_day.select(
        "stars",
        "created",
        F.col("stars").alias("min_stars"),
        F.col("stars").alias("max_stars"),
        F.col("lo").alias("_from"),
        F.col("hi").alias("_to"),
        F.col("size").alias("matched_count"),
    )
    shards = whole.unionByName(dated)
    return shards.select(
        "stars",
        "created",
        "min_stars",
        "max_stars",
        F.date_from_unix_date(F.col("_from").cast("int")).alias("created_after"),
        F.date_from_unix_date(F.col("_to").cast("int")).alias("created_before"),
        "matched_count",
        (F.col("matched_count") > max_shard_size).alias("too_large"),
    )


def plan_catalog_shards(
    repos: DataFrame, min_stars: int, max_shard_size: int, start_date: date, today: date
) -> DataFrame:
    """The leaf shards. A shard that is too large and cannot be split any further fails the query.

    The failure is part of the plan, so no caller can forget to ask for it; ``too_large`` is false
    in every row that comes out.
    """
    keys = ["min_stars", "max_stars", "created_after", "created_before", "matched_count"]
    assigned = assign_catalog_shards(repos, min_stars, max_shard_size, start_date, today)
    return require_complete_split(assigned.select(*keys, "too_large").distinct())


def require_complete_split(shards: DataFrame) -> DataFrame:
    """The same shards; reading one that is too large raises an error that names it."""
    said = F.concat(F.lit("shard cannot be split any further: "), shard_label(), F.lit(" has "), F.col("matched_count"))
    return shards.where(F.when(~F.col("too_large"), True).otherwise(F.raise_error(said).cast("boolean")))


def shard_label() -> Column:
    return F.format_string(
        "stars:%d..%d created:%s..%s",
        F.col("min_stars"),
        F.col("max_stars"),
        F.date_format("created_after", "yyyy-MM-dd"),
        F.date_format("created_before", "yyyy-MM-dd"),
    )


def shard_items(repos: DataFrame, assigned: DataFrame) -> DataFrame:
    """Repositories with the shard they are found in.

    The shard table is matched on the star number, and on the creation day where a star number is
    split by day. Counting cells keep it small next to the repositories; AQE sees its real size.
    """
    labelled = assigned.select("stars", "created", "min_stars", "created_after", shard_label().alias("shard"))
    listed = repos.select(
        "repo_full_name",
        "html_url",
        F.col("stargazers_count").cast("bigint").alias("stars"),
        F.unix_date(F.to_date("github_created_at")).cast("bigint").alias("created"),
    )
    whole = labelled.where("created IS NULL").drop("created")
    dated = labelled.where("created IS NOT NULL")
    columns = ["repo_full_name", "html_url", "stars", "min_stars", "created_after", "shard"]
    return (
        listed.join(whole, "stars")
        .select(*columns)
        .unionByName(listed.join(dated, ["stars", "created"]).select(*columns))
    )


def catalog_candidates(items: DataFrame) -> DataFrame:
    """One row per repository: newest facts, and its shards in search order, each once.

    ``items`` has one row per search hit with ``position`` giving the order of the hits. Only the
    first position of each (repository, shard) is listed, so the list is as long as the number of
    different shards, however often a repository was hit.
    """
    per_shard = (
        items.where(F.coalesce("repo_full_name", F.lit("")) != "")
        .groupBy("repo_full_name", "shard")
        .agg(
            F.min("position").alias("first_at"),
            F.max_by(F.struct("html_url", "stargazers_count"), "position").alias("seen"),
            F.max("position").alias("last_at"),
        )
    )
    return (
        per_shard.groupBy("repo_full_name")
        .agg(
            F.max_by("seen", "last_at").alias("seen"),
            F.array_sort(F.collect_list(F.struct("first_at", "shard"))).alias("found"),
        )
        .select(
            F.col("repo_full_name").alias("full_name"),
            F.col("seen.html_url").alias("html_url"),
            F.col("seen.stargazers_count").alias("stargazers_count"),
            F.transform("found", lambda item: item.getField("shard")).alias("source_shards"),
        )
    )


def rank_candidates(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    order = [F.desc("stargazers_count"), F.asc("full_name")]
    return rank_all(candidates, order) if limit is None else top_k_ranked(candidates, order, limit)


def repo_summary_report(metadata: DataFrame) -> DataFrame:
    """All repositories ranked again by stars, with the fields of the summary file."""
    fields = [
        "repo_full_name",
        "description",
        "primary_language",
        "topics",
        "stargazers_count",
        "forks_count",
        "subscribers_count",
        "network_count",
        "open_issues_count",
        "license_spdx_id",
        "is_archived",
        "github_pushed_at",
        "refreshed_at",
        "html_url",
    ]
    latest = ru.latest_metadata(metadata, fields).drop("repo_key")
    return rank_all(latest, [F.desc("stargazers_count"), F.asc("repo_full_name")])


def summary_header(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("total_repos"), F.max("refreshed_at").alias("updated_at")
    )


def repo_file_name(full_name: Column) -> Column:
    owner = tx.owner_of(full_name)
    rest = F.substring_index(full_name, "/", -1)
    return F.concat(owner, F.lit("__"), rest, F.lit(".json"))
