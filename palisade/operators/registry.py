"""Publish histories: order, latest and previous versions, gaps and changes, as windows over one row per version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.versions import major_of
from palisade.schema import LIFECYCLE_HOOKS


#: Versions among whose gaps the longest one counts.
DORMANCY = 5


def millis_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", earlier, later)


def ranked(versions: DataFrame, key: str = "name", at: str = "published_at", tie: list[str] | None = None) -> DataFrame:
    """With ``back`` (1: the last one by time)."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), *[F.col(t).desc() for t in tie or []])
    return versions.withColumn("back", F.row_number().over(w))


def latest_and_previous(versions: DataFrame, columns: list[str], key: str = "name", at: str = "published_at", tie: list[str] | None = None) -> DataFrame:
    """Per key: ``latest_c`` and ``previous_c`` for each of ``columns``, from the last and the last but one row by time."""
    two = ranked(versions, key, at, tie).filter("back <= 2")
    picked = [F.max(F.when(F.col("back") == n, F.col(c))).alias(f"{name}_{c}") for c in columns for n, name in ((1, "latest"), (2, "previous"))]
    return two.groupBy(key).agg(*picked)


def publish_interval(pair: DataFrame, at: str = "published_at") -> DataFrame:
    """``interval_ms`` between the latest and the previous row; null without a previous one, negative for backports."""
    return pair.withColumn("interval_ms", millis_between(F.col(f"latest_{at}"), F.col(f"previous_{at}")))


def package_age(versions: DataFrame, as_of: Column, key: str = "name", at: str = "published_at") -> DataFrame:
    return versions.groupBy(key).agg(F.min(at).alias("created_at")).withColumn("age_ms", millis_between(as_of, F.col("created_at")))


def dormancy(versions: DataFrame, last: int = DORMANCY, key: str = "name", at: str = "published_at", tie: list[str] | None = None) -> DataFrame:
    """Per key ``dormancy_ms``: the longest positive gap between the ``last`` rows; null if there is none."""
    recent = ranked(versions, key, at, tie).filter(F.col("back") <= last)
    gap = millis_between(F.col(at), F.lag(at).over(Window.partitionBy(key).orderBy(F.col("back").desc())))
    return recent.withColumn("gap", gap).groupBy(key).agg(F.max(F.when(F.col("gap") > 0, F.col("gap"))).alias("dormancy_ms"))


def major_jump(latest: Column, previous: Column) -> Column:
    return F.when(previous.isNull(), F.lit(0).cast("bigint")).otherwise(major_of(latest) - major_of(previous))


def changed_publisher(latest: Column, previous: Column) -> Column:
    return F.coalesce(latest != previous, F.lit(False))


def added_and_removed(latest: Column, previous: Column) -> tuple[Column, Column]:
    """Sorted differences of two arrays of names; both empty without a previous one."""
    none = F.array().cast("array<string>")
    added = F.when(previous.isNull(), none).otherwise(F.array_sort(F.array_except(latest, previous)))
    removed = F.when(previous.isNull(), none).otherwise(F.array_sort(F.array_except(previous, latest)))
    return added, removed


def lifecycle_scripts(scripts: Column) -> Column:
    """The scripts that run on installation."""
    return F.map_filter(scripts, lambda k, v: k.isin(LIFECYCLE_HOOKS) & (F.coalesce(v, F.lit("")) != ""))


def profiles(packages: DataFrame, versions: DataFrame, as_of: Column, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """One row per package from its registry rows: the input of the rules. ``keys`` tell packages apart, as ("ecosystem", "name") do.

    The latest version is the tagged one, else the last by time; the previous one is the last but one by time. Missing history gives
    nulls, never a clean-looking default. Of a package with very many versions only sums and its last ones come together.
    """
    keys = list(keys)
    by_time = Window.partitionBy(*keys).orderBy(F.col("published_at").desc())
    row = F.struct("version", "publisher", "published_at", "scripts", "dependencies")
    # The filter on the row number reaches the tasks that read, so at most DORMANCY rows a task and package travel.
    recent = versions.select(*keys, row.alias("row"), "published_at").withColumn("back", F.row_number().over(by_time)).filter(F.col("back") <= DORMANCY)
    recent = recent.withColumn("gap", millis_between(F.col("published_at"), F.lead("published_at").over(by_time)))
    newest = recent.groupBy(*keys).agg(
        F.max_by("row", F.when(F.col("back") == 1, F.lit(1))).alias("n"),
        F.max_by("row", F.when(F.col("back") == 2, F.lit(1))).alias("p"),
        F.max(F.when((F.col("back") < DORMANCY) & (F.col("gap") > 0), F.col("gap"))).alias("dormancy_ms"),
    )
    counts = versions.groupBy(*keys).agg(F.count("*").cast("int").alias("version_count"), F.min("published_at").alias("first_at"))
    tagged = versions.join(packages.select(*keys, F.col("latest_tag").alias("version")).distinct(), [*keys, "version"]).groupBy(*keys).agg(F.max_by(row, "published_at").alias("tagged"))
    picked = counts.join(newest, keys, "left").join(tagged, keys, "left").withColumn("l", F.coalesce("tagged", "n"))
    return _profile(packages.join(picked, keys, "left"), keys, as_of)


def _profile(base: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """The columns of profiles() from rows with the latest version ``l``, the previous one ``p`` and what is known of the package."""
    names = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    added, removed = added_and_removed(names("l.dependencies"), F.when(F.col("p").isNotNull(), names("p.dependencies")))
    scripts = lifecycle_scripts(F.col("l.scripts"))
    return base.select(
        *keys,
        F.col("l.version").alias("latest_version"),
        F.col("p.version").alias("previous_version"),
        "maintainers",
        F.col("l.publisher").alias("latest_publisher"),
        F.col("p.publisher").alias("previous_publisher"),
        changed_publisher(F.col("l.publisher"), F.col("p.publisher")).alias("maintainer_changed"),
        (F.coalesce(F.size(scripts), F.lit(0)) > 0).alias("has_install_scripts"),
        scripts.alias("install_scripts"),
        names("l.dependencies").alias("dependencies"),
        added.alias("added_deps"),
        removed.alias("removed_deps"),
        F.col("l.published_at").alias("latest_publish_time"),
        F.col("p.published_at").alias("previous_publish_time"),
        millis_between(F.col("l.published_at"), F.col("p.published_at")).alias("publish_interval_ms"),
        millis_between(as_of, F.coalesce("created_at", "first_at")).alias("package_age_ms"),
        major_jump(F.col("l.version"), F.col("p.version")).cast("int").alias("major_jump"),
        "dormancy_ms",
        "version_count",
        "repository",
        "license",
    )


def version_profiles(packages: DataFrame, versions: DataFrame, as_of: Column, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """As profiles(), for every version of every package: what its profile was when it was the latest. ``keys`` and ``latest_version`` tell rows apart.

    One sort by package and time; all windows have bounded frames or running values, so a long history streams through its task.
    """
    keys = list(keys)
    by_time = Window.partitionBy(*keys).orderBy("published_at", "version")
    row = F.struct("version", "publisher", "published_at", "scripts", "dependencies")
    gap = millis_between(F.col("published_at"), F.lag("published_at").over(by_time))
    each = versions.select(*keys, row.alias("l"), F.lag(row).over(by_time).alias("p"), F.row_number().over(by_time).alias("version_count"), F.min("published_at").over(by_time).alias("first_at"), F.when(gap > 0, gap).alias("gap"))
    recent = Window.partitionBy(*keys).orderBy("l.published_at", "l.version").rowsBetween(2 - DORMANCY, 0)
    each = each.withColumn("dormancy_ms", F.max("gap").over(recent)).drop("gap")
    return _profile(each.join(packages, keys), keys, as_of)


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: list[str], tie: list[str] | None = None, strict: bool = False, bucket: str = "day") -> DataFrame:
    """``left`` with ``value``, a struct of these columns of the last row of ``right`` with equal ``keys`` whose time isn't after that of ``left``.

    With ``strict`` its time must be before. Of rows of one time the last by ``tie`` counts. Without such a row, and for null times, the value is
    null. Keys that are null equal each other. Both sides are put together and sorted by keys, ``bucket`` of time and time, so a hot key is dealt by
    its buckets; the last value of all earlier buckets stands at each one's start.
    """
    tie = tie or []
    side = lambda at, value, row, kind, order: [*[F.col(k) for k in keys], at.alias("__at"), F.lit(kind).alias("__kind"), order.alias("__tie"), value.alias("__value"), row.alias("__row")]
    given, none_row = F.struct(*[F.col(f"`{c}`") for c in left.columns]), F.lit(None)
    value_of, order_of_value = F.struct(*value), F.struct(*(tie or [F.lit(0)]))
    kind = left.select(given.alias("r")).schema["r"].dataType
    value_kind, tie_kind = right.select(value_of.alias("v"), order_of_value.alias("t")).schema["v"].dataType, right.select(order_of_value.alias("t")).schema["t"].dataType
    values = right.filter(F.col(right_at).isNotNull()).select(*side(F.col(right_at), value_of, none_row.cast(kind), 1, order_of_value))
    asked = left.select(*side(F.col(left_at), F.lit(None).cast(value_kind), given, 0 if strict else 2, F.lit(None).cast(tie_kind)))
    both = values.unionByName(asked).withColumn("__bucket", F.date_trunc(bucket, "__at"))
    held = both.groupBy(*keys, "__bucket").agg(F.max_by("__value", F.when(F.col("__kind") == 1, F.struct("__at", "__tie"))).alias("__value"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(*keys, "__bucket", F.last("__value", ignorenulls=True).over(earlier).alias("__value")).filter("__value is not null and __bucket is not null")
    starts = starts.select(*keys, F.col("__bucket").cast(both.schema["__at"].dataType).alias("__at"), F.lit(-1).alias("__kind"), F.lit(None).cast(tie_kind).alias("__tie"), "__value", none_row.cast(kind).alias("__row"), "__bucket")
    in_bucket = Window.partitionBy(*keys, "__bucket").orderBy("__at", "__kind", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(starts).withColumn("__value", F.last("__value", ignorenulls=True).over(in_bucket))
    asked_rows = found.filter(F.col("__kind") == (0 if strict else 2))
    return asked_rows.select(*[F.col("__row").getField(c).alias(c) for c in left.columns], F.when(F.col("__at").isNotNull(), F.col("__value")).alias("value"))


def versions_in_use(usage: DataFrame, versions: DataFrame, keys: tuple[str, ...] = ("name",), at: str = "at") -> DataFrame:
    """``usage(keys, at)`` with ``version``, the package's last one at that time, and ``previous``, the one before it; null if there was none."""
    keys = list(keys)
    before = as_of_join(versions.select(*keys, "version", "published_at"), versions, keys, "published_at", "published_at", ["version"], ["version"], strict=True)
    pairs = before.select(*keys, "published_at", "version", F.col("value.version").alias("previous"))
    used = as_of_join(usage, pairs, keys, at, "published_at", ["version", "previous"], ["version"])
    return used.select(*usage.columns, "value.version", "value.previous")


#: A raw npm registry document: what is read of it.
NPM_DOCUMENT = "name string, `dist-tags` map<string,string>, time map<string,string>, versions map<string, struct<scripts: map<string,string>, dependencies: map<string,string>, _npmUser: struct<name: string, email: string>>>, maintainers array<struct<name: string, email: string>>, repository string, license string"
#: A raw PyPI document: what is read of it.
PYPI_DOCUMENT = (
    "info struct<name: string, version: string, requires_dist: array<string>, project_urls: map<string,string>, home_page: string, license: string>, "
    "releases map<string, array<struct<upload_time_iso_8601: string, yanked: boolean>>>"
)


def npm_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PACKAGE and PACKAGE_VERSION rows of ``documents(content)``; versions without a time are left out, as are invalid documents."""
    doc = documents.withColumn("d", F.from_json("content", NPM_DOCUMENT)).filter("d.name is not null")
    time = lambda c: F.try_to_timestamp(c).cast("timestamp_ntz")
    people = F.transform("d.maintainers", lambda m: F.coalesce(m["name"], m["email"]))
    url = F.coalesce(F.get_json_object("d.repository", "$.url"), F.col("d.repository"))
    packages = doc.select("d.name", F.col("d.dist-tags")["latest"].alias("latest_tag"), time(F.col("d.time")["created"]).alias("created_at"), people.alias("maintainers"), url.alias("repository"), F.col("d.license").alias("license"))
    each = doc.select("d.name", "d.time", F.explode("d.versions").alias("version", "v"))
    publisher = F.coalesce("v._npmUser.name", "v._npmUser.email")
    rows = each.select("name", "version", time(F.col("time")[F.col("version")]).alias("published_at"), publisher.alias("publisher"), "v.scripts", "v.dependencies")
    return packages, rows.filter("published_at is not null")


def pypi_releases(documents: DataFrame) -> DataFrame:
    """``name, latest, version, uploaded, yanked`` of each release with files, by the time of its first file."""
    doc = documents.withColumn("d", F.from_json("content", PYPI_DOCUMENT)).filter("d.info.name is not null")
    each = doc.select(F.col("d.info.name").alias("name"), F.col("d.info.version").alias("latest"), F.explode("d.releases").alias("version", "files"))
    return each.filter(F.size("files") > 0).select("name", "latest", "version", F.col("files")[0]["upload_time_iso_8601"].alias("uploaded"), F.exists("files", lambda f: F.coalesce(f["yanked"], F.lit(False))).alias("yanked"))


def pypi_profiles(releases: DataFrame, as_of: Column) -> DataFrame:
    """One row per package of ``releases(name, latest, version, uploaded, yanked)``.

    Releases are in order of their upload times as text. The previous one is the one before the latest, or, if the latest is the first
    or unknown, the last but one.
    """
    w = Window.partitionBy("name").orderBy(F.coalesce("uploaded", F.lit("")), "version")
    row = F.struct("version", "uploaded")
    placed = releases.withColumns({"before": F.lag(row).over(w), "at": F.row_number().over(w)})
    last = F.max_by(row, "at")
    folded = placed.groupBy("name").agg(
        F.max("latest").alias("tagged"),
        F.max_by(row, F.when(F.col("version") == F.col("latest"), F.lit(1))).alias("mine"),
        F.max_by("before", F.when((F.col("version") == F.col("latest")) & F.col("before").isNotNull(), F.lit(1))).alias("prior"),
        last.alias("last"),
        F.max_by("before", "at").alias("second_last"),
        F.min_by("uploaded", "at").alias("first_uploaded"),
        F.count("*").cast("int").alias("version_count"),
        F.array_sort(F.collect_list(F.when(F.col("yanked"), F.col("version")))).alias("yanked_versions"),
    )
    time = lambda c: F.try_to_timestamp(c).cast("timestamp_ntz")
    previous = F.coalesce("prior", "second_last")
    latest_at, previous_at = time(F.when(F.col("tagged").isNull(), F.col("last.uploaded")).otherwise(F.col("mine.uploaded"))), time(previous["uploaded"])
    return folded.select("name", F.coalesce("tagged", "last.version").alias("latest_version"), previous["version"].alias("previous_version"), latest_at.alias("latest_publish_time"), previous_at.alias("previous_publish_time"), millis_between(latest_at, previous_at).alias("publish_interval_ms"), millis_between(as_of, time(F.col("first_uploaded"))).alias("package_age_ms"), "version_count", "yanked_versions")


def pypi_requirement_names(requires: Column) -> Column:
    """Names of an array of requirement texts."""
    return F.transform(requires, lambda r: F.when(r.rlike("^[a-zA-Z0-9._-]+"), F.regexp_replace(F.lower(F.regexp_extract(r, "^([a-zA-Z0-9._-]+)", 1)), "[._]", "-")).otherwise(r))


def npm_archive_url(name: Column, version: Column) -> Column:
    return F.concat(F.lit("https://registry.npmjs.org/"), name, F.lit("/-/"), F.element_at(F.split(name, "/"), -1), F.lit("-"), version, F.lit(".tgz"))


def pypi_archive_url(urls: Column, hosts: list[str]) -> Column:
    """The first source archive of ``urls(url, packagetype)``, else the first file; null if its URL isn't allowed."""
    from palisade.functions.text import url_problem

    first = F.coalesce(F.get(F.filter(urls, lambda u: u["packagetype"] == "sdist"), F.lit(0))["url"], F.get(urls, F.lit(0))["url"])
    return F.when(url_problem(first, hosts).isNull(), first)


def latest_versions(wanted: DataFrame, packages: DataFrame) -> DataFrame:
    """``wanted(ecosystem, name)`` with ``latest``, the version that the npm registry tags so; null for other ecosystems and unknown names."""
    tags = packages.select("name", F.col("latest_tag").alias("latest"))
    return wanted.join(tags, "name", "left").withColumn("latest", F.when(F.col("ecosystem") == "npm", F.col("latest")))
