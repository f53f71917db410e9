"""Dataset lifecycle: refresh, import, versions, diffs, release checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..plans.session import cut
from .components import connected_components

ROUNDS_BEFORE_GROUPS = 4
LARGEST_GROUP = 200_000  # rows that one task goes through


def is_edited() -> Column:
    return F.coalesce(F.col("edited"), F.lit(False))


def dedup_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order per key."""
    return _dedup(df, keys, F.max_by(F.struct(*_rest(df, keys)), F.struct(*order)), keys)


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the smallest order per key."""
    return _dedup(df, keys, F.min_by(F.struct(*_rest(df, keys)), F.struct(*order)), keys)


def _rest(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def _dedup(df: DataFrame, keys: list[str], pick: Column, columns: list[str]) -> DataFrame:
    # an aggregate, not a window: copies of a key collapse before the shuffle
    return df.groupBy(*keys).agg(pick.alias("row")).select(*columns, "row.*")


def active_towns(installed: DataFrame, places: DataFrame) -> DataFrame:
    """Places of towns which are installed and visible."""
    shown = installed.filter(F.coalesce("visible", F.lit(True)))
    return places.join(shown.select("town"), "town", "left_semi")


def refresh_towns(installed: DataFrame, incoming: DataFrame, towns: DataFrame | None = None) -> DataFrame:
    """Replace the rows of the incoming towns, except the edited ones.

    installed and incoming share their columns; incoming ids are already ``town/id``. ``towns``
    names the refreshed towns when one of them may have come without any place.
    """
    towns = (incoming if towns is None else towns).select("town").distinct()
    edited = installed.filter(is_edited())
    other = installed.filter(~is_edited()).join(towns, "town", "left_anti")
    fresh = incoming.join(edited.select("town", "id"), ["town", "id"], "left_anti")
    return other.unionByName(edited).unionByName(fresh, allowMissingColumns=True)


def town_places(places: DataFrame) -> DataFrame:
    """Published places as installed rows: id prefixed with its town, nothing edited."""
    return places.withColumn("id", F.concat_ws("/", "town", "id")).withColumn("edited", F.lit(False))


def import_edits(
    installed: DataFrame, edits: DataFrame, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Apply edits of other devices; local edits always win. -> (places, report).

    edits(file_pos, town, id, name, partida, num, ref, lat, lng, address, notes, updated_at).
    A place that occurs twice in the file is counted twice and its last row wins.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    valid = (
        F.col("id").isNotNull() & F.col("town").isNotNull() & geo.valid_coords("lat", "lng")
    )
    locally = installed.filter(is_edited()).select("id").withColumn("local", F.lit(True))
    judged = edits.withColumn("valid", valid).join(locally, "id", "left")
    judged = judged.withColumn(
        "outcome",
        F.when(~F.col("valid"), "invalid").when(F.col("local"), "conflict").otherwise("added"),
    )
    report = judged.agg(
        F.count_if(F.col("outcome") == "added").alias("added"),
        F.count_if(F.col("outcome") == "conflict").alias("conflicts"),
        F.count_if(F.col("outcome") == "invalid").alias("invalid"),
    )
    applied = dedup_last(
        judged.filter("outcome = 'added'").select(
            "file_pos",
            "town",
            "id",
            *[blank(c).alias(c) for c in ("name", "partida", "num", "ref", "address", "notes")],
            geo.to_number("lat").alias("lat"),
            geo.to_number("lng").alias("lng"),
            F.lit(True).alias("edited"),
            F.coalesce("updated_at", now if now is not None else _now()).alias("updated_at"),
        ),
        ["id"],
        ["file_pos"],
    ).drop("file_pos")
    kept = installed.join(applied.select("id"), "id", "left_anti")
    return kept.unionByName(applied, allowMissingColumns=True), report


def _now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _groups(rows: DataFrame) -> DataFrame:
    """rows(id, sig, file_pos) with comp, the same for rows linked by shared ids and signatures."""
    links = None
    for key in ("id", "sig"):
        first = rows.groupBy(key).agg(F.min("file_pos").alias("b"))
        linked = rows.join(first, key).select(F.col("file_pos").alias("a"), "b")
        links = linked if links is None else links.unionByName(linked)
    comps = connected_components(links, rows.select(F.col("file_pos").alias("vertex")).distinct())
    return rows.join(comps.withColumnRenamed("vertex", "file_pos"), "file_pos")


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of one group that are accepted, going through them in file order."""
    ids, signatures, accepted = set(), set(), []
    for pos, one, signature in rows.sort_values("file_pos")[["file_pos", "id", "sig"]].itertuples(index=False):
        if one not in ids and signature not in signatures:
            ids.add(one)
            signatures.add(signature)
            accepted.append(pos)
    return pd.DataFrame({"file_pos": pd.Series(accepted, dtype="int64")})


def import_addresses(
    own: DataFrame, incoming: DataFrame, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Merge own addresses in file order -> (own, report).

    A row is skipped when its id or its signature is taken by a local row or by an earlier
    accepted row; a skipped row takes nothing. A round accepts, all at once, the rows that
    are first of what is left for both their id and their signature, then drops the rows they
    block. A few rounds settle nearly all rows. What is left hangs together in chains, where each row waits for
    the one before it: those are split into connected groups, and a task goes through a group row by row.
    Groups too large for a task go on in rounds. All of that gives the same as going row by row.

    incoming(file_pos, id, name, address, notes, lat, lng, created_at, updated_at).
    """
    name = text.strip("name")
    valid = (F.coalesce(name, F.lit("")) != "") & geo.valid_coords("lat", "lng")
    judged = incoming.withColumn("valid", valid)
    lat, lng = geo.to_number("lat"), geo.to_number("lng")
    signature = text.address_signature("name", "lat", "lng")
    generated = F.sha2(F.concat_ws("|", F.col("file_pos").cast("string"), signature), 256)
    candidates = (
        judged.filter("valid")
        .withColumns({"name": name, "lat": lat, "lng": lng})
        .withColumn("sig", signature)
        .withColumn("id", F.coalesce(F.nullif("id", F.lit("")), generated))
    )
    keys = candidates.groupBy("id", "sig").agg(F.min("file_pos").alias("file_pos"))
    local = own.withColumn("sig", signature)
    keys = keys.join(local.select("id"), "id", "left_anti").join(
        local.select("sig"), "sig", "left_anti"
    )
    left = cut(keys.select("id", "sig", "file_pos"), "import")
    rounds, small = [], None
    while not left.isEmpty():
        if len(rounds) == ROUNDS_BEFORE_GROUPS:
            grouped = cut(_groups(left), "groups")
            large = grouped.groupBy("comp").agg(F.count("*").alias("n")).filter(F.col("n") > LARGEST_GROUP)
            fits = grouped.join(large, "comp", "left_anti")
            small = cut(fits.groupBy("comp").applyInPandas(_in_order, "file_pos bigint"), "import")
            left = cut(grouped.join(large, "comp", "left_semi").select("id", "sig", "file_pos"), "import")
            if left.isEmpty():
                break
        first_id = left.groupBy("id").agg(F.min("file_pos").alias("file_pos"))
        first_sig = left.groupBy("sig").agg(F.min("file_pos").alias("file_pos"))
        taken = cut(
            left.join(first_id, ["id", "file_pos"], "left_semi").join(
                first_sig, ["sig", "file_pos"], "left_semi"
            ),
            "import",
        )
        rounds.append(taken)
        left = cut(
            left.join(taken.select("id"), "id", "left_anti").join(
                taken.select("sig"), "sig", "left_anti"
            ),
            "import",
        )
    accepted = left.select("file_pos") if small is None else small
    for taken in rounds:
        accepted = accepted.unionByName(taken.select("file_pos"))
    stamp = now if now is not None else _now()
    added = candidates.join(accepted, "file_pos", "left_semi").select(
        "id",
        "name",
        F.coalesce("address", F.lit("")).alias("address"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        "lat",
        "lng",
        F.coalesce("created_at", stamp).alias("created_at"),
        F.coalesce("updated_at", stamp).alias("updated_at"),
    )
    counts = judged.agg(
        F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid")
    )
    report = counts.join(added.agg(F.count("*").alias("added"))).select(
        "added", (F.col("valid") - F.col("added")).alias("conflicts"), "invalid"
    )
    return own.unionByName(added, allowMissingColumns=True), report


def import_summary(addresses: DataFrame | None, edits: DataFrame | None) -> DataFrame:
    """(points, corrections, conflicts, invalid) of the two reports of one import."""
    zero = F.lit(0).cast("bigint")
    parts = []
    if addresses is not None:
        parts.append(addresses.select(F.col("added").alias("points"), zero.alias("corrections"), "conflicts", "invalid"))
    if edits is not None:
        parts.append(edits.select(zero.alias("points"), F.col("added").alias("corrections"), "conflicts", "invalid"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.agg(*[F.sum(c).alias(c) for c in ("points", "corrections", "conflicts", "invalid")])


def edited_counts(installed: DataFrame) -> DataFrame:
    return installed.groupBy("town").agg(
        F.count_if(is_edited()).alias("edited"), F.count("*").alias("places")
    )


def outdated(manifest: DataFrame, installed: DataFrame) -> DataFrame:
    """Installed towns whose manifest version is newer."""
    have = installed.select("town", F.col("version").alias("installed_version"))
    return manifest.join(have, "town").filter(
        F.col("version").cast("bigint") > F.col("installed_version").cast("bigint")
    )


def artifacts_needed(manifest: DataFrame, installed: DataFrame, towns: DataFrame) -> DataFrame:
    """Shared artifacts that are missing or old, as long as any town is installed."""
    have = installed.select("name", F.col("version").alias("installed_version"))
    joined = manifest.join(have, "name", "left")
    stale = F.col("installed_version").isNull() | (F.col("version") > F.col("installed_version"))
    any_town = towns.limit(1).select(F.lit(True).alias("any_town"))
    return joined.filter(stale).join(any_town).drop("any_town")


def with_town_label(df: DataFrame, installed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds town_label: the installed name, else the manifest's, else the id."""
    stored = installed.select("town", F.nullif("name", F.lit("")).alias("stored_name"))
    listed = manifest.select("town", F.nullif("name", F.lit("")).alias("listed_name"))
    return (
        df.join(stored, "town", "left")
        .join(listed, "town", "left")
        .withColumn("town_label", F.coalesce("stored_name", "listed_name", F.col("town").cast("string")))
        .drop("stored_name", "listed_name")
    )


def delete_towns(installed: DataFrame, towns: DataFrame, keep_edited: bool = False) -> DataFrame:
    gone = towns.select("town").distinct()
    if not keep_edited:
        return installed.join(gone, "town", "left_anti")
    edited = installed.filter(is_edited())
    return installed.filter(~is_edited()).join(gone, "town", "left_anti").unionByName(edited)


def upsert_manifest(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """Replace the entries of these towns, keep the others, sort by name."""
    kept = manifest.join(entries.select("id"), "id", "left_anti")
    both = kept.unionByName(entries, allowMissingColumns=True)
    return both.orderBy(F.coalesce("name", F.lit("")), "id")


def diff_snapshots(
    old: DataFrame,
    new: DataFrame,
    keys: list[str],
    moved: list[str],
    renamed: list[str],
) -> DataFrame:
    """(keys, change): lost, added, moved, renamed or duplicate; unchanged rows are left out.

    A row can be both moved and renamed and then shows up twice.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.struct(
                F.count("*").alias("n"),
                *[F.min(c).alias(c) for c in [*moved, *renamed]],
            ).alias(name)
        )

    def differs(columns: list[str]) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        return out

    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    changes = F.array_compact(
        F.array(
            F.when(F.col("n").isNull(), "lost"),
            F.when(F.col("o").isNull(), "added"),
            F.when(both & differs(moved), "moved"),
            F.when(both & differs(renamed), "renamed"),
            F.when(F.col("n.n") > 1, "duplicate"),
        )
    )
    return side(old, "o").join(side(new, "n"), keys, "full_outer").select(
        *keys, F.explode(changes).alias("change")
    )


def next_version(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """(town, version): unchanged places keep the version, changed ones get the next, new ones 1.

    old(town, version, id, ...), new(town, id, ...). Rows are compared as sets with their number of
    repeats, value by value and null with null, so the order in which a build wrote them does not matter.
    """
    row = ["town", *[c for c in columns if c != "town"]]
    sides = old.select(*row, F.lit(1).alias("side")).unionByName(new.select(*row, F.lit(-1).alias("side")))
    balance = sides.groupBy(*row).agg((F.sum("side") != 0).alias("differs"))
    towns = balance.groupBy("town").agg(F.bool_or("differs").alias("differs"))
    before = old.groupBy("town").agg(F.max("version").alias("version"))
    now = new.select("town").distinct().join(towns, "town").join(before, "town", "left")
    return now.select(
        "town",
        F.when(F.col("version").isNull(), 1)
        .when(F.col("differs"), F.col("version") + 1)
        .otherwise(F.col("version"))
        .cast("int")
        .alias("version"),
    )


def release_gate(old: DataFrame, new: DataFrame) -> DataFrame:
    """(check, violations) of a new snapshot; all zero means it may be published.

    Both sides: (town, id, name, partida, num, lat, lng, ref).
    """
    changes = diff_snapshots(old, new, ["town", "id"], ["lat", "lng"], ["name", "partida"])
    has_ref = F.coalesce("ref", F.lit("")) != ""
    numbered = ~text.without_number("num")
    diffs = changes.agg(
        *[F.count_if(F.col("change") == c).alias(f"{c}_ids") for c in ("lost", "moved", "duplicate")]
    )
    rows = new.agg(
        F.count_if(numbered & has_ref).alias("numbered_with_ref"),
        F.count_if(~numbered & ~has_ref).alias("unnumbered_without_ref"),
    )
    return diffs.join(rows).unpivot(
        [],
        ["lost_ids", "moved_ids", "duplicate_ids", "numbered_with_ref", "unnumbered_without_ref"],
        "check",
        "violations",
    )


def recent_first(own: DataFrame) -> DataFrame:
    return own.orderBy(F.desc("created_at"), "id")
