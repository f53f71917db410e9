import random

from pyspark.sql import functions as F

from sendero.operators import datasets as ds

PLACE = "town string, id string, name string, edited boolean"


def test_refresh_keeps_edits(spark):
    installed = spark.createDataFrame(
        [("t", "t/a", "mine", True), ("t", "t/b", "b", False), ("t", "t/c", "c", None), ("u", "u/x", "x", False)], PLACE
    )
    incoming = ds.town_places(spark.createDataFrame([("t", "a", "A"), ("t", "b", "B"), ("t", "d", "D")], "town string, id string, name string"))
    got = {(r.id, r.name) for r in ds.refresh_towns(installed, incoming).collect()}
    assert got == {("t/a", "mine"), ("t/b", "B"), ("t/d", "D"), ("u/x", "x")}


EDITS = "file_pos bigint, town string, id string, name string, partida string, num string, ref string, lat string, lng string, address string, notes string, updated_at string"


def test_import_edits_is_idempotent(spark):
    installed = spark.createDataFrame([("t", "t/a", "mine", True), ("t", "t/b", "b", False)], PLACE)
    row = lambda pos, pid, name, lat="38": (pos, "t", pid, name, "P", "1", None, lat, "-0.9", None, None, "2026")
    edits = spark.createDataFrame(
        [row(1, "t/a", "x"), row(2, "t/b", "first"), row(3, "t/b", "last"), row(4, "t/n", "new"), row(5, "t/z", "bad", "200"), row(6, None, "bad")], EDITS
    )
    places, report = ds.import_edits(installed, edits)
    assert report.first().asDict() == {"added": 3, "conflicts": 1, "invalid": 2}
    assert {(r.id, r.name) for r in places.collect()} == {("t/a", "mine"), ("t/b", "last"), ("t/n", "new")}
    again, report = ds.import_edits(places, edits)
    assert report.first().asDict() == {"added": 0, "conflicts": 4, "invalid": 2}
    assert again.count() == 3


ADDRESS = "file_pos bigint, id string, name string, address string, notes string, lat double, lng double, created_at string, updated_at string"


def greedy(own, rows):
    ids, sigs, out = {o[0] for o in own}, {o[1:] for o in own}, []
    for pos, rid, *sig in rows:
        if rid in ids or tuple(sig) in sigs:
            continue
        ids.add(rid), sigs.add(tuple(sig)), out.append(pos)
    return out


def test_import_addresses_equals_row_by_row(spark):
    rng = random.Random(3)
    own = [(f"o{i}", f"casa {i}", 38.0 + i, -0.9) for i in range(5)]
    rows = []
    for pos in range(400):
        rid = f"o{rng.randrange(8)}" if rng.random() < 0.1 else f"i{rng.randrange(120)}"
        k = rng.randrange(60)
        rows.append((pos, rid, f"casa {k}", 38.0 + k % 7, -0.9))
    frame = spark.createDataFrame([(p, i, n, None, None, la, ln, "c", "u") for p, i, n, la, ln in rows], ADDRESS)
    mine = spark.createDataFrame([(i, n, "", "", la, ln, "c", "u") for i, n, la, ln in own], ADDRESS.split(", ", 1)[1])
    merged, report = ds.import_addresses(mine, frame)
    want = greedy(own, rows)
    added = {(r.id, r.name, r.lat) for r in merged.collect()} - {(o[0], o[1], o[2]) for o in own}
    assert added == {(rows[p][1], rows[p][2], rows[p][3]) for p in want}
    assert report.first().asDict() == {"added": len(want), "conflicts": 400 - len(want), "invalid": 0}
    _, report = ds.import_addresses(merged, frame)
    assert report.first().added == 0


def test_import_addresses_fixture(spark):
    mine = spark.createDataFrame([("1", "S", "", "", 1.0, 1.0, "c", "u")], ADDRESS.split(", ", 1)[1])
    rows = [(1, "2", " s ", 1.0), (2, "2", "T", 1.0), (3, "3", "t", 1.0), (4, "3", "U", 1.0), (5, "9", " ", 1.0), (6, "9", "W", 99.0)]
    frame = spark.createDataFrame([(p, i, n, None, None, la, 1.0, None, None) for p, i, n, la in rows], ADDRESS)
    merged, report = ds.import_addresses(mine, frame)
    assert report.first().asDict() == {"added": 2, "conflicts": 2, "invalid": 2}
    assert {(r.id, r.name) for r in merged.collect()} == {("1", "S"), ("2", "T"), ("3", "U")}


def test_diff_version_and_gate(spark):
    schema = "town string, id string, name string, partida string, num string, lat double, lng double, ref string"
    old = [("t", "a", "A", "P", "1", 1.0, 1.0, None), ("t", "b", "B", "P", "2", 1.0, 1.0, None), ("u", "c", "C", "P", "S/N", 1.0, 1.0, "Ref. 1")]
    new = [("t", "a", "A2", "P", "1", 1.0, 2.0, "Ref. 9"), ("t", "d", "D", "P", "S/N", 1.0, 1.0, None), ("u", "c", "C", "P", "S/N", 1.0, 1.0, "Ref. 1"),
           ("v", "e", "E", "P", "1", 1.0, 1.0, None), ("v", "e", "E", "P", "1", 1.0, 1.0, None)]
    old_df, new_df = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    changes = {(r.id, r.change) for r in ds.diff_snapshots(old_df, new_df, ["town", "id"], ["lat", "lng"], ["name"]).collect()}
    assert changes == {("a", "moved"), ("a", "renamed"), ("b", "lost"), ("d", "added"), ("e", "added"), ("e", "duplicate")}
    cols = ["id", "name", "partida", "num", "lat", "lng", "ref"]
    versions = {r.town: r.version for r in ds.next_version(old_df.withColumn("version", F.lit(4)), new_df, cols).collect()}
    assert versions == {"t": 5, "u": 4, "v": 1}
    # a value that moves into a null neighbour is a change; a null that stays is none; repeats count
    before = spark.createDataFrame([("x", 4, "a", None, "1"), ("y", 2, "b", None, "1"), ("z", 7, "c", "P", "1")], "town string, version int, id string, partida string, num string")
    after = spark.createDataFrame([("x", "a", "1", None), ("y", "b", None, "1"), ("z", "c", "P", "1"), ("z", "c", "P", "1")], "town string, id string, partida string, num string")
    versions = {r.town: r.version for r in ds.next_version(before, after, ["id", "partida", "num"]).collect()}
    assert versions == {"x": 5, "y": 2, "z": 8}
    gate = {r.check: r.violations for r in ds.release_gate(old_df, new_df).collect()}
    assert gate == {"lost_ids": 1, "moved_ids": 1, "duplicate_ids": 1, "numbered_with_ref": 1, "unnumbered_without_ref": 1}


def test_towns(spark):
    manifest = spark.createDataFrame([("a", "A", 3), ("b", "B", 1), ("c", "C", 2)], "town string, name string, version int")
    have = spark.createDataFrame([("a", "", 2, True), ("b", "Bee", 1, False)], "town string, name string, version int, visible boolean")
    assert [r.town for r in ds.outdated(manifest, have).collect()] == ["a"]
    labels = {r.town: r.town_label for r in ds.with_town_label(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "town string"), have, manifest).collect()}
    assert labels == {"a": "A", "b": "Bee", "c": "C", "d": "d"}
    arts = spark.createDataFrame([("graph", 2), ("basemap", 1), ("x", 1)], "name string, version int")
    on_device = spark.createDataFrame([("graph", 1), ("basemap", 1)], "name string, version int")
    assert {r.name for r in ds.artifacts_needed(arts, on_device, have).collect()} == {"graph", "x"}
    assert ds.artifacts_needed(arts, on_device, have.limit(0)).count() == 0
    installed = spark.createDataFrame([("a", "1", "n", True), ("a", "2", "n", False), ("b", "3", "n", False)], PLACE)
    gone = spark.createDataFrame([("a",)], "town string")
    assert {r.id for r in ds.delete_towns(installed, gone).collect()} == {"3"}
    assert {r.id for r in ds.delete_towns(installed, gone, keep_edited=True).collect()} == {"1", "3"}
    up = ds.upsert_manifest(manifest.withColumnRenamed("town", "id"), spark.createDataFrame([("c", "Aaa", 9)], "id string, name string, version int"))
    assert [(r.id, r.version) for r in up.collect()] == [("a", 3), ("c", 9), ("b", 1)]


def test_a_chain_of_imports_takes_few_rounds(spark, monkeypatch):
    written = []
    kept = ds.cut
    monkeypatch.setattr(ds, "cut", lambda df, label="t": written.append(label) or kept(df, label))
    # each row shares its id with the row before it or its signature with the row after it
    chain = spark.range(3000).selectExpr(
        "id AS file_pos", "concat('k', cast(id / 2 AS bigint)) AS id", "concat('n', cast((id + 1) / 2 AS bigint)) AS name", "'' AS address",
        "'' AS notes", "38.0D AS lat", "-0.9D AS lng", "'c' AS created_at", "'u' AS updated_at",
    )
    own = chain.limit(0).drop("file_pos")
    merged, _ = ds.import_addresses(own, chain)
    rows = sorted(chain.collect(), key=lambda r: r.file_pos)
    ids, names, want = set(), set(), set()
    for r in rows:
        if r.id not in ids and r.name not in names:
            ids.add(r.id), names.add(r.name), want.add((r.id, r.name))
    assert {(r.id, r.name) for r in merged.collect()} == want and 1000 < len(want) < 3000
    assert len(written) < 20
