"""The log grammar and the snapshot readers on small files of our own."""

from lanternlog.sources import log, snapshots
from lanternlog.sources.sinks import export_view, write_csv
from lanternlog.streaming import ingest
from pyspark.sql import functions as F

STAMP = "[Fri Jul 31 18:38:02 2026] "
LINES = [
    ("You have gained an ability point!  You now have 3 ability points.", "aa_gain", {"points": 1, "balance_after": 3}),
    ('You have gained the ability "Deep Focus 2" at a cost of 4 ability points.', "aa_spend", {"ability": "Deep Focus 2", "points": 4}),
    ("You have improved Deep Focus 3 at a cost of 1 ability point.", "aa_spend", {"ability": "Deep Focus 3", "points": 1}),
    ("You have deposited 12 Iron Ore to your personal depot.", "depot_deposit", {"qty": 12, "item": "Iron Ore"}),
    ("You have taken 2 Iron Ore from your personal depot.", "depot_withdraw", {"qty": 2, "item": "Iron Ore"}),
    ("You have successfully merged two items together to create a new item: Old Ring +4.", "upgrade", {"item": "Old Ring +4", "tier": 4}),
    ("You gain experience (with a bonus)! (1.25%)", "xp", {"pct": 1.25}),
    ("You have taken 40 damage from Stinging Swarm.", "damage_taken", {"amount": 40, "source": "Stinging Swarm"}),
    ("You have taken 40 damage from Stinging Swarm by a rat.", "damage_taken", {"amount": 40, "source": "a rat"}),
    ("You looted 2 Skin from a ghoul's corpse and sold it for 2 gold and 8 copper.", "loot", {"qty": 2, "item": "Skin", "source": "a ghoul", "copper": 208}),
    ("You looted a Blade from a ghoul's corpse and sold it for free.", "loot", {"qty": 1, "copper": 0}),
    ("You looted a Blade from a ghoul's corpse to create a Blade +2", "loot", {"item": "Blade", "merged_into": "Blade +2"}),
    ("You have completed achievement: Long Walk", "achievement", {"name": "Long Walk"}),
    ("You cannot combine these items in this container type!", "craft_error", {"reason": "wrong_container"}),
    ("You have slain a ghoul!", "kill", {"target": "a ghoul"}),
    ("You have entered Old Keep.", "zone", {"zone": "Old Keep"}),
    ("A ghoul slashes YOU for 4 points of damage.", "damage_taken", {"amount": 4, "verb": "slashes"}),
    ("You pierce a ghoul for 11 points of damage.", "damage", {"amount": 11, "target": "a ghoul"}),
    ("Zari has completed achievement: Long Walk", None, {}),
    ("An old toad has taken 3 damage from Gray Mist by Kir.", None, {}),
    ("You have successfully merged two items together to create a new item: Old Ring II", "upgrade", {"item": "Old Ring II", "base": "Old Ring II", "tier": None}),
    ("You looted a Blade from a ghoul's corpse and sold it for a song.", "loot", {"copper": 0}),
    ("Your faction standing with The Old Folk has been adjusted by -5.", "faction", {"faction": "The Old Folk", "delta": -5}),
    ("Your faction standing with The Old Folk could not possibly get any worse.", "faction_capped", {"direction": "worse"}),
    ("You have fashioned the items together to create something new: Plum Tonic.", "craft", {"item": "Plum Tonic", "ok": True}),
    ("You lacked the skills to fashion Plum Rolls.", "craft", {"item": "Plum Rolls", "ok": False}),
    ("You can no longer advance your skill from making this item.", "craft_capped", {}),
    ("Consumed 3 x Tea Leaf (leaving 9) from your personal depot.", "depot_consume", {"qty": 3, "item": "Tea Leaf", "left_qty": 9}),
    ("--You have looted 5 gold and 3 silver from a ghoul.--", "coin", {"copper": 530, "source": "a ghoul"}),
    ("--You have looted a Worn Coin from a ghoul.--", "loot", {"item": "Worn Coin", "source": "a ghoul", "qty": 1}),
    ("Ann healed you for 50 hit points by Minor Balm.", "heal", {"amount": 50, "source": "Ann", "spell": "Minor Balm"}),
    ("You gain party experience! (1.5%)", "xp", {"pct": 1.5, "bonus": False}),
    ("Ann tries to slash a toad, but misses!", "miss", {"attacker": "Ann", "ally": True}),
    ("A toad is burned by Ann's thorns for 7 points of non-melee damage.", "damage", {"attacker": "Ann", "dmg_type": "ds", "amount": 7}),
    ("You slash a ghoul for 30 points of damage. (Critical)", "damage", {"amount": 30, "dmg_type": "melee"}),
    ("Kir says, 'combine'", None, {}),
]


def test_grammar(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("\r\n".join(STAMP + line for line, _, _ in LINES).encode())
    rows = log.parse_events(log.read_log(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [r.type for r in rows] == [t for _, t, _ in LINES]
    for r, (_, _, fields) in zip(rows, LINES, strict=True):
        assert {k: r[k] for k in fields} == fields
        assert str(r.ts) == "2026-07-31 18:38:02"


def test_a_filter_on_the_type_parses_each_line_once(spark):
    """The filter comes after the grammar; pushed below it, every line would be parsed once more for it."""
    lines = spark.createDataFrame([(STAMP + said,) for said, _, _ in LINES], "line string").withColumns({"path": F.lit("a"), "offset": F.lit(0).cast("long")})
    for found in (ingest.events_of(lines), log.parse_events(lines, types=["loot"]), log.parse_events(lines, fields=[]).where("type IS NOT NULL")):
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        assert found.count() > 0


def test_what_a_line_says():
    for line, said in ((STAMP + " a b \t", " a b"), (STAMP, ""), (STAMP + "a\n", "a"), (STAMP + "a\nb", None), (STAMP[:-1] + "a", None), ("[" + STAMP, None), ("[a]" + STAMP, None), ("", None), (None, None)):
        assert log.said_of(line) == said, repr(line)


def test_members_only(spark):
    said = [(i, STAMP + t) for i, t in enumerate(("Ann tries to slash a toad, but misses!", "Zed tries to slash a toad, but misses!", "You have slain a toad!", "hello"))]
    roster = spark.createDataFrame([("Ann",)], "name string")
    got = {r.i: r.type for r in log.keep_members(log.parse_events(spark.createDataFrame(said, "i int, line string")), roster).collect()}
    assert got == {0: "miss", 1: None, 2: "kill", 3: None}


def test_offsets_resume_and_reset(spark, tmp_path):
    import hashlib

    at = tmp_path / "log.txt"
    body = [STAMP + f"You have entered Place {i}." for i in range(400)]
    raw = ("\r\n".join(body[:200]) + "\r\n\r\n" + "caf\u00e9\n").encode() + b"bad \xff byte\n" + STAMP.encode() + b"You have sl"
    at.write_bytes(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several splits
    try:
        lines = log.read_log(spark, str(at))
        got = lines.orderBy("offset").collect()
        want, pos = [], 0
        for i, part in enumerate(raw.split(b"\n")):
            text = part.decode("utf-8", "replace").removesuffix("\r")
            if text:
                want.append((i, pos, text, pos + len(part) < len(raw)))
            pos += len(part) + 1
        assert [(r.line_no, r.offset, r.line, r.whole) for r in got] == want
        files = log.log_identity(spark, str(at))
        assert files.first().head == hashlib.sha256(raw[:512]).hexdigest()
        none = spark.createDataFrame([], "path string, head string, offset long")
        points = log.resume_points(files, none)
        assert log.new_lines(lines, points).count() == len(want) - 1 and str(log.first_times(lines).first().first_ts) == "2026-07-31 18:38:02"
        marks = spark.createDataFrame([tuple(r) for r in log.next_checkpoints(lines, points).collect()], "path string, head string, offset long")
        assert marks.first().offset == want[-1][1]  # the line being written waits
        at.write_bytes(raw + b"ain a toad!\n")
        again, files = log.read_log(spark, str(at)), log.log_identity(spark, str(at))
        points = log.resume_points(files, marks)
        assert [r.line for r in log.new_lines(again, points).collect()] == [STAMP + "You have slain a toad!"] and not points.first().reset
        assert log.backfill_lines(again, points, ["Place 7.", "toad"]).count() == 1
        at.write_bytes(raw[: len(raw) // 2])
        points = log.resume_points(log.log_identity(spark, str(at)), marks)
        assert points.first().reset and points.first().start == 0
        at.write_bytes(b"x" + raw + raw)
        assert log.resume_points(log.log_identity(spark, str(at)), marks).first().reset
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_snapshots(spark, tmp_path):
    text = "Location\tName\tID\tCount\tSlots\nFinger\tOld Ring +2\t5\t1\t2\nFinger-Slot1\tGem\t6\t1\t0\nKeyRing\tName\tID\nKeyRing\tOld Key\t9\n"
    (tmp_path / "X_y-Inventory.txt").write_bytes(b"\xff\xfe" + text.encode("utf-16-le"))
    files = snapshots.read_files(spark, str(tmp_path))
    rows = snapshots.inventory_rows(snapshots.lines(files)).orderBy("seq").collect()
    assert [(r.name_norm, r.parent_location, r["count"]) for r in rows] == [("old ring", None, 1), ("gem", "Finger", 1), ("old key", None, 1)]
    assert files.select(snapshots.file_kind(files["name"], files["text"])).first()[0] == "inventory"

    kinds = {"Ann_x-Recipes.txt": "recipes", "Ann_x-Old Baking-Recipes.txt": "recipes", "Ann_x-WAR-Factions.txt": "faction", "a_b-Achievements.txt": "achievements", "Recipes.txt": None}
    by_text = {"1\tThe Folk\t-20\t5": "faction", "ID  Name  StandingValue  PointsToMax": "faction", "\n12  Bread": "recipes", "Recipe list": "recipes", "World: East\nC\tWalk": "achievements", "World: East\nWalk": None, "words": None, "": None}
    rows = spark.createDataFrame([(n, "") for n in kinds] + [("x.txt", t) for t in by_text], "name string, text string")
    got = rows.select(snapshots.file_kind(rows["name"], rows["text"]), snapshots.file_skill(rows["name"])).collect()
    assert [r[0] for r in got] == [*kinds.values(), *by_text.values()] and [r[1] for r in got][:3] == [None, "Old Baking", None]
    (tmp_path / "odd.txt").write_bytes(b"caf\xe9 \xff\n\xef\xbf\xbd")
    assert snapshots.read_files(spark, str(tmp_path / "odd.txt")).first().text == "caf� �\n�"

    def lines(text):
        return spark.createDataFrame([("p", i, x) for i, x in enumerate(text.split("\n"))], "path string, line_no long, line string")

    good, bad = snapshots.faction_rows(lines("ID\tName\tValue\tToMax\n1\tThe Folk\t-20\t5\n7 Some Folk 30\nnonsense"))
    assert [(r.faction_id, r.name, r.value) for r in good.orderBy("faction_id").collect()] == [(1, "The Folk", -20), (7, "Some Folk", 30)]
    assert [r.line for r in bad.collect()] == ["nonsense"]
    assert [(r.recipe_id, r.name) for r in snapshots.recipe_rows(lines("1\tBread\n2 Fish Pie\nx")).orderBy("recipe_id").collect()] == [(1, "Bread"), (2, "Fish Pie")]
    deeds = snapshots.achievement_rows(lines("World: East\nC\tWalk\nC\t\tgo far\t\nI\tRun\nI\t\tgo fast\t3/10")).orderBy("name").collect()
    assert [(d.category, d.name, d.complete, [(q.text, q.complete, q.progress) for q in d.reqs]) for d in deeds] == [
        ("World: East", "Run", False, [("go fast", False, "3/10")]),
        ("World: East", "Walk", True, [("go far", True, "")]),
    ]


def test_sitemap_and_export(spark, tmp_path):
    from pyspark.sql import functions as F

    xml = "<s:urlset><s:url><s:loc> http://a/1 </s:loc><s:lastmod>2026</s:lastmod></s:url><url><loc>http://a/2</loc></url></s:urlset>"
    got = spark.range(1).select(snapshots.sitemap_urls(F.lit(xml)).alias("u")).first().u
    assert [(x["loc"], x.lastmod) for x in got] == [("http://a/1", "2026"), ("http://a/2", None)]
    df = spark.sql("select true as ok, timestamp'2026-01-02 03:04:05' as t, cast(null as string) as n")
    write_csv(export_view(df, {"ok": "Done", "t": "When", "n": "Note"}).coalesce(1), str(tmp_path / "out"))
    data = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert data == b"\xef\xbb\xbfDone,When,Note\r\nyes,2026-01-02 03:04:05,\r\n"


def test_settings_and_fallback(spark):
    from lanternlog.sources import snapshots

    said = ["[Other]", "a=No, one", "[Characters]", "Char0 = Ann, north ,9", "; note = Bob, x", "c1=,east", "c2: Cid , east", "c3=solo", "[End]", "z=Zed, west"]
    rows = spark.createDataFrame([("f", n, line) for n, line in enumerate(said)], "path string, line_no long, line string")
    assert {(r.name, r.server) for r in snapshots.ini_characters(rows).collect()} == {("Ann", "north"), ("Cid", "east")}
    synced, bundled = spark.createDataFrame([("", 1), ("x", 2)], "t string, n int"), spark.createDataFrame([("b", 3)], "t string, n int")
    pick = lambda s: [r.t for r in snapshots.synced_or_bundled(s, bundled, s.t != "").collect()]
    assert pick(synced) == ["x"] and pick(synced.where("n = 1")) == ["b"] and pick(synced.limit(0)) == ["b"]


def test_inventory_places(spark):
    """Hosts are the nearest line before; a bag shows by its slots or by a number that no socket has."""
    said = """Location\tName\tID\tCount\tSlots
Ear\tOld Ring +2\t1\t1\t10
Ear-Slot7\tGem (Exaltation)\t2\t1\t0
Ear\tEmpty\t0\t0\t0
Ear-Slot1\tEmpty\t0\t0\t0
General 1\tSack\t3\t1\t4
General 1-Slot1\tPouch*\t4\t1\t0
General 1-Slot1-Slot1\tOre\t5\t20\t0
General 1-Slot1-Slot12\tEmpty\t0\t0\t0
General 1-Slot2\tEmpty\t0\t0\t0
Bank1\tBox\t8\t1\t0
Bank1-Slot3\tOre\t5\tmany\t0
Bank1-Slot4\tOre\t5\t\t
Personal-Depot3\tSilk\t9\t7
KeyRing\tName\tID
KeyRing\tOld Key\t6
short\tline"""
    lines = lambda path, text: [(path, i, x) for i, x in enumerate(text.split("\n"))]
    rows = spark.createDataFrame(lines("a", said) + lines("b", "No header\nEar\tRing\t1\t1\t0"), "path string, line_no long, line string")
    assert [r.path for r in snapshots.not_dumps(rows).collect()] == ["b"]
    items = snapshots.inventory_rows(rows)
    got = {r.seq: (r.root, r.parent_seq, r.sub_slot, r.is_empty, r.is_exaltation, r.upgrade_tier, r.is_equipped, r.parent_is_container) for r in items.collect()}
    assert got[1] == ("Ear", None, None, False, False, 2, True, None) and got[2] == ("Ear", 1, 7, False, True, 0, True, False)
    assert got[4] == ("Ear", 3, 1, True, False, 0, True, False) and got[8] == ("General 1", 6, 12, True, False, 0, False, True) and got[7][7] is True
    assert got[12] == ("Bank1", 10, 4, False, False, 0, False, True) and 11 not in got and 14 not in got and 16 not in got
    assert got[13] == ("Personal", None, None, False, False, 0, False, None) and got[15][0] == "KeyRing"
    assert {r.seq: r.host_name for r in items.collect() if r.seq in (1, 7, 8, 12)} == {1: None, 7: "Pouch*", 8: "Pouch*", 12: "Box"}
    assert "Join" not in items._jdf.queryExecution().optimizedPlan().toString() and "Join" not in snapshots.containers(items)._jdf.queryExecution().optimizedPlan().toString()
    bags = snapshots.containers(items)
    assert sorted((r.seq, r.section, r.capacity, r.used, r.free, r.nested) for r in bags.collect()) == [(5, "bags", 4, 1, 3, False), (6, "bags", 2, 1, 1, True), (10, "bank", 1, 1, 0, False)]
    assert {(r.section, r.containers, r.free) for r in snapshots.section_space(bags).collect()} == {("bags", 2, 4), ("bank", 1, 0)}


def test_sinks_replace_and_json(spark, tmp_path):
    """Replaced partitions are those that have rows now; JSON keeps nulls out and types apart."""
    import json

    from lanternlog.sources.sinks import VIEWS, export_named, replace_partitions, write_json

    rows = lambda *x: spark.createDataFrame(list(x), "who string, n long")
    read = lambda: sorted((r.who, r.n) for r in spark.read.parquet(f"{tmp_path}/t").collect())
    replace_partitions(rows(("a", 1), ("a", 2), ("b", 3)), f"{tmp_path}/t", ["who"])
    replace_partitions(rows(("a", 9)), f"{tmp_path}/t", ["who"])
    assert read() == [("a", 9), ("b", 3)]
    replace_partitions(rows(), f"{tmp_path}/t", ["who"])
    assert read() == [("a", 9), ("b", 3)]
    write_json(rows(("é\n", 1), (None, 2)).coalesce(1), f"{tmp_path}/j")
    said = [json.loads(x) for f in (tmp_path / "j").glob("part-*") for x in f.read_text("utf-8").splitlines()]
    assert sorted(said, key=lambda r: r["n"]) == [{"who": "é\n", "n": 1}, {"n": 2}]
    view = export_named(spark.sql("select 'Ring' as item, timestamp'2026-01-02 03:04:05' as ts, 5 as other"), "merges")
    assert view.columns == ["When", "Result", "Tier"] and tuple(view.first()) == ("2026-01-02 03:04:05", "Ring", None) and len(VIEWS) == 12
