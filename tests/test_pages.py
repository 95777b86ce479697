"""Whole pages: nested achievement tables, quests, class tests, tooltips, result lists and guides, by golden cases."""

import pytest
from pyspark.sql import functions as F

from lanternlog.functions import pages as P
from lanternlog.functions import text as X
from lanternlog.functions import wiki

GROUP = '{{| class="t"\n! <span title="Expand or collapse {0}">{0}</span>\n|-\n|\n'
LEAF = '{| id="a_b"\n! x | <span title="Expand or collapse Race Unlock - Elf" style="s">\n<div>Race Unlock — Elf</div>\n<div>5 Points</div>\n</span>\n|-\n|\n'
ACH = (
    "== Deeds ==\nintro\n|}\n" + GROUP.format("Potential") + GROUP.format("Races") + LEAF
    + "'''Completing this lets you be an [[Elf|elf]].'''\n\n'''Requirements'''\n<ul><li class=q>☐&nbsp;Finish [[Old Quest|the quest]]</li>\n<li>Walk</li><li> </li></ul>\nThis is bypassed.\n<ul><li>Use an unlock token</li></ul>\n|}\n"
    + '{|\n! <span title="Expand or collapse Walker">\n1 Point\n|-\n|\n\'\'\'Walker\'\'\'\n<li>Go far, not an unlock token</li>\n\'\'\' Notes \'\'\'\n<li>Slow</li>\n|}\n|}\n|}\n'
    + '{|\n! <span title="Expand or collapse Alone">\n|-\n| <li>One</li>\n|}\n{|\n! title="Expand or collapse Empty"\n|}\n{|\n| no title, 3 Points\n|}\n'
    + "== Template ==\n" + LEAF + "<li>Copy me</li>\n|}\n"
)


def test_achievements(spark):
    df = spark.createDataFrame([(1, ACH), (2, "== A ==\nx"), (3, None), (4, "{|\n" * 3000 + "|}\n" * 4000)], "id int, t string")
    rows = P.achievements(df, "t").orderBy("id", "pos").collect()
    assert [(r.id, r.pos, r.key, r.name, r.group, r["sub"], r.points, r.desc) for r in rows] == [
        (1, 0, "race-unlock-elf", "Race Unlock - Elf", "Potential", "Races", 5, "Completing this lets you be an elf."),
        (1, 1, "walker", "Walker", "Potential", "Races", 1, ""),
        (1, 2, "alone", "Alone", "", "", None, ""),
    ]
    assert [[(q.text, q.link) for q in r.reqs] for r in rows] == [[("Finish the quest", "Old Quest"), ("Walk", None)], [("Go far, not an unlock token", None)], [("One", None)]]
    assert [list(r.notes) for r in rows] == [["Use an unlock token"], ["Slow"], []]
    assert [r.unlock and (r.unlock.kind, r.unlock.name) for r in rows] == [("race", "Elf"), None, None]


QUEST = """{{Era}}
<!-- * no step -->
[[File:a.jpg|thumb]]
{| class="x questTopTable"
! ''' Start Zone: '''
| [[Old Keep|The Keep]]
|-
! ''' Quest Giver: '''
| [[Ann Lee]]
|-
! ''' Recommended Level: '''
| Level 46+ (raid)
|-
! ''' Classes: '''
| [[Bard]], Monk/Bard and none
|-
! ''' Races: '''
| All
|}
== Reward ==
* [[Prize]]
== Checklist ==
* Talk to [[Ann Lee]]
=== Page 2 ===
# ''Find'' the [[Red Gem#part|gem]]
* Your faction standing with X got better
*
"""
PROSE = """Caleah [[Herb]] may be found inside the old house here.
short line
: Ann says 'Have you seen [[Bat Fur]], my friend of old?'
You say, 'What have you seen of the fire beetle eye?'
== Walkthrough and more ==
Go to the [[North]] and wait for the wolves to come out.
== History ==
This long line tells of old days and is no step at all.
"""


def test_quests(spark):
    many = "\n".join(f"* step {i}" for i in range(100))
    df = spark.createDataFrame([(1, QUEST), (2, PROSE), (3, many), (4, '{| class="questTopTable"\n! broken'), (5, None)], "id int, t string")
    r = {x.id: x for x in P.quests(df, "t").collect()}
    q = r[1]
    assert (q.has_top_table, q.start_zone, q.giver, q.level_min, q.level_max, q.classes, q.races) == (True, "The Keep", "Ann Lee", 46, None, ["Bard", "Monk"], ["All"])
    assert q.steps == ["Talk to Ann Lee", "Page 2 — Find the gem"] and q.mentions == ["Prize", "Red Gem#part"]
    p = r[2]
    assert p.steps == ["Caleah Herb may be found inside the old house here.", "Go to the North and wait for the wolves to come out."]
    assert p.mentions == ["Herb", "Bat Fur", "North"] and not p.has_top_table and p.classes == []
    assert len(r[3].steps) == 80 and r[3].steps[0] == "step 0"
    assert (r[4].has_top_table, r[4].steps, r[5].steps, r[5].mentions) == (False, [], [], [])


TABLE = """{| class="q"
|-
! Reward || Quest || Words || Rune || Items
|-
| {{:Belt}}
| '''Test''' of  Faith
| faith
| <ul><li>[[Wind Rune]]</li></ul>
| <ul>
<li>'''{{SkyNoDrop|[[Gem (Old God's Gem)|Gem]]}}''' (6-BZ)</li>
<li>[[Sword]]</li>
<li>nothing</li>
</ul>
|-
| [[Wing]]
| Test of Love
| love
| [[Sun Rune]] (5)
| [[Leaf]]
|-
| too
| few
|}
"""
SKY = f"== Sky ==\n=== [[Monk]] Tests ===\n{TABLE}== Sky Class Quests ==\nlead\n=== Givers ===\nx\n=== [[Paladin]] Tests ===\n''' Quest Giver: ''' [[Dason|D]]\n{TABLE}==== deeper ====\n=== [[Rogue|R]] Tests ===\n{TABLE.replace('faith', 'guile').replace('of  Faith', 'of Guile').replace('of Love', 'of Luck')}= Random =\n=== [[Bard]] Tests ===\n{TABLE}"


def test_class_tests(spark):
    df = spark.createDataFrame([(1, SKY), (2, "none"), (3, None)], "id int, t string")
    rows = P.class_tests(df, "t", "Sky Class Quests").orderBy("id", "pos").collect()
    assert [(r.pos, r.cls, r.giver, r.key, r.name, r.phrase, r.reward, r.reward_norm) for r in rows] == [
        (0, "Paladin", "Dason", "test-of-faith", "Test of Faith", "faith", "Belt", "belt"),
        (1, "Paladin", "Dason", "test-of-love", "Test of Love", "love", "Wing", "wing"),
        (2, "Rogue", None, "test-of-guile", "Test of Guile", "guile", "Belt", "belt"),
        (3, "Rogue", None, "test-of-luck", "Test of Luck", "love", "Wing", "wing"),
    ]
    assert [tuple(n) for n in rows[0]["items"]] == [("Gem (Old God's Gem)", "Gem", "6-BZ", True), ("Sword", "Sword", None, False)]
    assert [tuple(n) for n in rows[1].runes] == [("Sun Rune", "Sun Rune", "5", False)]


@pytest.mark.parametrize("wrong", [None, "few", "class", "key", "needs", "empty"])
def test_tests_are_whole_or_bundled(spark, wrong):
    rows = [(f"k{i}", "AB"[i % 2], [1], [2], "synced") for i in range(6)]
    rows = {"few": rows[:3], "class": [(k, "A", r, i, s) for k, _, r, i, s in rows], "key": [("k0", c, r, i, s) for _, c, r, i, s in rows], "needs": [*rows[:5], ("k5", "B", [], [1], "synced")], "empty": []}.get(wrong, rows)
    schema = "key string, cls string, runes array<int>, items array<int>, src string"
    got = P.whole_tests(spark.createDataFrame(rows, schema), spark.createDataFrame([("b", "A", [1], [1], "bundled")], schema), ("B", "A"), 4).collect()
    assert {r.src for r in got} == ({"bundled"} if wrong else {"synced"}) and len(got) == (1 if wrong else 6)


WEAPON = """<main><nav class="x"><a>Home</a></nav><h1>Short  Sword</h1><aside class="c tooltip-card" aria-label="x">
<p class="tooltip-title"><img src="a.png" />Short Sword (card)</p><p class="tooltip-flags">MAGIC ITEM · NODROP</p>
<ul class="other"><li>Slot: NONE</li></ul><ul class="tooltip-lines"><li>Slot: PRIMARY <b>SECONDARY</b></li><li>Skill: 1H Slashing Atk Delay: 24</li>
<li>DMG: 9</li><li>Backstab DMG: 20</li><li>AC: 5</li><li>Haste: +36%</li><li>WT: 2.5 Size: MEDIUM</li><li>WIS: +9 HP: +55 SV POISON: -1 SV MAGIC: +3</li>
<li>Class: WAR &amp; PAL</li><li>Race: ALL</li><li>Effect: Ykesha (Combat, Casting Time: Instant) at Level 37</li><li>Effect: Boots (Any Slot, Casting Time: 5)</li>
<li>Effect: Cloud II (Worn)</li><li>Focus Effect: Haste II</li><li>Effect: </li><li>Drops From: Lower Guk: the ghoul lord, a rat</li><li>Drops from: East</li><li>Odd line</li></ul></aside>
<ul class="tooltip-lines"><li>AC: 99</li></ul></main>"""


def test_tooltips(spark):
    df = spark.createDataFrame([(1, WEAPON), (2, "<aside class=tooltip-card><p class=tooltip-title>Bare</p></aside>"), (3, None), (4, "<h1>open <p>x <aside class='tooltip-card'><ul class=tooltip-lines><li>AC: 3")], "id int, h string")
    r = {x.id: x for x in P.tooltips(df, "h").collect()}
    w = r[1]
    assert (w.name, w.flags, w.magic, w.lore, w.no_drop, w.slot, w.skill, w.delay, w.dmg, w.ac, w.haste) == ("Short Sword", ["MAGIC ITEM", "NODROP"], True, False, True, "PRIMARY SECONDARY", "1H Slashing", 24, 9, 5, 36)
    assert (w.wt, w.size, w["class"], w.race, w.hp, w.mana, w.stats, w.resists) == (2.5, "MEDIUM", "WAR & PAL", "ALL", 55, None, {"WIS": 9}, {"POISON": -1, "MAGIC": 3})
    assert [(e.type, e.name, e.family, e.tier) for e in w.effects] == [("proc", "Ykesha", "Ykesha", None), ("click", "Boots", "Boots", None), ("worn", "Cloud II", "Cloud", 2), ("focus", "Haste II", "Haste", 2)]
    assert [tuple(d) for d in w.drops] == [("Lower Guk", "the ghoul lord"), ("Lower Guk", "a rat"), ("East", "")] and len(w.lines) == 18 and w.attributes == 14
    assert (r[2].name, r[2].lines, r[2].attributes, r[3].name, r[4].ac) == ("Bare", [], 0, "", 3)


def test_result_rows(spark):
    html = "<ul><li>no</li></ul><section id='weapon-Results'><br><ul><li>Blade — a <b>sharp</b> one<ul><li>inner</li></ul></li><li> </li></ul><table><tr><td>Bow</td></tr></table></section><li>after</li>"
    df = spark.createDataFrame([(1, html), (2, "<section id=results></section>"), (3, None)], "id int, h string")
    assert [(r.pos, r.name, r.description) for r in P.result_rows(df, "h").orderBy("pos").collect()] == [(0, "Blade", "a sharp oneinner"), (1, "Bow", None)]


def test_guides(spark):
    page = "===Strength (STR)===\n*Max (hard-cap): 255\n*Soft-cap: 200\n==Wisdom (WIS)==\nmax(hardcap) : 99\n== Other ==\nSoft-cap: 7\n"
    caps = spark.createDataFrame([(page,)], "t string").select(F.explode(X.sections(F.col("t"))).alias("s")).select("s.title", "s.lines")
    assert sorted(tuple(r) for r in P.stat_caps(caps).collect()) == [("str", 255), ("str_soft", 200), ("wis", 99)]
    guide = "{|\n! [[Zone]] !! Lvl Range !! 5 !! 10 !! Note\n|-\n| [[Old Keep|Keep]] {{#vardefine:zem|75}} || 10 - 20 || [[File:GoldCircle.png|20px]] || [[file:Odd.png]] || x\n|-\n| || 1 || x\n|-\n| East\n|}\n{|\n! Name !! 5\n|-\n| a || b\n|}"
    tables = spark.createDataFrame([(7, guide)], "id int, t string").select("id", F.explode(wiki.wikitables("t")).alias("t")).select("id", "t.headers", "t.rows")
    got = [(r.id, r.zone, r.level_min, r.level_max, r.zem, r.ratings) for r in P.zone_ratings(tables).orderBy("pos").collect()]
    assert got == [(7, "Keep", 10, 20, 75, {"5": "inefficient", "10": "Odd"}), (7, "East", None, None, None, {})]
