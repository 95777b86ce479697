"""Column functions against small tables of cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from lanternlog.functions import text as X


def run(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", function(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


CASES = [
    (X.normalize_name, {"  Engineer's  Ring +3": "engineers ring", "Kavruul`s Pouch (Exaltation)": "kavruuls pouch", "Fine Blade*": "fine blade", None: ""}),
    (X.zone_base, {"Keep - Group 2 (Hard)": "Keep", "Keep 3 (Easy)": "Keep", "Old  Keep": "Old Keep"}),
    (X.is_pseudo_zone, {"An area of peace": True, "Keep": False}),
    (X.zone_key, {"The Keep *": "keep", "Dwarf's Hall": "dwarfs hall"}),
    (X.slug, {"  Ab--c! D": "ab-c-d"}),
    (X.effect_tier, {"Haste IV": 4, "Haste X": 10, "Haste": None, "Mix": None}),
    (X.effect_family, {"Haste IV": "Haste", "Haste": "Haste"}),
    (X.split_names, {"Elf, Dwarf/Elf and none": ["Elf", "Dwarf"]}),
    (X.coin_to_copper, {"1 gold, 3 silver and 6 copper": 136, "free": 0, "nothing": None, "2 platinum": 2000}),
    (X.classify_url, {"https://a.b/items/5": "item", "https://a.b/items/a/b/": "item", "/items/gear": "index", "https://a.b/items/": None, "http://a/zones/x/?q": "zone", "http://a/": None, "http://a": None, "http://a/item/x": None, "http://a/best/a": None, "http://a/bis-gear": "bis", "http://a/clickies/#x": "category", "http://a/de/12.html": None, None: None}),
    (X.extract_links, {"[[A|b]] [[C]] [[A]] [[File:x]]": ["A", "C"], "[[Page#part]] [[open [[ B ]] [[x|]] [[|y]] [[a[b]]": ["Page#part", "B", "x"], "[[never": [], None: None}),
    (X.redirect_target, {"#REDIRECT [[Other page#part|x]]": "Other page#part", " #redirect[[A]]": "A", "text": None}),
    (X.split_br_lines, {"a<br>b\n<BR/> c ": ["a", "b", "c"]}),
    (X.strip_markup, {"''x'' [[A|b]] {{t|u}}<i>c</i>": "x b c", "[[A|]] [[A| ]] [[ B ]]": "A A B", "<!-- a > b\n -->c&nbsp;&nbsp;d": "c d", "I <3 you > me": "I <3 you > me", "'''b'''s '''''c''''' [[X|<span>Y</span>]]": "bs c Y", "[[open [[A|b]]": "[[open b", None: None}),
    (X.heading_level, {"== A ==": 2, "=A=": 1, "== Two ===": 2, "=== Two ==": 2, "====": 1, "==": 0, "===": 1, "=": 0, "text": 0, " ======= x ======= ": 6, "= x": 0}),
    (X.tolerant_fields, {"1\tA b\t5": ["1", "A b", "5"], "7 Some Folk -20 30": ["7", "Some Folk", "-20", "30"]}),
    (X.log_timestamp, {"[Fri Jul 31 18:38:02 2026] x": datetime.datetime(2026, 7, 31, 18, 38, 2), "chat": None}),
]


@pytest.mark.parametrize("function,cases", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_function(spark, function, cases):
    assert run(spark, function, list(cases)) == list(cases.values())


def test_levels(spark):
    cases = {"10-20": (10, 20), "10 to 20": (10, 20), "30+": (30, None), "46": (46, 46), "any": (None, None), "Level 46": (46, 46), "46+ (raid)": (46, None), "about 5 - 12, or 30": (5, 12), "a 7to9": (7, 9), "": (None, None)}
    assert run(spark, lambda c: F.struct(*X.parse_level(c)), list(cases)) == list(cases.values())


def test_numbers(spark):
    row = spark.range(1).select(X.copper_text(F.lit(1234)), X.copper_text(F.lit(0)), X.standing_label(F.lit(750)), X.standing_label(F.lit(-3000)), X.standing_label(F.lit(None).cast("int")), X.clamp(F.lit(9999))).first()
    assert tuple(row) == ("1p 2g", "0c", "Warmly", "Ready to Attack", None, 2000)


def test_sections(spark):
    text = "intro\n=One=\na\n\n== [[A|Two]] ===\n \n==Three==\n====== ======\nb"
    got = run(spark, X.sections, [text, "== A ==\n== B ==", "", None, "x\n" * 20_000 + "= end ="])
    shown = [[(s.section, s.level, s.title, list(s.lines)) for s in r] if r is not None else None for r in got]
    assert shown[0] == [(0, 0, "", ["intro"]), (1, 1, "One", ["a", ""]), (2, 2, "Two =", [" "]), (3, 2, "Three", []), (4, 6, "", ["b"])]
    assert shown[1:4] == [[(1, 2, "A", []), (2, 2, "B", [])], [], None]
    assert [(s[0], s[2], len(s[3])) for s in shown[4]] == [(0, "", 20_000), (1, "end", 0)]
