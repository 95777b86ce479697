"""Whole pages as rows: achievements in nested tables, quests, class tests, HTML tooltips and result lists.

Marks that nest are read by small helpers in Arrow batches, a page at a time; what they find is told apart by columns where
its form allows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LABEL, MARKUP, TARGET, effect_family, effect_tier, normalize_name, parse_level, slug, split_names, strip_markup


_MARKUP = [(re.compile(pattern.replace(r"\x{A0}", "\xa0")), put.replace("$1", r"\1")) for pattern, put in MARKUP]
LINK = re.compile(rf"\[\[({TARGET})(?:\|({LABEL}))?\]\]")
LIST_ITEM = re.compile(r"<li\b[^>]*>(.*?)</li>", re.DOTALL)
TABLE_MARK = re.compile(r"^(?:\{\|.*|\|\}\s*)$", re.MULTILINE)


def plain(text: str | None) -> str:
    """strip_markup of one text."""
    text = text or ""
    for pattern, put in _MARKUP:
        text = pattern.sub(put, text)
    return text.strip()


def of_pages(function: Callable[[str], object], kind: str) -> Callable[[Column], Column]:
    """A column function that reads each page by a helper; a null page counts as empty."""

    @F.pandas_udf(kind)
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([function(t or "") for t in texts], dtype=object)

    return read


# ---- achievements -------------------------------------------------------------------------------------------------------

# What a page of achievements says.
COLLAPSES, POINTS, NOTES = 'title="Expand or collapse ', r"(\d+)\s*Points?\b", re.compile(r"'''\s*Notes\s*'''")
NOTE_WORDS = ("autocomplete", "bypassed", "unlock token")
ACHIEVEMENTS = "array<struct<name:string,group:string,sub:string,points:int,desc:string,reqs:array<struct<text:string,link:string>>,notes:array<string>>>"


def achievements_of(text: str) -> list[dict]:
    """Achievements of a page in order. Tables nest; one without tables inside and with a title is an achievement, its group the
    first title around it and its sub the last. Its list entries are requirements, those after a Notes label or, without one,
    those that speak of tokens and bypasses are notes. What stands below a Template heading, and tables with neither points nor
    requirements, are left out."""
    text = re.split(r"(?m)^==\s*Template\s*==\s*$", text, maxsplit=1)[0]
    marks = list(TABLE_MARK.finditer(text))
    ends = [m.start() for m in marks[1:]] + [len(text)]
    titles, out = [], []
    for k, mark in enumerate(marks):
        if mark[0].startswith("{|"):
            head = text[mark.end() : ends[k]]
            titles.append(head.split(COLLAPSES, 1)[1].split('"', 1)[0].strip() if COLLAPSES in head else None)
            continue
        if not titles:
            continue
        name = titles.pop()
        if name and marks[k - 1][0].startswith("{|"):  # nothing was opened since: a leaf
            found = _achievement(name, [t for t in titles if t], text[marks[k - 1].end() : mark.start()])
            out += [found] if found["reqs"] or found["points"] is not None else []
    return out


def _achievement(name: str, around: list[str], body: str) -> dict:
    points = re.search(POINTS, body)
    shown = body[max(0, body.find("\n|-")) :]
    before, *after = NOTES.split(shown, maxsplit=1)
    clean = lambda s: plain(s.replace("☐", ""))
    reqs, notes = [], []
    for entry in LIST_ITEM.findall(before):
        link, said = LINK.search(entry), clean(entry)
        if not after and any(w in said.lower() for w in NOTE_WORDS):
            notes.append(said)
        elif said:
            reqs.append({"text": said, "link": link[1].strip() if link else None})
    notes += filter(None, map(clean, LIST_ITEM.findall(after[0] if after else "")))
    bold = next((clean(x) for x in shown.split("\n") if x.strip().startswith("'''") and "Requirements" not in x), "")
    return {"name": name, "group": around[0] if around else "", "sub": around[-1] if around else "", "points": int(points[1]) if points else None, "desc": bold if bold != name else "", "reqs": reqs, "notes": notes}


def achievements(pages: DataFrame, text: str) -> DataFrame:
    """A row for each achievement of a page: pos, key, name, group, sub, points, desc, reqs, notes and unlock (kind, name), null
    for names that unlock nothing."""
    rows = pages.select(*pages.columns, F.posexplode(of_pages(achievements_of, ACHIEVEMENTS)(F.col(text))).alias("pos", "_a")).select(*pages.columns, "pos", "_a.*")
    unlocks = r"(?i)^(?:Primary\s+)?(Race|Class|Deity)\s+Unlock\s*[-—–]\s*(.+)$"
    unlock = F.struct(F.lower(F.regexp_extract("name", unlocks, 1)).alias("kind"), F.trim(F.regexp_extract("name", unlocks, 2)).alias("name"))
    return rows.withColumn("key", slug(F.translate("name", "—–", "--"))).withColumn("unlock", F.when(F.col("name").rlike(unlocks), unlock))


# ---- quests -------------------------------------------------------------------------------------------------------------

MOST_STEPS = 80
#: Headings that say nothing of a step, and those whose entries are no steps.
PLAIN_HEADINGS, REWARDS = ("checklist", "walkthrough", "steps"), ("reward", "rewards")
#: Beginnings of lines that are no prose.
NO_PROSE = (":", ";", "{", "<", "[[Category", "[[File", "[[file", "__", "|", "!", "*", "#")
QUEST = "array<struct<has_top_table:boolean,fields:map<string,string>,steps:array<string>,mentions:array<string>>>"


def _lines(body: str) -> Iterator[tuple[str | None, str]]:
    """(heading, line) of a page's lines: the heading is that of a heading line itself, else null."""
    for line in body.split("\n"):
        s = line.strip()
        lead, trail = len(s) - len(s.lstrip("=")), len(s) - len(s.rstrip("="))
        level = max(0, min(6, lead, trail, (len(s) - 1) // 2))
        yield (plain(s[level : len(s) - level]) if level else None), s


def _links(text: str) -> list[str]:
    return list(dict.fromkeys(t for m in LINK.finditer(text) if (t := m[1].strip()) and ":" not in t))


def quest_of(text: str) -> dict:
    """A quest page's top table as fields, its steps, and the links of its body that its table doesn't hold.

    Steps are list entries, after their heading unless that is a plain one; entries under rewards and lines on standings are
    none. A page without any takes the lines of prose, 25 characters or more, before the first heading and under walkthroughs,
    without speech."""
    text = re.sub(r"(?s)<!--.*?-->", "", text)
    top = re.search(r'(?s)\{\|\s*class="[^"]*questTopTable.*?\|\}', text)
    body, fields, header = text, {}, []
    if top:
        body, key = text[: top.start()] + text[top.end() :], None
        for s in map(str.strip, top[0].split("\n")):
            if s.startswith("!"):
                key = plain(s[1:]).rstrip(":").strip().lower()
            elif key and re.match(r"\|(?![-}])", s):
                fields[key] = plain(s[1:])
                header.append(s)
                key = None
    steps, prose, heading = [], [], ""
    for title, s in _lines(body):
        if title is not None:
            heading = title
        elif s.startswith(("*", "#")):
            said = plain(s.lstrip("*# "))
            if said and heading.lower() not in REWARDS and not said.lower().startswith("your faction standing"):
                steps.append(f"{heading} — {said}" if heading and heading.lower() not in PLAIN_HEADINGS else said)
        elif s and not s.startswith(NO_PROSE) and (not heading or "walkthrough" in heading.lower()):
            said = plain(s)
            if len(said) >= 25 and not re.search(r"says?\s*,?\s*'", s):
                prose.append(said)
    known = {t for cell in header for t in _links(cell)}
    return {"has_top_table": bool(top), "fields": fields, "steps": (steps or prose)[:MOST_STEPS], "mentions": [t for t in _links(body) if t not in known]}


def quests(pages: DataFrame, text: str) -> DataFrame:
    """Adds has_top_table, start_zone, giver, level_min, level_max, classes, races, steps and mentions to pages of quests."""
    rows = pages.withColumn("_q", of_pages(lambda t: [quest_of(t)], QUEST)(F.col(text))[0])
    keys = F.map_keys("_q.fields")
    field = lambda word: F.col("_q.fields")[F.try_element_at(F.filter(keys, lambda k: k.contains(word)), F.lit(-1))]
    names = lambda word: F.coalesce(F.when(F.lower(field(word)) == "all", F.array(F.lit("All"))).otherwise(split_names(field(word))), F.array().cast("array<string>"))
    low, high = parse_level(field("level"))
    return rows.select(*pages.columns, "_q.has_top_table", F.nullif(field("start zone"), F.lit("")).alias("start_zone"), F.nullif(field("giver"), F.lit("")).alias("giver"), low.alias("level_min"), high.alias("level_max"), names("class").alias("classes"), names("race").alias("races"), "_q.steps", "_q.mentions")


# ---- class tests --------------------------------------------------------------------------------------------------------

NEED = "struct<name:string,display:string,src:string,no_drop:boolean>"
TESTS = f"array<struct<cls:string,giver:string,name:string,phrase:string,reward:string,runes:array<{NEED}>,items:array<{NEED}>>>"
LEAST_TESTS = 60


def needs_of(cell: str) -> list[dict]:
    """What a cell asks for: the first link of each list entry, or of a cell without a list; a mark in brackets at an entry's end
    tells the source, its wrapper whether it can't be traded."""
    out = []
    for entry in LIST_ITEM.findall(cell) or [cell]:
        if link := LINK.search(entry):
            tail = re.sub(r"<[^>]+>|\}\}|'''", "", entry[link.end() :]).strip()
            src = re.search(r"\(([^()]+)\)$", tail)
            out.append({"name": link[1].strip(), "display": (link[2] or "").strip() or link[1].strip(), "src": src[1].strip() if src else None, "no_drop": "SkyNoDrop" in entry})
    return out


def tests_of(text: str, section: str) -> list[dict]:
    """Class tests of a page in order: in the level-2 section of that name, each level-3 `[[class]] Tests` heading has a giver and a
    table of reward, quest, phrase, runes and items. Rows with fewer cells are skipped."""
    out, level2, cls, body = [], "", None, []

    def end() -> None:
        if cls:
            out.extend(_tests(cls, "\n".join(body)))

    for line in [*text.split("\n"), "== =="]:
        mark = re.match(r"(=+)", line)
        if mark and len(mark[1]) <= 3:
            end()
            cls, body = None, []
            if len(mark[1]) < 3:
                level2 = plain(line.strip().strip("=")) if len(mark[1]) == 2 else ""
            elif level2 == section and (link := re.match(rf"===\s*{LINK.pattern}\s*Tests\s*===", line)):
                cls = link[1].strip()
        elif cls:
            body.append(line)
    return out


def _tests(cls: str, body: str) -> list[dict]:
    giver = re.search(rf"'''\s*Quest Giver:?\s*'''\s*\[\[({TARGET})", body)
    table = re.search(r"(?ms)^\{\|.*?\n(.*?)^\|\}", body)
    out = []
    for row in re.split(r"(?m)^\|-.*$", table[1] if table else ""):
        if row.lstrip().startswith("!"):
            continue
        cells = [c for c in re.split(r"(?m)^\|(?![-}])", row) if c.strip()]
        if len(cells) < 5:
            continue
        reward = re.search(r"\{\{:([^}|]+)\}\}", cells[0]) or LINK.search(cells[0])
        found = {"cls": cls, "giver": giver[1].strip() if giver else None, "name": plain(cells[1]), "phrase": plain(cells[2]), "reward": reward[1].strip() if reward else plain(cells[0]), "runes": needs_of(cells[3]), "items": needs_of(cells[4])}
        out += [found] if found["name"] and found["reward"] else []
    return out


def class_tests(pages: DataFrame, text: str, section: str) -> DataFrame:
    """A row for each class test of a page: pos, key, cls, giver, name, phrase, reward, reward_norm, runes and items."""
    read = of_pages(lambda t: tests_of(t, section), TESTS)
    rows = pages.select(*pages.columns, F.posexplode(read(F.col(text))).alias("pos", "_t")).select(*pages.columns, "pos", "_t.*")
    return rows.withColumn("key", slug(F.col("name"))).withColumn("reward_norm", normalize_name(F.col("reward")))


def whole_tests(synced: DataFrame, bundled: DataFrame, classes: tuple[str, ...], least: int = LEAST_TESTS) -> DataFrame:
    """The synced tests if they are whole, else the bundled ones: at least so many, of every class and no other, each key once, and
    every test with runes and items. One row of counts decides, so it can be broadcast."""
    wrong = (F.size("runes") == 0) | (F.size("items") == 0)
    told = synced.agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.array_sort(F.collect_set("cls")).alias("classes"), F.count_if(wrong).alias("wrong"))
    known = F.array(*map(F.lit, sorted(classes)))
    whole = told.select(((F.col("n") >= least) & (F.col("n") == F.col("keys")) & (F.col("classes") == known) & (F.col("wrong") == 0)).alias("_whole"))
    columns = [c for c in synced.columns if c in bundled.columns]
    take = lambda rows, yes: rows.select(columns).join(F.broadcast(whole), F.col("_whole") == F.lit(yes)).drop("_whole")
    return take(synced, True).unionByName(take(bundled, False))


# ---- HTML ---------------------------------------------------------------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Elements(HTMLParser):
    """Every element of a page when it ends, as (tag, own marks, marks of all around it, text); marks are ids and classes in lower
    case. An end without a beginning is passed over, and one that skips open elements ends them."""

    def __init__(self):
        super().__init__()
        self.open: list[tuple[str, str, list[str]]] = []
        self.found: list[tuple[str, str, tuple[tuple[str, str], ...], str]] = []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            had = dict(attrs)
            self.open.append((tag, f"{had.get('id') or ''} {had.get('class') or ''}".lower(), []))

    def handle_endtag(self, tag):
        while any(t == tag for t, _, _ in self.open):
            self._end()
            if self.ended == tag:
                break

    def _end(self):
        self.ended, marks, text = self.open.pop()
        said = "".join(text)
        if self.open:
            self.open[-1][2].append(said)
        self.found.append((self.ended, marks, tuple((t, m) for t, m, _ in self.open), " ".join(said.split())))

    def handle_data(self, data):
        if self.open:
            self.open[-1][2].append(data)


def elements(html: str) -> list[tuple[str, str, tuple[tuple[str, str], ...], str]]:
    reader = Elements()
    reader.feed(html)
    reader.close()
    while reader.open:
        reader._end()
    return reader.found


TOOLTIP = "array<struct<name:string,flags:string,lines:array<string>>>"


def tooltip_of(html: str) -> dict:
    """Name, flags and lines of a page's tooltip card; the first heading names the item, else the card's title."""
    found = elements(html)
    card = lambda around: any(t == "aside" and "tooltip-card" in m for t, m in around)
    first = lambda rows: next(filter(None, rows), "")
    part = lambda name: first(s for t, m, around, s in found if t == "p" and name in m and card(around))
    lines = [s for t, _, around, s in found if t == "li" and s and card(around) and any(u == "ul" and "tooltip-lines" in m for u, m in around)]
    return {"name": first(s for t, _, _, s in found if t == "h1") or part("tooltip-title"), "flags": part("tooltip-flags"), "lines": lines}


def result_rows_of(html: str) -> list[str]:
    """Texts of the outermost list entries and table rows inside anything marked as results, in page order."""
    is_row = lambda t, m: t in ("li", "tr")
    return [s for t, m, around, s in elements(html) if s and is_row(t, m) and any("results" in x for _, x in around) and not any(is_row(u, x) and any("results" in y for _, y in around[:k]) for k, (u, x) in enumerate(around))]


def result_rows(pages: DataFrame, html: str) -> DataFrame:
    """(pos, name, description) of a page's result rows; a dash between spaces parts them."""
    rows = pages.select(*pages.columns, F.posexplode(of_pages(result_rows_of, "array<string>")(F.col(html))).alias("pos", "_row"))
    parted = r"^(.+?)\s+[—–-]\s+(.+)$"
    has = F.col("_row").rlike(parted)
    return rows.select(*pages.columns, "pos", F.when(has, F.trim(F.regexp_extract("_row", parted, 1))).otherwise(F.col("_row")).alias("name"), F.when(has, F.regexp_extract("_row", parted, 2)).alias("description"))


# Numbers that a tooltip's lines name.
STATS, RESISTS = ("STR", "STA", "AGI", "DEX", "WIS", "INT", "CHA", "HP", "MANA", "END"), ("FIRE", "COLD", "MAGIC", "POISON", "DISEASE")
LABELLED = ("slot", "skill", "atk delay", "backstab dmg", "dmg", "ac", "haste", "wt", "class", "race", "focus effect", "effect", "drops from")


def tooltips(pages: DataFrame, html: str) -> DataFrame:
    """Adds name, flags, magic, lore, no_drop, slot, skill, delay, dmg, ac, haste, wt, size, class, race, hp, mana, stats, resists, effects,
    drops (zone, mob), lines and attributes, their number, out of a page's tooltip. Lines go by their labels, later ones win; a
    line without a label may hold numbers by name. Effects of combat are procs, of `worn` worn, others clicks."""
    rows = pages.withColumn("_t", of_pages(lambda t: [tooltip_of(t)], TOOLTIP)(F.col(html))[0])
    labels = "|".join(LABELLED)
    marked = F.transform("_t.lines", lambda x: F.struct(F.lower(F.regexp_extract(x, rf"(?i)^({labels}):", 1)).alias("label"), F.trim(F.regexp_replace(x, rf"(?i)^(?:{labels}):", "")).alias("rest"), x.alias("line")))
    rows = rows.withColumn("_m", marked)
    of = lambda *names: F.filter("_m", lambda x: x.label.isin(*names))
    last = lambda *names: F.try_element_at(of(*names), F.lit(-1)).rest
    whole = lambda c: F.regexp_extract(c, r"[+-]?\d+", 0).try_cast("int")
    delay = F.regexp_extract(F.try_element_at(F.filter(of("skill", "atk delay"), lambda x: x.line.rlike(r"(?i)Atk\s+Delay:\s*\d")), F.lit(-1)).line, r"(?i)Atk\s+Delay:\s*(\d+)", 1).try_cast("int")
    weight = F.try_element_at(F.filter(of("wt"), lambda x: x.rest.rlike(r"^[\d.]+")), F.lit(-1)).rest
    free = F.transform(of(""), lambda x: x.line)
    numbers = lambda names, lead: F.flatten(F.transform(free, lambda x: F.arrays_zip(F.regexp_extract_all(x, F.lit(rf"\b{lead}({names})\b:\s*([+-]?\d+)"), F.lit(1)).alias("k"), F.regexp_extract_all(x, F.lit(rf"\b{lead}({names})\b:\s*([+-]?\d+)"), F.lit(2)).alias("v"))))
    named = rows.withColumn("_stats", numbers("|".join(STATS), "")).withColumn("_resists", numbers("[A-Z]+", "SV "))

    def table(pairs: str, but: tuple[str, ...] = ()) -> Column:
        keys = F.array_distinct(F.transform(F.filter(pairs, lambda p: ~p.k.isin(*but, "")), lambda p: p.k))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.filter(pairs, lambda p: p.k == k), F.lit(-1)).v.cast("int")))

    number = lambda k: F.try_element_at(F.filter("_stats", lambda p: p.k == k), F.lit(-1)).v.cast("int")

    def effect(x: Column) -> Column:
        words = F.lower(F.regexp_extract(x.rest, r"\(([^)]*)\)", 1))
        name = F.trim(F.when(x.label == "focus effect", x.rest).otherwise(F.regexp_replace(x.rest, r"(?i)\s*(\(.*|at Level\s*\d+\s*)$", "")))
        kind = F.when(x.label == "focus effect", "focus").when(words.contains("combat"), "proc").when(words.contains("worn"), "worn").otherwise("click")
        return F.struct(kind.alias("type"), name.alias("name"), effect_family(name).alias("family"), effect_tier(name).alias("tier"), x.line.alias("raw"))

    def drops(x: Column) -> Column:
        zone, mobs = F.regexp_extract(x.rest, r"^(.*?): ", 1), F.regexp_replace(x.rest, r"^.*?: ", "")
        each = F.transform(F.filter(F.split(mobs, ", "), lambda m: F.trim(m) != ""), lambda m: F.struct(F.trim(zone).alias("zone"), F.trim(m).alias("mob")))
        return F.when(x.rest.contains(": "), each).when(x.rest != "", F.array(F.struct(x.rest.alias("zone"), F.lit("").alias("mob")))).otherwise(F.array().cast("array<struct<zone:string,mob:string>>"))

    flags, upper = F.col("_t.flags"), F.upper("_t.flags")
    effects = F.filter(F.transform(of("effect", "focus effect"), effect), lambda e: e["name"] != "")
    counted = F.filter("_m", lambda x: x.label.isin("slot", "skill", "dmg", "ac", "haste", "class", "race", "drops from") | ((x.label == "atk delay") & x.rest.rlike(r"\d")) | ((x.label == "") & x.line.rlike(rf"\b(SV [A-Z]+|{'|'.join(STATS)})\b:\s*[+-]?\d")))
    return named.select(
        *pages.columns, F.col("_t.name").alias("name"), F.filter(F.transform(F.split(flags, "·"), lambda x: F.trim(x)), lambda x: x != "").alias("flags"), upper.contains("MAGIC ITEM").alias("magic"), upper.contains("LORE ITEM").alias("lore"), upper.rlike("NO ?DROP").alias("no_drop"),
        last("slot").alias("slot"), F.nullif(F.trim(F.regexp_replace(last("skill"), r"(?i)Atk\s+Delay:.*$", "")), F.lit("")).alias("skill"), delay.alias("delay"), whole(last("dmg")).alias("dmg"), whole(last("ac")).alias("ac"), whole(last("haste")).alias("haste"),
        F.regexp_extract(weight, r"^([\d.]+)", 1).try_cast("double").alias("wt"), F.nullif(F.regexp_extract(weight, r"(?i)Size:\s*(\S+)", 1), F.lit("")).alias("size"), last("class").alias("class"), last("race").alias("race"), number("HP").alias("hp"), number("MANA").alias("mana"),
        table("_stats", ("HP", "MANA")).alias("stats"), table("_resists").alias("resists"), effects.alias("effects"), F.flatten(F.transform(of("drops from"), drops)).alias("drops"), F.col("_t.lines").alias("lines"), (F.size(counted) + F.size(effects)).alias("attributes"))


# ---- guides -------------------------------------------------------------------------------------------------------------

# What the icons of a guide's rating columns mean.
RATINGS = (("lightbluecircle", "efficient"), ("goldcircle", "inefficient"), ("lightpinkcircle", "not recommended"), ("orangering", "situational"))


def stat_caps(sections: DataFrame) -> DataFrame:
    """(stat, cap) rows of sections (title, lines) whose title ends in a stat's sign: hard caps under the stat's name, soft ones under
    the name with `_soft`. Other columns stay."""
    sign, body = F.lower(F.regexp_extract("title", r"\(([A-Z]{2,4})\)\s*$", 1)), F.array_join("lines", "\n")
    of = lambda pattern: F.regexp_extract(body, pattern, 1).try_cast("int")
    caps = F.array(F.struct(sign.alias("stat"), of(r"(?i)Max\s*\(hard-?cap\)\s*:\s*(\d+)").alias("cap")), F.struct(F.concat(sign, F.lit("_soft")).alias("stat"), of(r"(?i)Soft-?cap\s*:\s*(\d+)").alias("cap")))
    kept = [c for c in sections.columns if c not in ("title", "lines")]
    return sections.where(sign != "").select(*kept, F.explode(F.filter(caps, lambda c: c.cap.isNotNull())).alias("_c")).select(*kept, "_c.*")


def zone_ratings(tables: DataFrame) -> DataFrame:
    """Rows of guide tables (headers, rows) whose first header names zones: zone, level_min, level_max, zem (a number that the row defines) and ratings, a map from the
    level of a column whose header is a number to what its icon means. Other columns stay."""
    heads = F.transform("headers", strip_markup)
    kept = [c for c in tables.columns if c not in ("headers", "rows")]
    guide = tables.withColumn("_h", heads).where(F.lower(F.try_element_at("_h", F.lit(1))).contains("zone"))
    rows = guide.select(*kept, "_h", F.posexplode("rows").alias("pos", "_cells"))
    at = F.filter(F.transform("_h", lambda h, i: F.when(F.lower(h).rlike("lvl|level"), i + 1)), lambda i: i.isNotNull())
    span = F.regexp_extract_all(F.try_element_at("_cells", F.try_element_at(at, F.lit(1))), F.lit(r"(\d+)"), F.lit(1))
    icon = lambda c: F.regexp_extract(c, r"(?i)file:\s*([A-Za-z]+)\.png", 1)

    def meaning(c: Column) -> Column:
        out = icon(c)
        for name, means in RATINGS:
            out = F.when(F.lower(icon(c)) == name, means).otherwise(out)
        return out

    rated = F.filter(F.transform("_h", lambda h, i: F.struct(h.alias("level"), meaning(F.try_element_at("_cells", i + 1)).alias("means"))), lambda x: x.level.rlike(r"^\d+$") & (F.coalesce(x.means, F.lit("")) != ""))
    zone = strip_markup(F.try_element_at("_cells", F.lit(1)))
    zem = F.regexp_extract(F.array_join("_cells", " "), r"(?i)\{\{#vardefine:zem\|\s*(\d+)\s*\}\}", 1).try_cast("int")
    out = rows.select(*kept, "pos", zone.alias("zone"), F.try_element_at(span, F.lit(1)).cast("int").alias("level_min"), F.try_element_at(span, F.lit(-1)).cast("int").alias("level_max"), zem.alias("zem"), F.map_from_entries(rated).alias("ratings"))
    return out.where(F.col("zone") != "")
