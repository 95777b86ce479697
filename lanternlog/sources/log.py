"""The activity log as a source: lines with byte offsets, resumable reads, and the grammar that turns a line into an event.

A line is `[Fri Jul 31 18:38:02 2026] text`. What the game says is listed as templates with named slots; the first that fits
wins. A template's longest fixed part stands before its pattern as a gate, so most lines meet no regular expression. Templates
marked inferred follow examples only. Lines that are no event have a null type.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import COINS, log_timestamp

# What the game says. {name} is any text, {name#} a whole number, {name-} one with a sign, {name%} a decimal
# number, {name$} coins, {name!} a word, [...] may be missing, a run of spaces may be longer.
CRAFT_ERRORS = {
    "Sorry, but you don't have everything you need for this recipe in your general inventory.": "missing_materials",
    "The result of this combine would produce an unusable item.": "unusable_result",
    "You cannot combine these items in this container type!": "wrong_container",
}
LOOTED = "You looted [{qty#} ][a |an |the ]{item} from {source}'s corpse "
SAID: list[tuple[str, str, dict]] = [
    ("aa_gain", "You have gained an ability point!  You now have {balance_after#} ability point[s].", {"points": 1}),
    ("aa_spend", 'You have gained the ability "{ability}" at a cost of {points#} ability point[s].', {}),
    ("aa_spend", "You have improved {ability} at a cost of {points#} ability point[s].", {}),
    ("depot_deposit", "You have deposited {qty#} {item} to your personal depot.", {}),
    ("depot_withdraw", "You have taken {qty#} {item} from your personal depot.", {}),
    *(("craft_error", said, {"reason": reason}) for said, reason in CRAFT_ERRORS.items()),
    ("loot", LOOTED + "and sold it for {price}[.]", {}),
    ("loot", LOOTED + "to create [a |an |the ]{merged_into}[.]", {}),
    ("xp", "You gain [party ]experience (with a bonus)![ ({pct%}%)]", {"bonus": True}),
    ("damage_taken", "You have taken {amount#} damage from {spell} by {source}.", {"dmg_type": "dot"}),
    ("damage_taken", "You have taken {amount#} damage from {spell}.", {"dmg_type": "dot"}),
    ("achievement", "You have completed achievement: {name}", {}),
    ("upgrade", "You have successfully merged two items together to create a new item: {item}[.]", {}),
    # Inferred from examples.
    ("kill", "You have slain {target}!", {}),
    ("player_death", "You have been slain by {source}!", {}),
    ("zone", "You have entered {zone}.", {}),
    ("level_up", "You have gained a level! Welcome to level {level#}!", {}),
    ("skill", "You have become better at {skill}! ({level#})", {}),
    ("cast", "You begin casting {spell}.", {}),
    ("autoattack", "Auto attack is on.", {"ok": True}),
    ("autoattack", "Auto attack is off.", {"ok": False}),
    ("damage", "{target} has taken {amount#} damage from your {spell}.", {"attacker": "player", "dmg_type": "dot"}),
    ("damage_taken", "{source} {verb!} YOU for {amount#} point[s] of damage.", {"dmg_type": "melee"}),
    ("damage", "{target} is burned by {attacker}'s thorns for {amount#} point[s] of non-melee damage.", {"dmg_type": "ds", "ally": True}),
    ("damage", "You {verb!} {target} for {amount#} point[s] of damage.[ (Critical)]", {"attacker": "player", "dmg_type": "melee"}),
    ("miss", "{attacker} tries to {verb!} {target}, but misses!", {"ally": True}),
    ("xp", "You gain [party ]experience![ ({pct%}%)]", {"bonus": False}),
    ("loot", LOOTED + "and stored it in your tradeskill depot.", {}),
    ("coin", "--You have looted {price$} from {source}.--", {}),
    ("loot", "--You have looted [a |an |the ]{item} from {source}.--", {"qty": 1}),
    ("loot", "--You have looted [a |an |the ]{item}.--", {"qty": 1}),
    ("heal", "{source} healed you for {amount#} hit point[s] by {spell}.", {"target": "player"}),
    ("faction", "Your faction standing with {faction} has been adjusted by {delta-}.", {}),
    ("faction_capped", "Your faction standing with {faction} could not possibly get any {direction}.", {}),
    ("craft", "You have fashioned the items together to create something new: {item}.", {"ok": True}),
    ("craft", "You lacked the skills to fashion {item}.", {"ok": False}),
    ("craft_capped", "You can no longer advance your skill from making this item.", {}),
    ("depot_consume", "Consumed {qty#} x {item} (leaving {left_qty#}) from your personal depot.", {}),
]
FIELDS = {
    "item": "string", "base": "string", "source": "string", "qty": "long", "copper": "long", "merged_into": "string", "skill": "string", "level": "int",
    "ability": "string", "points": "int", "balance_after": "int", "tier": "int", "pct": "double", "bonus": "boolean", "zone": "string", "attacker": "string",
    "target": "string", "amount": "long", "dmg_type": "string", "spell": "string", "verb": "string", "faction": "string", "delta": "long", "direction": "string",
    "ok": "boolean", "reason": "string", "name": "string", "left_qty": "long", "ally": "boolean",
}
SLOT = {"": "(.+?)", "!": r"(\w+)", "#": "([0-9]+)", "-": "(-?[0-9]+)", "%": "([0-9.]+)", "$": "((?:[0-9]+ (?:platinum|gold|silver|copper)(?:, | and )?)+)"}
IDENTITY_BYTES = 512


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, offset, line, whole) of log files: lines numbered from 0, with the byte at which each begins.

    A file is read in splits, however long it is: a line's place in its split and the bytes before it are counted there, and
    only a count for each split is joined to them. `whole` tells that the line ends with a line feed; one that doesn't is still
    being written. A carriage return before the line feed is no part of the line, bytes that aren't UTF-8 become U+FFFD; empty
    lines are left out but counted. Files that end in a split without lines, and empty files, give no rows."""
    meta = {"path": "_metadata.file_path", "_size": "_metadata.file_size", "_start": "_metadata.file_block_start"}
    raw = spark.read.option("lineSep", "\n").text(path).select(*(F.col(c).alias(k) for k, c in meta.items()), F.col("value").alias("_raw"), (F.octet_length("value") + 1).cast("long").alias("_bytes"), F.monotonically_increasing_id().alias("_at"))
    split = W.partitionBy("path", "_start").orderBy("_at")
    lines = raw.withColumns({"_n": F.row_number().over(split), "_upto": F.sum("_bytes").over(split.rowsBetween(W.unboundedPreceding, 0))})
    # A row for each split: few for a file, so their running sums are small windows.
    splits = raw.groupBy("path", "_start").agg(F.count("*").alias("_lines"), F.sum("_bytes").alias("_sum"))
    before = W.partitionBy("path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select("path", "_start", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_first"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_from"))
    placed = lines.join(starts, ["path", "_start"])
    text = F.regexp_replace(F.make_valid_utf8("_raw"), "\r$", "")
    offset = F.col("_from") + F.col("_upto") - F.col("_bytes")
    out = placed.select("path", (F.col("_first") + F.col("_n") - 1).cast("long").alias("line_no"), offset.alias("offset"), text.alias("line"), (offset + F.col("_bytes") <= F.col("_size")).alias("whole"), F.col("_size").alias("size"), "_raw")
    return out.where("line <> ''").drop("_raw")


def log_identity(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, head) of log files: the SHA-256 of the first 512 bytes tells a file from another of the same name."""
    head = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("_start"), F.col("value").cast("binary").alias("_raw"), F.monotonically_increasing_id().alias("_at"))
    first = head.where("_start = 0").withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy("_at"))).where(F.col("_n") <= IDENTITY_BYTES)  # a line has a byte at least
    joined = first.groupBy("path", "size").agg(F.array_sort(F.collect_list(F.struct("_n", F.hex("_raw").alias("h")))).alias("_lines"))
    whole = F.rpad(F.array_join(F.transform("_lines", lambda x: F.concat(x.h, F.lit("0A"))), ""), 2 * IDENTITY_BYTES, "")
    return joined.select("path", "size", F.sha2(F.unhex(F.substring(whole, 1, F.least(F.lit(2 * IDENTITY_BYTES), F.col("size") * 2).cast("int"))), 256).alias("head"))


def resume_points(files: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(path, size, head, start, reset): where to read on. A file that is unknown, is another one by its head, or has become
    shorter than its checkpoint (path, head, offset) is read from the start. A head that was taken from a file of fewer than 512
    bytes counts as another's once the file grows, which rereads that file once."""
    old = checkpoints.select("path", F.col("head").alias("_head"), F.col("offset").alias("_offset"))
    same = (F.col("_head") == F.col("head")) & (F.col("_offset") <= F.col("size"))
    return files.join(old, "path", "left").select("path", "size", "head", F.when(same, F.col("_offset")).otherwise(0).alias("start"), (F.col("_offset").isNotNull() & ~F.coalesce(same, F.lit(False))).alias("reset"))


def new_lines(lines: DataFrame, points: DataFrame) -> DataFrame:
    """The whole lines of read_log from each file's resume point on; the line being written waits for the next read."""
    return lines.where("whole").join(points.select("path", "start", "head"), "path").where(F.col("offset") >= F.col("start"))


def next_checkpoints(lines: DataFrame, points: DataFrame) -> DataFrame:
    """(path, head, offset) after new_lines: the end of the last whole line, or where the file stood."""
    ends = lines.where("whole").groupBy("path").agg(F.max_by(F.struct("offset", F.octet_length("line").alias("n")), "offset").alias("last"), F.max("size").alias("size"))
    partial = lines.where("NOT whole").groupBy("path").agg(F.min("offset").alias("_partial"))
    end = F.coalesce("_partial", "size")
    return points.select("path", "head", "start").join(ends.select("path", "size"), "path", "left").join(partial, "path", "left").select("path", "head", F.coalesce(F.greatest("start", end), F.col("start")).cast("long").alias("offset"))


def first_times(lines: DataFrame) -> DataFrame:
    """(path, first_ts): the time of each file's first line that bears one."""
    stamped = lines.withColumn("_ts", log_timestamp(F.col("line"))).where("_ts IS NOT NULL")
    return stamped.groupBy("path").agg(F.min_by("_ts", "line_no").alias("first_ts"))


def backfill_lines(lines: DataFrame, points: DataFrame, needles: list[str]) -> DataFrame:
    """Whole lines before each file's resume point that hold one of the needles: what a new rule must read again."""
    gate = F.lit(False)
    for x in needles:
        gate = gate | F.col("line").contains(x)
    return lines.where("whole").where(gate).join(points.select("path", "start"), "path").where(F.col("offset") < F.col("start"))


def compile_template(said: str) -> tuple[str, str, list[str]]:
    """(gate, pattern, slots) of a template."""
    pattern, slots, fixed, depth = "", [], [""], 0
    for part in re.finditer(r"\{(\w+)([#%$!-]?)\}|[\[\]]|[^\[\]{}]+", said):
        text = part[0]
        if part[1]:
            pattern += SLOT[part[2]]
            slots.append(part[1])
            fixed.append("")
        elif text in "[]":
            pattern += "(?:" if text == "[" else ")?"
            depth += 1 if text == "[" else -1
            fixed.append("")
        else:
            pattern += re.sub(r"(?:\\? ){2,}", lambda _: r"\s+", re.escape(text)).replace(r"\|", "|")
            if not depth:
                fixed += text.split("  ")
    return max(fixed, key=len), f"^{pattern}$", slots


RULES = [(kind, *compile_template(said), fixed) for kind, said, fixed in SAID]
_COMPILED = [(kind, gate, re.compile(pattern), slots, fixed) for kind, gate, pattern, slots, fixed in RULES]
_INTS = {k for k, t in FIELDS.items() if t in ("int", "long")}
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
_PRICE, _WORTH = re.compile(r"([0-9]+) (platinum|gold|silver|copper)"), dict(COINS)


#: Candidate rules by a text's first characters; those that share them share the list.
_HEAD, _MOST_HEADS = 9, 20_000
_starts = [(rule, re.split(r"[\[{]", said)[0][:_HEAD]) for rule, (_, said, _) in zip(_COMPILED, SAID, strict=True)]
_candidates: dict[str, list] = {}


def candidates(text: str) -> list:
    """The rules, in order, whose fixed beginning agrees with a text's."""
    head = text[:_HEAD]
    found = _candidates.get(head)
    if found is None:
        if len(_candidates) >= _MOST_HEADS:
            _candidates.clear()
        found = _candidates[head] = [rule for rule, start in _starts if head.startswith(start) or start.startswith(head)]
    return found


def rule_of(text: str) -> tuple | None:
    """(kind, slots, fixed fields, match) of the first rule that fits what a line says."""
    for kind, gate, pattern, slots, fixed in candidates(text):
        if gate in text and (got := pattern.match(text)):
            return kind, slots, fixed, got
    return None


#: Bytes before what a line says: the stamp in brackets and a space.
_STAMP = 27


def said_of(line: str | None) -> str | None:
    """What a stamped line says, without white space at its end; None if it isn't one line with a stamp."""
    if not line or line[0] != "[" or line.find("]") != _STAMP - 2 or line[_STAMP - 1 : _STAMP] != " ":
        return None
    said = line[_STAMP:].rstrip()
    return None if "\n" in said else said


def event_of(line: str | None) -> dict | None:
    """Type and fields of one line, or None if it is no event."""
    said = said_of(line)
    found = rule_of(said) if said else None
    if not found:
        return None
    kind, slots, fixed, got = found
    e = {"type": kind}
    for k, v in zip(slots, got.groups(), strict=True):
        if v:
            e[k] = int(v) if k in _INTS else v
    e |= fixed
    if "price" in e:  # a price that can't be read counts as none
        e["copper"] = sum(int(n) * _WORTH[coin] for n, coin in _PRICE.findall(e.pop("price")))
    if kind == "loot":
        e.setdefault("qty", 1)
    elif kind == "xp":
        e["pct"] = float(e.get("pct", 0))
    elif kind == "damage_taken":
        e.setdefault("source", e.get("spell"))
    elif kind == "upgrade":
        tier = re.search(r"\s\+([0-9]+)$", e["item"])
        e["base"], e["tier"] = re.sub(r"\s\+[0-9]+$", "", e["item"]), int(tier[1]) if tier else None
    return e


def _type_of(line: str | None) -> str | None:
    said = said_of(line)
    found = rule_of(said) if said else None
    return found and found[0]


def event_columns(lines: list[str | None], kinds: Iterable[str]) -> dict[str, list]:
    """Values of the wanted fields for each of the lines; a field that no line has is left out."""
    kinds, columns = set(kinds), {}
    for i, line in enumerate(lines):
        for k, v in (event_of(line) or {}).items() if line else ():
            if k in kinds:
                if k not in columns:
                    columns[k] = [None] * len(lines)
                columns[k][i] = v
    return columns


def gate_of(line: Column, types: list[str] | None = None) -> Column:
    """Whether a line holds the longest fixed part of a rule, of all types or of some: what passes no gate is no such event."""
    gates = sorted({gate for kind, gate, *_ in RULES if types is None or kind in types})
    return F.coalesce(reduce(lambda x, y: x | y, (line.contains(g) for g in gates)), F.lit(False))


def parse_events(lines: DataFrame, line: str = "line", types: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """Adds ts, type and the event fields to every line; type is null for chat, null lines and anything else that is no event.
    `ally` marks events of others, which count only for members of a group: see keep_members.

    types and fields name what is wanted: other lines are left out, or other columns not made. Lines that pass no gate are told by
    built-in expressions; the others come to the grammar in Arrow batches, since as column expressions some forty templates with
    thirty fields outgrow what the planner compiles."""
    kinds = {"type": "string"} | {k: t for k, t in FIELDS.items() if fields is None or k in fields}

    @F.arrow_udf("string")
    def typed(said: pa.Array) -> pa.Array:
        return pa.array([_type_of(x) for x in said.to_pylist()], pa.string())

    @F.arrow_udf(", ".join(f"{k} {t}" for k, t in kinds.items()))
    def parsed(said: pa.Array) -> pa.Array:
        found = event_columns(said.to_pylist(), kinds)
        made = [pa.array(found[k], _ARROW[t]) if k in found else pa.nulls(len(said), _ARROW[t]) for k, t in kinds.items()]
        return pa.StructArray.from_arrays(made, list(kinds))

    # A filter on what the grammar finds must not be pushed below it, as lines would be parsed for the filter and once more for
    # the columns; past an expression that may vary Spark pushes none.
    parse = (typed if len(kinds) == 1 else parsed).asNondeterministic()
    own = ("ts", "type", *FIELDS)
    kept = [c for c in lines.columns if c not in own]
    said = F.when(gate_of(F.col(line), types), F.col(line))
    out = lines.select(*kept, log_timestamp(F.col(line)).alias("ts"), parse(said).alias("_e"))
    out = out.withColumnRenamed("_e", "type") if len(kinds) == 1 else out.select("*", "_e.*").drop("_e")
    return out if types is None else out.where(F.col("type").isin(types))


def keep_members(events: DataFrame, roster: DataFrame) -> DataFrame:
    """Events of others only where the attacker is in the roster (name); for strangers the line is no event."""
    members = roster.select(F.col("name").alias("_member")).distinct()
    joined = events.join(members, (F.col("attacker") == F.col("_member")) & F.col("ally"), "left")
    known = F.coalesce(~F.col("ally"), F.lit(True)) | F.col("_member").isNotNull()
    return joined.withColumn("type", F.when(known, F.col("type"))).drop("_member")
