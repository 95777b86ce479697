"""Sinks: replace-all tables, export files and the rows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that df has rows for (one character's snapshot, say)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def export_view(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Columns under their labels; times as `yyyy-MM-dd HH:mm:ss`, flags as yes and no."""
    kinds = dict(df.dtypes)

    def shown(c: str):
        if kinds[c].startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return F.when(F.col(c), "yes").when(~F.col(c), "no") if kinds[c] == "boolean" else F.col(c)

    return df.select(*(shown(c).alias(label) for c, label in labels.items()))


# The columns of each export view under their labels, in order.
VIEWS = {
    "inventory": {"location": "Location", "name": "Item", "count": "Count", "item_id": "ID", "section": "Section", "host_name": "In / on", "upgrade_tier": "Tier", "is_exaltation": "Exaltation", "is_equipped": "Worn", "in_item_db": "In item DB"},
    "merges": {"ts": "When", "item": "Result", "tier": "Tier"},
    "recipes": {"item": "Recipe", "skill": "Skill (inferred)", "made": "Made", "failed": "Failed", "attempts": "Attempts", "rate": "Rate %", "capped": "Capped", "known": "In recipes file", "last_ts": "Last"},
    "materials": {"item": "Material", "used": "Used", "consumes": "Combines", "deposited": "Deposited", "withdrawn": "Withdrawn", "last_left": 'Last "leaving"', "est_depot": "In depot (est.)", "on_hand": "On hand (dump)", "last_used_ts": "Last used"},
    "known_recipes": {"skill": "Skill", "recipe_id": "Recipe ID", "name": "Recipe", "made": "Made", "attempts": "Attempts", "last_ts": "Last made"},
    "factions": {"faction": "Faction", "standing": "Standing (file)", "standing_label": "Band", "to_max": "To max", "est_now": "Est. now", "delta": "Net (log)", "events": "Changes", "gained": "Gained", "lost": "Lost", "capped": "Capped", "first_ts": "First", "last_ts": "Last"},
    "fights": {"start": "Start", "name": "Fight", "duration": "Duration s", "dps": "DPS", "total_damage": "Damage", "total_healing": "Healing", "total_tanking": "Taken", "xp": "XP %", "coin": "Coin (copper)"},
    "loot": {"item": "Item", "count": "Drops", "qty": "Quantity", "top_source": "Most from", "top_zone": "In zone", "top_n": "Times", "first_ts": "First", "last_ts": "Last", "in_item_db": "In item DB"},
    "sessions": {
        "started_at": "Started", "last_ts": "Last line", "hours": "Active hours", "xp_pct": "XP %", "xp_per_hour": "XP % per hour", "kills": "Kills", "kills_per_hour": "Kills per hour", "deaths": "Deaths", "income_copper": "Income (copper)",
        "coin_copper": "Coin", "autosell_copper": "Auto-sold", "vendor_copper": "Merchant", "dmg_dealt": "Damage dealt", "dmg_taken": "Damage taken", "healed": "Healing received", "accuracy": "Accuracy %", "crit_rate": "Crit %", "loot": "Loot",
        "crafts_ok": "Combines made", "crafts_fail": "Combines failed", "faction_hits": "Faction hits", "skill_ups": "Skill-ups", "aa_gained": "AA gained", "levels": "Levels", "level_end": "Level at end", "zones": "Zone changes", "first_zone": "First zone", "last_zone": "Last zone",
    },
    "achievements": {"name": "Achievement", "group": "Group", "sub": "Category", "points": "Points", "earned": "Earned", "ts": "Earned on", "progress": "Requirements met", "reqs": "Requirements", "in_wiki": "On the wiki"},
    "skyquests": {"cls": "Class", "name": "Test", "status": "Status", "source": "Source", "reward": "Reward", "reward_owned": "Reward owned", "rune": "Rune", "rune_have": "Rune have", "items": "Quest items (have/need)", "missing": "Missing", "ready": "Ready", "covered": "Turn in now", "giver": "Quest giver", "phrase": "Say"},
    "zones": {"zone": "Zone", "hours": "Active hours", "xp_pct": "XP %", "xp_per_hour": "XP % per hour", "kills": "Kills", "kills_per_hour": "Kills per hour", "loot": "Loot", "visits": "Visits", "first_ts": "First", "last_ts": "Last"},
}


def export_named(df: DataFrame, view: str) -> DataFrame:
    """One of the VIEWS of df: its columns under their labels in order; a column that df lacks is empty, others are left out. An
    unknown view raises KeyError."""
    columns = VIEWS[view]
    return export_view(df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns}), columns)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts that begin with a byte-order mark, with labels as header, CRLF line ends, minimal quoting and nulls as empty
    fields. The mark stands before the first label, which is where each part begins."""
    first = df.columns[0]
    df.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").options(header=True, lineSep="\r\n", nullValue="", emptyValue="", encoding="UTF-8").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
