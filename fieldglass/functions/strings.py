"""Labels, names and codes as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def mapped(key: Column, table: dict[str, str]) -> Column:
    """The table's value; null for other keys."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def canonical(text: Column) -> Column:
    """Lower case, without punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\w\s]", ""), r"\s+", " "))


def normalize_team(text: Column, aliases: dict[str, str], unicode: bool = False) -> Column:
    """FN-STR-01: the alias of the canonical name, else the trimmed original. unicode: strip accents first (a pandas UDF)."""
    return F.coalesce(mapped(canonical(_decomposed(text) if unicode else text), aliases), F.trim(text))


def normalize_label(text: Column, aliases: dict[str, str], vocabulary: list[str]) -> Column:
    """FN-STR-02: alias or trimmed label if the vocabulary has it, else null."""
    label = F.coalesce(mapped(F.trim(text), aliases), F.trim(text))
    return F.when(label.isin(vocabulary), label)


def spaced_label(text: Column, aliases: dict[str, str]) -> Column:
    """FN-STR-04: underscores and hyphens as single spaces, then the alias, else the spaced text."""
    label = F.trim(F.regexp_replace(F.regexp_replace(text, "[_-]+", " "), r"\s+", " "))
    return F.coalesce(mapped(F.lower(label), aliases), label)


def slug(text: Column, joint: str = "-") -> Column:
    """FN-STR-05: runs of other characters as one joint, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", joint), f"^{joint}+|{joint}+$", "")


def personnel_code(text: Column, none: Column | None = None) -> Column:
    """FN-STR-06: '1 RB, 1 TE, 3 WR' as '11'. none: what a text with neither gives; by default '00'."""
    backs, ends = (F.regexp_extract(F.upper(text), rf"(\d)\s*{p}", 1) for p in ("RB", "TE"))
    code = F.concat(F.when(backs == "", "0").otherwise(backs), F.when(ends == "", "0").otherwise(ends))
    return code if none is None else F.when((backs == "") & (ends == ""), none).otherwise(code)


def infer_game_id(play_id: Column, season: Column, week: Column, home: Column, away: Column) -> Column:
    """FN-STR-08: the digits after a source prefix, else season, week and teams."""
    part = F.split(play_id, "-")
    found = F.get(part, F.lit(1))
    return F.when((F.size(part) >= 3) & found.rlike("^[0-9]+$"), found).otherwise(F.when(season.isNotNull() & week.isNotNull(), F.format_string("%d-W%02d-%s-%s", season, week, home, away)))


def percent(value: Column, digits: int = 0, signed: bool = False) -> Column:
    """FN-STR-12: half-even percent text."""
    rounded = F.bround(value.cast("decimal(20,10)") * 100, digits)
    text = F.format_string(f"%{'+' if signed else ''}.{digits}f%%", rounded.cast("double"))
    return text


def numbers_grounded(text: Column, allowed: Column) -> Column:
    """FN-STR-11: every 'x %' of the text is within 1 of an allowed value or of 100 times it."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*%"), 1), lambda x: x.cast("double"))
    known = F.flatten(F.transform(allowed, lambda v: F.array(F.rint(v), F.rint(v * 100))))
    return F.forall(found, lambda x: F.exists(known, lambda a: F.abs(a - x) <= 1))


def sentence_list(items: Column) -> Column:
    """FN-STR-13: 'a, b and c'."""
    head = F.array_join(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(1))), ", ")
    return F.when(F.size(items) == 0, "").when(F.size(items) == 1, F.get(items, 0)).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))
