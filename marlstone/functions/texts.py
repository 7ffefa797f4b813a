"""Text functions: names, addresses, codes, clauses, fixed layouts and exact decimals."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import first_match


def entity_name(name: Column, suffixes: tuple[str, ...] = ("아파트", "apartments?", "apts?")) -> Column:
    """Lower case without bracketed parts, punctuation, white space, and one suffix at the end."""
    plain = F.regexp_replace(F.lower(name), r"\([^)]*\)|\[[^\]]*\]", "")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}]", "")
    return F.regexp_replace(plain, f"(?:{'|'.join(suffixes)})$", "")


def phase_name(name: Column) -> Column:
    """entity_name() after roman phase numbers and company marks have become digits and nothing."""
    plain = F.translate(name, "ⅠⅡⅢⅣⅤⅥ㈜", "123456")
    return entity_name(F.regexp_replace(plain, r"\(주\)|주식회사", ""))


def short_key(name: Column, words: tuple[str, ...]) -> Column:
    """A name without white space and the given words, such as a school's level."""
    return F.regexp_replace(F.regexp_replace(name, r"\s+", ""), "|".join(words), "")


def alias_name(name: Column, aliases: dict[str, str]) -> Column:
    """entity_name() with brand names brought to one form."""
    out = entity_name(name)
    for old, new in aliases.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def ordinals(name: Column, unit: str = "차|단지") -> Column:
    """The numbers that stand before a unit, as text."""
    return F.regexp_extract_all(name, F.lit(rf"(\d+)\s*(?:{unit})"), 1)


def ordinal_conflict(one: Column, two: Column, unit: str = "차|단지") -> Column:
    """Both names have ordinals, and none in common."""
    a, b = ordinals(one, unit), ordinals(two, unit)
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def lot_key(lot: Column) -> Column:
    """'123-4' to '01230004': main and sub number in four digits each; null if there is no number."""
    main, sub = F.regexp_extract(lot, r"^\s*산?\s*(\d+)", 1), F.regexp_extract(lot, r"^\s*산?\s*\d+\s*-\s*(\d+)", 1)
    return F.when(main != "", F.concat(F.lpad(main, 4, "0"), F.lpad(F.when(sub == "", "0").otherwise(sub), 4, "0")))


def decimal_text(value: Column, scale: int = 6) -> Column:
    """The canonical text of an exact decimal: no trailing zeros, no trailing point."""
    text = value.cast(f"decimal(18,{scale})").cast("string")
    return F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def group_id(value: Column, prefix: str = "exclusive") -> Column:
    """'59.9794' to 'exclusive_59_9794'."""
    return F.concat(F.lit(prefix + "_"), F.replace(decimal_text(value), F.lit("."), F.lit("_")))


def compact_key(address: Column) -> Column:
    """An address without white space and punctuation, lower case."""
    return F.regexp_replace(F.lower(address), r"[\s,.()\-]", "")


def road_parts(address: Column) -> Column:
    """(road, number) of '... 해운대로 123-4' or '... Main Road 12'."""
    pattern = r"(\S+(?:로|길|Road|Street|Ave))\s+(\d+(?:-\d+)?)"
    none = lambda c: F.when(c != "", c)
    return F.struct(none(F.regexp_extract(address, pattern, 1)).alias("road"), none(F.regexp_extract(address, pattern, 2)).alias("number"))


def district(address: Column) -> Column:
    """(district, town) of an address: words that end in 구 or 군, and in 동, 읍, 면 or 가."""
    none = lambda c: F.when(c != "", c)
    return F.struct(none(F.regexp_extract(address, r"(\S+[구군])(?:\s|$)", 1)).alias("district"), none(F.regexp_extract(address, r"(\S+[동읍면가])(?:\s|$)", 1)).alias("town"))


def address_candidates(df: DataFrame, key: str, columns: list[list[str]]) -> DataFrame:
    """(key, priority, query, query_key): joined columns as search texts, each compact form once, in order of priority."""
    made = F.array(*(F.struct(F.lit(i).alias("priority"), F.concat_ws(" ", *cols).alias("query")) for i, cols in enumerate(columns, 1)))
    rows = df.select(key, F.inline(made)).where(F.trim("query") != "").withColumn("_compact", compact_key(F.col("query")))
    first = Window.partitionBy(key, "_compact").orderBy("priority")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(key, "priority", "query", F.sha2("_compact", 256).alias("query_key"))


def search_queries(parts: list[Column]) -> Column:
    """Distinct non-empty search texts in their order."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(F.trim(p) != "", F.trim(p)) for p in parts))))


def count_text(text: Column) -> Column:
    """'1,234' to 1234; anything that isn't digits with commas is null."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit(""))
    return F.when(plain.rlike(r"^\d+$"), plain.cast("long"))


def only_year(text: Column) -> Column:
    """The year named in a text if just one is."""
    years = F.array_distinct(F.regexp_extract_all(text, F.lit(r"((?:19|20)\d{2})"), 1))
    return F.when(F.size(years) == 1, F.get(years, F.lit(0)).cast("int"))


def date_parts(day: Column, first: Column) -> dict[str, Column]:
    """year_month, quarter label and months since `first`."""
    months = F.months_between(F.trunc(day, "MM"), F.trunc(first, "MM")).cast("int")
    return {"year_month": F.date_format(day, "yyyy-MM"), "quarter": F.concat(F.year(day), F.lit("Q"), F.quarter(day)), "month_index": months}


def outside_brackets(text: Column) -> Column:
    """A text's clauses: split at commas that stand outside round brackets."""
    return F.transform(F.split(text, r",(?![^()]*\))"), lambda x: F.trim(x))


def numbers_of_clause(clause: Column, unit: str = "통|반") -> Column:
    """The numbers that a clause names: '1,3,5통' gives 1, 3, 5; '1~5통' gives 1 to 5; '1~5통 중 3통 제외' leaves 3 out."""
    kept = F.regexp_replace(clause, rf"중\s*[\d,~\s]+(?:{unit})?\s*제외", "")
    left_out = F.regexp_extract(clause, rf"중\s*([\d,~\s]+)(?:{unit})?\s*제외", 1)

    def listed(part: Column) -> Column:
        pieces = F.regexp_extract_all(part, F.lit(r"(\d+(?:\s*~\s*\d+)?)"), 1)
        ends = lambda p: F.transform(F.split(p, r"\s*~\s*"), lambda x: x.cast("int"))
        return F.flatten(F.transform(pieces, lambda p: F.sequence(F.get(ends(p), F.lit(0)), F.greatest(F.get(ends(p), F.size(ends(p)) - 1), F.get(ends(p), F.lit(0))))))

    return F.array_sort(F.array_except(listed(kept), listed(left_out)))


def parse_clauses(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, clause, kind, numbers, confidence, review): a row for each clause of a catchment text.

    Kinds: EXCLUDE, CONDITIONAL, RANGE, LOT, ROAD, NAME. Clauses without a number or a road are for review.
    """
    rows = df.select(key, F.posexplode(outside_brackets(F.col(text))).alias("position", "clause")).where("clause <> ''")
    c = F.col("clause")
    kind = first_match([(c.rlike("제외$|except"), "EXCLUDE"), (c.rlike("공동|조건|shared|if "), "CONDITIONAL"), (c.rlike(r"\d+\s*(?:통|반)"), "RANGE"), (c.rlike(r"\d+(?:-\d+)?\s*번지"), "LOT"), (c.rlike(r"(?:로|길|Road|Street)(?:\s|$|\d)"), "ROAD")], "NAME")
    out = rows.withColumn("kind", kind).withColumn("numbers", F.when(F.col("kind").isin("RANGE", "EXCLUDE", "CONDITIONAL"), numbers_of_clause(c)).otherwise(F.array().cast("array<int>")))
    sure = first_match([(F.col("kind").isin("RANGE", "LOT") & (F.size("numbers") >= 0), 0.95), (F.col("kind") == "ROAD", 0.8)], 0.5)
    return out.withColumn("confidence", sure).withColumn("review", sure < 0.8)


def boundary_decision(rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, decision): EXCLUDE before CONDITIONAL before INCLUDE over the rule rows (kind) of a key."""
    some = lambda k: F.bool_or(F.col("kind") == k)
    return rules.groupBy(*keys).agg(first_match([(some("EXCLUDE"), "EXCLUDE"), (some("CONDITIONAL"), "CONDITIONAL")], "INCLUDE").alias("decision"))


def sections(text: Column, start: str, stop: str) -> Column:
    """The part of a text between two markers; null without both."""
    a = F.locate(start, text)
    after = F.expr("0") + a + len(start)
    rest = F.substr(text, after)
    b = F.locate(stop, rest)
    return F.when((a > 0) & (b > 0), F.trim(F.substr(rest, F.lit(1), b - 1)))


def cross_names(df: DataFrame, key: str, left: str, right: str, pattern: str) -> DataFrame:
    """(key, left_name, right_name): every name found on the left with every one on the right of the same row."""
    names = df.select(key, F.array_distinct(F.regexp_extract_all(F.col(left), F.lit(pattern), 1)).alias("_l"), F.array_distinct(F.regexp_extract_all(F.col(right), F.lit(pattern), 1)).alias("_r"))
    return names.select(key, F.explode("_l").alias("left_name"), "_r").select(key, "left_name", F.explode("_r").alias("right_name"))


def carried_groups(lines: DataFrame, doc: str, line_no: str, group: str) -> DataFrame:
    """Lines with the last group heading at or above them."""
    up_to = Window.partitionBy(doc).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(group, F.last(F.col(group), ignorenulls=True).over(up_to))


#: The kinds of relations by the words that name them, and their weights.
RELATION_KINDS = {
    "exact": "EXACT", "guaranteed": "EXACT", "confirmed": "EXACT",
    "eligible": "ELIGIBLE", "official_eligibility": "ELIGIBLE",
    "conditional": "CONDITIONAL", "conditional_not_guaranteed": "CONDITIONAL", "general_priority": "CONDITIONAL", "preference": "CONDITIONAL",
    "group_only": "GROUP_MEMBERSHIP", "group_membership": "GROUP_MEMBERSHIP", "group": "GROUP_MEMBERSHIP",
    "unresolved": "UNRESOLVED",
}
RELATION_WEIGHTS = {"EXACT": 1.0, "ELIGIBLE": 0.8, "CONDITIONAL": 0.5, "GROUP_MEMBERSHIP": 0.25, "UNRESOLVED": 0.0}


def relation_type(text: Column) -> Column:
    """A relation's kind in a closed set: EXACT, ELIGIBLE, CONDITIONAL, GROUP_MEMBERSHIP, else UNRESOLVED; also for null."""
    t = F.lower(F.trim(text))
    named = F.element_at(F.create_map(*(F.lit(x) for kv in RELATION_KINDS.items() for x in kv)), t)
    native = first_match([(t.rlike("^지정"), "EXACT"), (t.rlike("^가능"), "ELIGIBLE"), (t.rlike("^조건"), "CONDITIONAL"), (t.rlike("^학교군"), "GROUP_MEMBERSHIP")], "UNRESOLVED")
    return F.coalesce(named, native)


def relation_weight(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in RELATION_WEIGHTS.items() for x in kv))[kind], F.lit(0.0))


def promoted(df: DataFrame, key: str, boys: str, girls: str, options: str) -> DataFrame:
    """df with promoted: both columns and the only option of a key name the same target."""
    only = F.when(F.size(options) == 1, F.get(options, F.lit(0)))
    return df.withColumn("promoted", F.coalesce((F.col(boys) == F.col(girls)) & (F.col(boys) == only), F.lit(False)))


def header_columns(rows: DataFrame, cells: str, aliases: DataFrame) -> DataFrame:
    """(column, position) of a header row's cells through a table of aliases (alias, column); the first position counts."""
    found = rows.select(F.posexplode(cells).alias("position", "_c")).withColumn("alias", compact_key(F.col("_c")))
    known = aliases.select(compact_key(F.col("alias")).alias("alias"), "column")
    return found.join(known, "alias").groupBy("column").agg(F.min("position").alias("position"))


def layout_rows(lines: DataFrame, doc: str, line_no: str, text: str, heading: str, separator: str) -> DataFrame:
    """(doc, line_no, group, left, right): lines 'left separator right' under the last heading, a row for each name on the right.

    A line without the separator that isn't a heading carries its text over as the left side of the next one.
    """
    own = F.regexp_extract(text, heading, 1)
    marked = lines.withColumn("_group", F.when(own != "", own))
    parts = F.split(text, separator)
    left = F.when(F.col("_group").isNull(), F.when(F.trim(F.get(parts, F.lit(0))) != "", F.trim(F.get(parts, F.lit(0)))))
    marked = marked.withColumn("_left", left).withColumn("_right", F.when(F.size(parts) > 1, F.get(parts, F.lit(1))))
    w = Window.partitionBy(doc).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.withColumns({"group": F.last("_group", ignorenulls=True).over(w), "left": F.last("_left", ignorenulls=True).over(w)})
    names = F.filter(F.transform(F.split("_right", r"\s*,\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return carried.where("_right is not null").select(doc, line_no, "group", "left", F.explode(names).alias("right"))


def expanded_cells(df: DataFrame, key: str, columns: dict[str, str], areas: str) -> DataFrame:
    """(key, kind, name, area): every name in the columns of a row's kinds with every one of its areas."""
    split = lambda c: F.filter(F.transform(F.split(F.col(c), r"\s*[,/·]\s*"), lambda x: F.trim(x)), lambda x: x != "")
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), F.coalesce(split(c), F.array().cast("array<string>")).alias("names")) for c, kind in columns.items()))
    rows = df.select(key, F.inline(kinds), F.coalesce(split(areas), F.array().cast("array<string>")).alias("_areas"))
    return rows.select(key, "kind", F.explode("names").alias("name"), "_areas").select(key, "kind", "name", F.explode("_areas").alias("area"))


def geocode_check(df: DataFrame, candidate: str, document: str, fields: list[str]) -> DataFrame:
    """df with status and reasons: how many fields of a geocoder's document (structs) agree with what was asked for.

    All agree: CONFIRMED; the first, a district, differs: REJECTED; else REVIEW. A field that is missing doesn't agree.
    """
    same = {f: F.coalesce(F.col(f"{candidate}.{f}") == F.col(f"{document}.{f}"), F.lit(False)) for f in fields}
    differs = F.coalesce(F.col(f"{candidate}.{fields[0]}") != F.col(f"{document}.{fields[0]}"), F.lit(False))
    every = F.lit(True)
    for c in same.values():
        every = every & c
    why = F.concat_ws(";", *(F.when(~c, F.lit(f"{f}_DIFFERS")) for f, c in same.items()))
    return df.withColumns({"status": first_match([(every, "CONFIRMED"), (differs, "REJECTED")], "REVIEW"), "reasons": why})


def coordinate_flags(df: DataFrame, lat: str, lon: str, group: str, box: tuple[float, float, float, float]) -> DataFrame:
    """df with valid, inside the box (south, west, north, east), and shared, for a place that several groups claim."""
    south, west, north, east = box
    valid = F.coalesce(F.col(lat).between(south, north) & F.col(lon).between(west, east), F.lit(False))
    at = Window.partitionBy(F.round(lat, 7), F.round(lon, 7))
    return df.withColumn("valid", valid).withColumn("shared", valid & (F.min(group).over(at) != F.max(group).over(at)))


@F.pandas_udf(T.DoubleType())
def _matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(one: Column, two: Column, unit: str = "차|단지") -> Column:
    """Likeness of two names from 0 to 1: matching blocks of their keys, 0 on conflicting ordinals; if one
    holds the other at least 0.9, and 0.1 times their lengths' ratio more.

    Runs in Python over batches; use it on distinct pairs, after a block key has made them.
    """
    a, b = entity_name(one), entity_name(two)
    holds = (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a))
    base = _matching_blocks(a, b)
    held = 0.9 + 0.1 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    return F.when(ordinal_conflict(one, two, unit), 0.0).when(holds, F.greatest(base, held)).otherwise(base)
