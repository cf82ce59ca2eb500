"""Column functions: item codes, publishers, names, bands, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about which company it is, left out of a name's stem.
LEGAL_FORMS = (
    "corp", "corporation", "inc", "incorporated", "llc", "ltd", "limited", "co", "company", "plc", "holding", "holdings", "group", "the", "new", "sa", "nv", "ag", "lp", "trust",
)
DASH = "—"


def parse_items(items: Column) -> Column:
    """Comma list to trimmed codes that aren't blank; null to an empty array."""
    return F.coalesce(F.filter(F.transform(F.split(items, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def normal_items(items: Column) -> Column:
    return F.array_join(parse_items(items), ",")


def among(codes: Column, values: tuple[str, ...]) -> Column:
    return F.arrays_overlap(codes, F.array(*map(F.lit, values))) if values else F.lit(False)


def kept_items(codes: Column, excluded: tuple[str, ...]) -> Column:
    """Codes not in ``excluded``, repeats kept."""
    return F.filter(codes, lambda x: ~x.isin(*excluded)) if excluded else codes


def item_reason(items: Column, excluded: tuple[str, ...]) -> Column:
    """``no_item_codes``, ``only_excluded_items`` or null."""
    codes = parse_items(items)
    return F.when(F.size(codes) == 0, "no_item_codes").when(F.size(kept_items(codes, excluded)) == 0, "only_excluded_items")


def is_scheduled(items: Column, excluded: tuple[str, ...], scheduled: tuple[str, ...]) -> Column:
    """Whether a kept code is scheduled; null where ``item_reason`` holds."""
    return F.when(item_reason(items, excluded).isNull(), among(kept_items(parse_items(items), excluded), scheduled))


def disjoint(**sets: tuple[str, ...]) -> None:
    """Raises if a code is in several of the sets: its class would depend on which is asked first."""
    seen: dict[str, str] = {}
    for name, codes in sets.items():
        for code in codes:
            if seen.setdefault(code, name) != name:
                raise ValueError(f"{code} is in {seen[code]} and in {name}")


def unknown_codes(codes: Column, known: tuple[str, ...]) -> Column:
    return kept_items(codes, known)


def scope_reason(filed: Column, low: int, high: int, in_universe: Column) -> Column:
    return F.when(filed.isNull() | ~filed.between(low, high), "outside_study_window").when(~in_universe, "not_in_universe")


def event_id(accession: Column) -> Column:
    return F.trim(F.translate(accession, "-.", ""))


def domain_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def publisher_stem(name: Column) -> Column:
    lowered = F.lower(name)
    cut = F.when(lowered.contains(".") & ~lowered.contains(" "), F.regexp_replace(lowered, r"\.[^.]*$", "")).otherwise(lowered)
    return F.regexp_replace(cut, "[^a-z0-9]", "")


def tier_of(domain: Column, name: Column, first: tuple[str, ...], second: tuple[str, ...]) -> Column:
    """1 or 2 if either stem is in that list, else null."""
    stems = [publisher_stem(domain), publisher_stem(name)]

    def has(values: tuple[str, ...]) -> Column:
        return F.coalesce(stems[0].isin(*values), F.lit(False)) | F.coalesce(stems[1].isin(*values), F.lit(False))

    return F.when(has(first), 1).when(has(second), 2)


def name_stem(name: Column) -> Column:
    words = F.regexp_replace(F.lower(name), r"\b(" + "|".join(LEGAL_FORMS) + r")\b", "")
    return F.regexp_replace(words, "[^a-z0-9]", "")


def finite(value: Column) -> Column:
    """Null for NaN and infinite values."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def clean_observation(value: Column, clip: float) -> Column:
    return F.greatest(F.least(F.coalesce(finite(value), F.lit(0.0)), F.lit(clip)), F.lit(-clip))


def multiple(score: Column, threshold: Column) -> Column:
    return F.when(threshold != 0, score / threshold)


def strength(score: Column, threshold: Column) -> Column:
    times = multiple(score, threshold)
    return F.when(times >= 10, "extreme").when(times >= 4, "strong").when(times >= 2, "elevated").otherwise("marginal")


def reasons(slots: list[list[tuple[str, Column]]], limit: int) -> Column:
    """For each slot the first of its alternatives (format, value) with a value; the first ``limit`` slots."""
    texts = [F.coalesce(*(F.when(v.isNotNull(), F.format_string(form, v)) for form, v in slot)) for slot in slots]
    return F.slice(F.array_compact(F.array(*texts)), 1, limit)


def number(value: Column, places: int = 2) -> Column:
    return F.coalesce(F.format_number(value, places), F.lit(DASH))


def percent(value: Column, places: int = 1) -> Column:
    return F.coalesce(F.concat(F.format_number(value * 100, places), F.lit("%")), F.lit(DASH))


def keyword_class(text: Column, keywords: list[str]) -> Column:
    """The first keyword, in list order, that the text holds in any case."""
    return F.coalesce(*(F.when(F.contains(F.lower(text), F.lit(k.lower())), k) for k in keywords))


def outcome_slice(items: Column, scheduled: tuple[str, ...]) -> Column:
    return F.when(items.isNull(), DASH).when(among(parse_items(items), scheduled), "scheduled").otherwise("unscheduled")
