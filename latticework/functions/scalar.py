"""Scalar functions as Column expressions: lenient parsing, clamping, text normalising, bands and classes."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(x: Column) -> Column:
    """A finite double, or null: NaN, infinities and text that is no number give null."""
    v = F.trim(x.cast("string")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def clamp01(x: Column) -> Column:
    """Clamped to [0, 1]; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def comma_area(x: Column) -> Column:
    """A comma-decimal area: blanks dropped, bad or missing text 0, never negative."""
    return F.greatest(F.coalesce(parse_number(F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))), F.lit(0.0)), F.lit(0.0))


#: Asked before the long classes of characters below, which are walked one by one.
_FAR = "\\x{80}-\\x{10FFFF}"


def _foldings() -> tuple[dict[str, str], dict[str, str], str]:
    """Characters whose compatibility decomposition without combining marks is one of a-z and 0-9, those where it holds some, and a
    pattern of those where nothing is left; all others only part words."""
    one, more, marks = {}, {}, []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if not plain:
            marks.append(code)
        elif any("a" <= x <= "z" or "0" <= x <= "9" for x in plain):
            (one if len(plain) == 1 else more)[chr(code)] = plain
    runs: list[list[int]] = []
    for code in marks:
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return one, more, f"[{_FAR}&&[" + "".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in runs) + "]]+"


_ONE, _MORE, _MARKS = _foldings()
_LONGER = f"[{_FAR}&&[" + "".join(f"\\x{{{ord(c):x}}}" for c in _MORE) + "]]"


def normalise_text(x: Column) -> Column:
    """Trimmed, lower case, dotless i dotted, decomposed without marks; runs of a-z and 0-9 joined by single spaces.

    Letters that decompose to nothing plain, such as the sharp s, part words.
    """
    low = F.replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), F.lit("\u0131"), F.lit("i"))
    bare = F.translate(F.regexp_replace(low, _MARKS, ""), "".join(_ONE), "".join(_ONE.values()))
    longer = F.create_map(*[F.lit(y) for pair in _MORE.items() for y in pair])

    def spread(b: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(b, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c <= "\x7f", c).otherwise(F.coalesce(F.element_at(longer, c), c))), "")

    # Bound as a variable, so the folding runs once and not in every branch.
    plain = F.transform(F.array(bare), lambda b: F.when(b.rlike(_LONGER), spread(b)).otherwise(b))[0]
    return F.array_join(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0)), " ")


# Words of place names that tell nothing.
STOP_WORDS = ["park", "parki", "yesil", "alani", "mahalle", "mahallesi"]


def drop_stop_words(x: Column, stop: list[str] | None = None) -> Column:
    """The words but for stop words; the whole text where nothing else is left."""
    words = STOP_WORDS if stop is None else stop
    core = F.array_join(F.filter(F.split(x, " "), lambda w: ~w.isin(words)), " ")
    return F.when(core != "", core).otherwise(x)


def compound_key(x: Column) -> Column:
    """a|b with both sides normalised, b without stop words; empty unless there are two sides."""
    parts = F.split(F.coalesce(x, F.lit("")), r"\|", 2)
    both = F.concat(normalise_text(parts[0]), F.lit("|"), drop_stop_words(normalise_text(F.get(parts, F.lit(1)))))
    return F.when(F.size(parts) == 2, both).otherwise("")


def snap(x: Column, size: float) -> Column:
    """Number of the nearest multiple of size; halves go to the even one."""
    return F.rint(x / size).cast("long")


def bearing180(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def orientation_bin(dx: Column, dy: Column, bins: int = 12) -> Column:
    return F.least(F.floor(bearing180(dx, dy) / (180.0 / bins)), F.lit(bins - 1)).cast("long")


def coastal_band(d: Column) -> Column:
    bands = ((0, "shoreline_cell"), (500, "coastal_0_500m"), (1000, "coastal_500_1000m"), (2000, "coastal_1_2km"), (5000, "transition_2_5km"))
    out = F.when(d <= bands[0][0], bands[0][1])
    for upto, name in bands[1:]:
        out = out.when(d <= upto, name)
    return out.otherwise("inland_5km_plus")


def node_class(degree: Column) -> Column:
    return F.when(degree >= 3, "intersection").when(degree == 2, "through").when(degree == 1, "dead_end").otherwise("isolated")


def iso_date(x: Column) -> Column:
    """A date from year-month-day text, padded or not; else null."""
    return F.expr("try_to_date(x, 'yyyy-M-d')") if isinstance(x, str) else F.call_function("try_to_date", x, F.lit("yyyy-M-d"))


def label_prefix(x: Column) -> Column:
    """The leading number of a label, or null."""
    return F.regexp_extract(x, r"^(\d+)", 1).try_cast("long")


def block_key(row: Column, col: Column, size: int = 5) -> Column:
    return F.concat(F.floor(row / size).cast("string"), F.lit("_"), F.floor(col / size).cast("string"))


def close_to(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Equal within an absolute and a relative tolerance; two nulls are equal, one isn't."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tolerance + tolerance * F.abs(b))


def row_entropy(p: Column) -> Column:
    """Entropy of an array of probabilities (1e-12 at least each), over its largest possible value."""
    clipped = F.transform(p, lambda x: F.greatest(x, F.lit(1e-12)))
    return F.aggregate(clipped, F.lit(0.0), lambda a, x: a - x * F.ln(x)) / F.ln(F.size(p).cast("double"))


# Context classes in the order in which they are tried, each with tag keys and the values that count (none: any value).
TAG_RULES = [
    ("airport", [("aeroway", [])]),
    ("industrial_port", [("landuse", ["industrial"]), ("industrial", []), ("harbour", [])]),
    ("industrial_port", [("seamark:type", ["harbour", "port", "dock", "terminal", "marina"])]),
    ("industrial_port", [("man_made", ["works", "storage_tank", "silo"])]),
    ("commercial_retail", [("landuse", ["commercial", "retail"]), ("shop", []), ("amenity", ["marketplace", "parking"])]),
    ("institutional_public", [("amenity", ["university", "school", "college", "hospital", "clinic"])]),
    ("green_open", [("leisure", []), ("landuse", ["grass", "meadow", "orchard", "vineyard"]), ("natural", ["wood", "scrub", "grassland", "wetland", "beach"])]),
    ("blue_water", [("natural", ["water"])]),
    ("transport_terminal", [("amenity", ["bus_station", "ferry_terminal"]), ("railway", []), ("public_transport", []), ("man_made", ["pier", "breakwater"])]),
    ("military_quarry", [("landuse", ["military", "quarry"])]),
    ("construction_brownfield", [("landuse", ["construction", "brownfield", "depot", "garages", "railway"])]),
]


def tag_match(tags: Column) -> Column:
    """context_class, matched_key and matched_value of a tag map.

    The first rule of which a key has a value that counts gives the class.  The key reported is the rule's first that the map has at
    all, be it with another value.
    """
    none = F.lit(None).cast("string")
    out = F.struct(F.lit("other_context").alias("context_class"), none.alias("matched_key"), none.alias("matched_value"))
    for name, keys in reversed(TAG_RULES):
        value = {k: F.element_at(tags, F.lit(k)) for k, _ in keys}
        holds = [value[k].isin(values) if values else value[k].isNotNull() for k, values in keys]
        first = F.coalesce(*[F.when(value[k].isNotNull(), F.struct(F.lit(k).alias("k"), value[k].alias("v"))) for k, _ in keys])
        found = F.struct(F.lit(name).alias("context_class"), first["k"].alias("matched_key"), first["v"].alias("matched_value"))
        out = F.when(reduce(or_, [F.coalesce(h, F.lit(False)) for h in holds]), found).otherwise(out)
    return out


def tag_class(tags: Column) -> Column:
    return tag_match(tags)["context_class"]


# Building uses by their source spelling, in the order that decides ties.
BUILDING_USES = {"MESKEN": "residential", "İŞYERİ": "workplace", "KAMU": "public"}


def building_use(x: Column) -> Column:
    """The use of a building type.  Upper case is that of no locale: a dotted small i becomes I and then meets no key."""
    kind = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    return F.element_at(F.create_map(*[F.lit(y) for pair in BUILDING_USES.items() for y in pair]), kind)


def short_number(x: Column) -> Column:
    """A double as text of ten significant digits at most, without trailing zeros, with an exponent below 1e-4 and from 1e10; null is empty."""

    def bare(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")

    exact = F.format_string("%.9e", x)
    power = F.regexp_extract(exact, r"e([+-][0-9]+)$", 1)
    out = F.when(x.isNull(), "").when(x == 0, "0").when(~power.cast("int").between(-4, 9), F.concat(bare(F.regexp_extract(exact, r"^(.*)e", 1)), F.lit("e"), power))
    for k in range(14):
        out = out.when(power.cast("int") == 9 - k, bare(F.format_string(f"%.{k}f", x)) if k else F.format_string("%.0f", x))
    return out


def mend_encoding(x: Column) -> Column:
    """Text whose UTF-8 bytes were read as a one-byte encoding, read again; text that doesn't come out valid stays.

    Bytes 80 to 9F of the Windows code page come back first, as they stand for other characters there.
    """
    bytes_ = F.translate(x, "".join(_WINDOWS), "".join(_WINDOWS.values()))
    raw = F.when(~bytes_.rlike(r"[^\x{0}-\x{ff}]"), F.encode(bytes_, "ISO-8859-1"))
    again = F.try_validate_utf8(raw.cast("string"))
    return F.coalesce(F.when(x.rlike("[\u00c2-\u00f4]"), again), x)


def _windows() -> dict[str, str]:
    """Characters of the Windows code page at 80 to 9F, with the control characters that have those bytes."""
    out = {}
    for code in range(0x80, 0xA0):
        try:
            out[bytes([code]).decode("cp1252")] = chr(code)
        except UnicodeDecodeError:
            continue
    return out


_WINDOWS = _windows()


def confidence_gap(confidence: Column, correct: Column) -> Column:
    """Aggregate: mean confidence less accuracy."""
    return F.avg(confidence) - F.avg(correct.cast("double"))


# Columns worth keeping, and tokens that speak for or against one.
RETAINED = {
    "building_coverage_exact": 20, "building_density_exact_per_km2": 20, "floor_area_ratio_proxy": 20, "height_proxy_aw_mean_m": 18, "canopy_volume_gt2m_proxy_m3_per_ha": 18,
    "canopy_height_p95_m": 18, "coast_min_distance_m": 18, "road_density_exact_m_per_km2": 18, "network_intersection_density_per_km2": 18, "road_orientation_entropy_norm": 17,
    "network_reach_250m_road_density_m_per_km2": 17, "network_reach_400m_road_density_m_per_km2": 18, "network_reach_800m_road_density_m_per_km2": 17,
    "network_reach_400m_intersection_density_per_km2": 18, "network_reach_400m_orientation_entropy_norm": 17, "network_reach_250m_road_excl_motorway_density_m_per_km2": 15,
    "network_reach_400m_road_excl_motorway_density_m_per_km2": 16, "network_reach_800m_road_excl_motorway_density_m_per_km2": 15, "morph_building_perimeter_density_m_per_ha": 18,
    "morph_building_area_gini": 17, "morph_building_compactness_aw_mean": 18, "morph_open_space_fragmentation_index": 17, "street_frontage_continuity_proxy": 18,
    "street_frontage_open_buffer_share": 17, "street_frontage_edge_m_per_road_km": 17, "block_permeability_network_proxy": -8, "block_permeability_street_open_network_proxy": -10,
    "road_density_prelim_m_per_km2": 16,
}
GOOD_TOKENS = ["share", "ratio", "density", "coverage", "per_ha", "mean", "median", "aw_mean", "p95", "exact"]
WEAK_TOKENS = ["valid", "count", "area_m2", "flag", "max", "std", "raw", "prelim"]


def retention_score(name: Column) -> Column:
    """How much a column is worth keeping among its like: its own score, 2 for each good token, -1 for each weak one, and the ends."""

    def points(test: Column, n: int) -> Column:
        return F.when(test, F.lit(n)).otherwise(F.lit(0))

    score = F.coalesce(F.element_at(F.create_map(*[F.lit(y) for pair in RETAINED.items() for y in pair]), name), F.lit(0))
    for tokens, n in ((GOOD_TOKENS, 2), (WEAK_TOKENS, -1)):
        for token in tokens:
            score = score + points(name.contains(token), n)
    prefixed = name.startswith("osm_share_") | name.startswith("worldcover_share_") | name.startswith("dw_")
    return (score + points(prefixed, 1) + points(name.endswith("_flag"), -2)).cast("long")


# Column families by prefix, in order of precedence.
FAMILIES = [
    ("weak_lcz_label", ("lcz_",)), ("climate_response", ("lst_",)), ("dsm_5m", ("dsm_",)), ("dynamic_world", ("dw_",)), ("sentinel2", ("s2_",)),
    ("worldcover", ("worldcover_",)), ("coastal_context", ("coast_", "coastal_")), ("canopy_height", ("canopy_",)), ("osm_proxy_context", ("osm_",)),
    ("green_space_2sfca", ("green_2sfca_",)), ("population_demand_allocation", ("population_",)), ("building_footprint_morphometrics", ("morph_",)),
    ("street_facing_morphology", ("street_frontage_", "block_permeability_")), ("road_network_reach", ("network_reach_",)), ("road_network_exact", ("road_", "network_")),
    ("building_floor_proxy", ("building_", "floor_", "height_proxy_", "underground_", "lowrise_", "midrise_", "upper_midrise_", "highrise_", "type_", "built_volume_")),
]


def column_family(name: Column) -> Column:
    out = F.when(name.isin("grid_id", "row_id", "col_id", "district", "cell_area_m2", "eligible_core"), "sampling_frame")
    for family, prefixes in FAMILIES:
        test = F.lit(False)
        for p in prefixes:
            test = test | name.startswith(p)
        out = out.when(test, family)
    return out.otherwise("other")


def column_role(name: Column) -> Column:
    out = F.when(name == "grid_id", "id").when(name.isin("row_id", "col_id"), "spatial_index").when(name == "district", "admin_context")
    out = out.when(name.startswith("lcz_"), "label_or_label_quality").when(name.startswith("lst_"), "climate_outcome")
    return out.when(name.endswith("_valid_px") | name.contains("obs_count"), "coverage_or_quality_control").otherwise("candidate_predictor")
