"""What geocoded addresses and free descriptions tell: terrain, objects, region, texture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in addresses (Russian and English) by terrain, in the order in which they are tried.
TERRAIN_WORDS = {
    "forest": ("лес", "forest", "woodland"),
    "grassland": ("луг", "поле", "meadow", "field"),
    "water": ("озеро", "река", "lake", "river", "водохранилище"),
    "swamp": ("болото", "marsh", "swamp"),
    "sand": ("песок", "песочн", "sand"),
    "tundra": ("тундра", "tundra"),
    "glacier": ("ледник", "glacier"),
    "rocks": ("скалы", "rocks", "горы", "mountains"),
    "urban": ("город", "city", "поселение", "settlement", "городская"),
}
# Words in addresses by kind of object.
OBJECT_WORDS = {
    "mountain_peak": ("гора", "пик", "mountain", "peak"),
    "spring": ("источник", "spring"),
    "viewpoint": ("обзорная", "viewpoint", "панорама"),
    "monument": ("памятник", "historic", "монумент"),
    "shelter": ("укрытие", "shelter", "приют", "убежище"),
}
# The standard terrain types and their Russian names.
TERRAIN_TYPES = {
    "forest": "лес",
    "taiga": "тайга",
    "deciduous_forest": "лиственный_лес",
    "coniferous_forest": "хвойный_лес",
    "swamp": "болото",
    "bog": "болото_верховое",
    "fen": "болото_низинное",
    "marsh": "болото_травяное",
    "steppe": "степь",
    "tundra": "тундра",
    "meadow": "луг",
    "grassland": "травянистая_местность",
    "river": "река",
    "lake": "озеро",
    "stream": "ручей",
    "water": "водоём",
    "rocks": "скалы",
    "cliff": "утёс",
    "stone": "каменистая_местность",
    "glacier": "ледник",
    "snowfield": "снежное_поле",
    "ice": "ледниковое_поле",
    "road_asphalt": "дорога_асфальт",
    "road_gravel": "дорога_грунтовая",
    "road_dirt": "дорога_грунт",
    "trail": "тропа",
    "path": "дорога_пешеходная",
    "settlement": "посёлок",
    "village": "деревня",
    "town": "город",
    "building": "здание",
    "urban": "городская_территория",
    "park": "парк",
    "field": "поле",
    "farmland": "сельскохозяйственная_земля",
    "sand": "песок",
    "mountain": "гора",
}
# Other Russian names of terrain.
TERRAIN_ALIASES = {
    "дорога": "road_asphalt",
}


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def terrain_of_address(address: Column, lat: Column) -> Column:
    """The first terrain with a word in the address, else by latitude; null without an address."""
    low = F.lower(address)
    found = F.when(address.isNull(), None)
    for kind, words in TERRAIN_WORDS.items():
        found = found.when(_any(low, words), kind)
    return found.when(lat > 66, "tundra").when(lat > 60, "taiga").otherwise("grassland")


def objects_of_address(address: Column) -> Column:
    """Array of the kinds of object that the address names, each once."""
    low = F.lower(F.coalesce(address, F.lit("")))
    return F.array_compact(F.array(*[F.when(_any(low, words), kind) for kind, words in OBJECT_WORDS.items()]))


def region_of_address(address: Column) -> Column:
    """State, province, region, county or country of an address map; empty texts are skipped."""
    part = lambda k: F.nullif(F.try_element_at(address, F.lit(k)), F.lit(""))
    return F.coalesce(*[part(k) for k in ("state", "province", "region", "county", "country")])


def terrain_name(text: Column) -> Column:
    """Standard name of a Russian terrain name or of a standard one, else null."""
    low = F.lower(text)
    names = {russian: name for name, russian in TERRAIN_TYPES.items()} | TERRAIN_ALIASES
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, low), F.when(low.isin(*TERRAIN_TYPES), low))


def texture(description: Column) -> Column:
    """Struct smoothness, density, regularity, variation; later groups of words override earlier ones."""
    low = F.lower(description)
    woods, flat, rocky, wet = (_any(low, w) for w in (("лес", "деревья", "густо"), ("поле", "гладко", "ровно"), ("скалы", "камни", "скальный"), ("вода", "озеро", "река")))
    pick = lambda *rules: F.coalesce(*[F.when(c, v) for c, v in rules], F.lit(0.5))
    return F.struct(
        pick((wet, 0.9), (rocky, 0.2), (flat, 0.8), (woods, 0.3)).alias("smoothness"),
        pick((woods, 0.9)).alias("density"),
        pick((wet, 0.6), (flat, 0.7)).alias("regularity"),
        pick((rocky, 0.8)).alias("variation"),
    )
