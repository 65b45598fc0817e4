"""Where a source record can be seen, edited or corrected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word within the dataset's name, platform, address for contributions, what to do; the first that fits counts.
PLATFORMS = (
    ("openstreetmap", "OpenStreetMap", "https://wiki.openstreetmap.org/wiki/Main_Page", "Edit the feature in OpenStreetMap; a later release picks the change up."),
    ("esri", "Esri Community Maps", "https://livingatlas.arcgis.com/community-maps/", "Contribute through the provider's community maps programme."),
    ("meta", "Meta", "https://mapwith.ai/", "Report the correction through the provider's mapping programme."),
    ("microsoft", "Microsoft", "https://www.microsoft.com/en-us/maps", "Contribute through the map data's own correction workflow."),
    ("pinmeto", "PinMeTo", "https://pinme.to/", "Contact the provider, who maintains the record."),
    ("geoboundaries", "geoBoundaries", "https://www.geoboundaries.org/", "Boundaries are maintained by the project."),
)
DOCUMENTATION_URL = "https://docs.overturemaps.org/gers/bridge-files/"
OTHER_INSTRUCTIONS = "Find the upstream provider in the bridge table and contribute there."
UNKNOWN = "Unknown source"
_ELEMENTS = (("n", "node"), ("w", "way"), ("r", "relation"))
_SITE = "https://www.openstreetmap.org/"


def _is_osm(dataset: Column) -> Column:
    return F.lower(dataset.cast("string")).contains("openstreetmap")


def osm_url(dataset: Column, record_id: Column) -> Column:
    """Address of an element's page from n1, w1 or r1 with an optional @version; null for anything else."""
    rid, out = record_id.cast("string"), F.lit(None).cast("string")
    for letter, kind in reversed(_ELEMENTS):
        out = F.when(rid.rlike(f"^{letter}[0-9]+(@.*)?$"), F.concat(F.lit(f"{_SITE}{kind}/"), F.regexp_extract(rid, f"^{letter}([0-9]+)", 1))).otherwise(out)
    return F.when(_is_osm(dataset), out)


def edit_url(dataset: Column, record_id: Column) -> Column:
    """Address of the editor, as strict about the record's form as osm_url."""
    rid, out = record_id.cast("string"), F.lit(None).cast("string")
    for letter, kind in reversed(_ELEMENTS):
        out = F.when(rid.rlike(f"^{letter}[0-9]+(@.*)?$"), F.concat(F.lit(f"{_SITE}edit?{kind}="), F.regexp_extract(rid, f"^{letter}([0-9]+)", 1))).otherwise(out)
    return F.when(_is_osm(dataset), out)


def loose_edit_url(dataset: Column, record_id: Column) -> Column:
    """Address of the editor from a record that only begins like an element, in any case and after white space."""
    rid, out = F.trim(record_id.cast("string")), F.lit(None).cast("string")
    for letter, kind in reversed(_ELEMENTS):
        out = F.when(rid.rlike(f"(?i)^{letter}[0-9]+"), F.concat(F.lit(f"{_SITE}edit?{kind}="), F.regexp_extract(rid, f"(?i)^{letter}([0-9]+)", 1))).otherwise(out)
    return F.when(_is_osm(dataset), out)


def _by_platform(dataset: Column, pick: int, blank: Column, other: Column) -> Column:
    low, out = F.lower(dataset.cast("string")), other
    for row in reversed(PLATFORMS):
        out = F.when(low.contains(row[0]), row[pick]).otherwise(out)
    return F.when(dataset.isNull() | (F.trim(dataset) == ""), blank).otherwise(out)


def platform(dataset: Column) -> Column:
    return _by_platform(dataset, 1, F.lit(UNKNOWN), dataset)


def contribution_url(dataset: Column) -> Column:
    return _by_platform(dataset, 2, F.lit(DOCUMENTATION_URL), F.lit(DOCUMENTATION_URL))


def instructions(dataset: Column) -> Column:
    return _by_platform(dataset, 3, F.lit(OTHER_INSTRUCTIONS), F.lit(OTHER_INSTRUCTIONS))
