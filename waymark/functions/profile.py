"""Country profiles: constants and patterns from which column expressions are made when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field

# Province tokens, long names, patterns, bounds and confidences of the Canada profile.
PROVINCES = ("AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT")
LONG_PROVINCES = {"NOVA SCOTIA": "NS", "NEW BRUNSWICK": "NB", "ONTARIO": "ON", "QUEBEC": "QC"}
POSTAL = r"([A-Z]\d[A-Z])\s*(\d[A-Z]\d)"
UNIT_WORDS = "UNIT|APT|SUITE|STE|RM|ROOM|BSMT|BASEMENT|PH|PENTHOUSE|FL|FLOOR"
INLINE_UNIT = r"^\s*(\d+[A-Z]?)\s+(.+?)\s+(?:UNIT|APT|APARTMENT|SUITE|STE|RM|ROOM)\s*([A-Z0-9-]+)(?:\s+.+)?$"
UNIT_BEFORE_CITY = r"^\s*(\d+[A-Z]?)\s+([^,]+?),\s*(\d{1,5}[A-Z]?)\s+([A-Z][A-Z .'\-]+?)\s+(" + "|".join(PROVINCES) + r")(?:\b.*)?$"
UNIT_SUFFIX = r"^\s*(\d+[A-Z]?)\s+([^,]+?),\s*(\d{1,5}[A-Z]?)\s*$"
COMMUNITY_PREFIX = r"^\s*(BSMT|BASEMENT|SUITE|STE|UNIT|APT)\s*([A-Za-z0-9-]+)\s+(\d+[A-Za-z]?)\s+([^,]+)"
LEADING_HYPHEN = r"^\s*([A-Za-z0-9-]+)\s*-\s*(\d+[A-Za-z]?)\s+([^,]+)"
HASH_PREFIX = r"^\s*#\s*([A-Za-z0-9-]+)\s+(\d+[A-Za-z]?)\s+([^,]+)"
LEVEL_PREFIX = r"^\s*(LEVEL|FLOOR|FL)\s*(\d+)\s+(\d+[A-Za-z]?)\s+([^,]+)"
STREET_STANDARD = r"^\s*(?:(?:" + UNIT_WORDS + r")\s*[\w-]+\s+)?(\d+[A-Za-z]?)\s+([^,]+)"
SIMPLE = r"(\d+)\s+([^,]+)"

# Words that hint at units and at commerce (review prescreen), and the pattern of targeted review.
UNIT_HINTS = (
    "APT", "APART", "SUITE", "STE", "UNIT", "#", "ROOM", "RM", "FLOOR", "FL",
    "BASEMENT", "BSMT", "LOWER", "UPPER", "PENTHOUSE", "PH", "GF", "GROUND FLOOR",
    "MAIN FLOOR", "MAIN FLR", "REAR", "FRONT", "SIDE",
)
COMMERCIAL_HINTS = ("MALL", "PLAZA", "SQUARE", "TOWER", "OFFICE", "CENTRE", "CENTER", "PARK LANE", "SCOTIA")
TARGET_WORDS = "APT|APART|SUITE|STE|UNIT|#|ROOM|RM|FLOOR|FL|BASEMENT|BSMT|LOWER|UPPER|PENTHOUSE|PH|GF|GROUND FLOOR|MAIN FLOOR|MAIN FLR|REAR|FRONT|SIDE|MALL|PLAZA|SQUARE|TOWER|OFFICE|CENTRE|CENTER"


@dataclass(frozen=True)
class Rule:
    """One parsing rule: groups of number, name, unit (0: none), city and province, and three confidences."""

    name: str
    pattern: str
    number: int
    street: int
    unit: int
    parse: float
    unit_confidence: float
    postal: float = 0.90
    city: int = 0
    province: int = 0


@dataclass(frozen=True)
class CountryProfile:
    """labels_as_units: in the two patterns with a label before the unit, take the label word as the unit (parity, D2)."""

    country: str = "CA"
    default_city: str = "Halifax"
    default_province: str = "NS"
    provinces: tuple[str, ...] = PROVINCES
    long_provinces: dict[str, str] = field(default_factory=lambda: dict(LONG_PROVINCES))
    latitude: tuple[float, float] = (43.5, 47.0)
    longitude: tuple[float, float] = (-66.0, -60.0)
    labels_as_units: bool = True

    @property
    def inline(self) -> Rule:
        return Rule("inline_unit_after_street_with_city_tail", INLINE_UNIT, 1, 2, 3, 0.95, 0.96)

    @property
    def rules(self) -> tuple[Rule, ...]:
        """The rules after the inline one, first match wins."""
        label = 1 if self.labels_as_units else 2
        return (
            Rule("trailing_bare_unit_before_city", UNIT_BEFORE_CITY, 1, 2, 3, 0.94, 0.92, city=4, province=5),
            Rule("trailing_bare_unit_suffix", UNIT_SUFFIX, 1, 2, 3, 0.90, 0.90),
            Rule("comm_prefix_label", COMMUNITY_PREFIX, 3, 4, label, 0.90, 0.95),
            Rule("leading_hyphen", LEADING_HYPHEN, 2, 3, 1, 0.95, 0.98),
            Rule("hash_prefix", HASH_PREFIX, 2, 3, 1, 0.92, 0.95),
            Rule("level_prefix", LEVEL_PREFIX, 3, 4, label, 0.95, 0.98),
            Rule("street_standard", STREET_STANDARD, 1, 2, 0, 0.85, 0.80),
        )


_PROFILES = {"CA": CountryProfile(), "CA_V2": CountryProfile(labels_as_units=False)}
_ALIASES = {"BASE_CANADA": "CA", "NORTH_AMERICA_DEFAULT": "CA", "CUSTOM": "CA"}


def get_profile(name: str | None = None) -> CountryProfile:
    """The profile of a name or alias; unknown names mean Canada."""
    key = (name or "CA").strip().upper()
    return _PROFILES.get(_ALIASES.get(key, key), _PROFILES["CA"])
