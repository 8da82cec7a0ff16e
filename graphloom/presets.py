"""Configurations of fusing for a domain."""

from __future__ import annotations

from dataclasses import dataclass, field

from graphloom.functions.literals import DATE_FORMATS, LITERAL_PREDICATES


@dataclass(frozen=True)
class Mapping:
    """A predicate and the one it stands for; both ends of an equivalent mapping hold in both graphs."""

    predicate: str
    target: str
    kind: str = "equivalent"
    confidence: float = 1.0


@dataclass(frozen=True)
class EntityType:
    name: str
    color: str = "#ff6b00"
    group: str = "Entity"
    identity_keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class Scheme:
    """A kind of source URI: its prefix, what else is written for it, and whether it needs a hash of the content."""

    prefix: str
    category: str
    variants: tuple[str, ...] = ()
    hashed: bool = False


@dataclass(frozen=True)
class Preset:
    """Rules of a domain. Thresholds must be in order, within 0 and 1, and names of types unique."""

    domain: str
    types: tuple[EntityType, ...] = ()
    relations: tuple[Mapping, ...] = ()
    attributes: tuple[Mapping, ...] = ()
    schemes: tuple[Scheme, ...] = ()
    disjoint: tuple[tuple[str, str], ...] = ()
    opposing: tuple[tuple[str, str], ...] = ()
    functional: tuple[str, ...] = ()
    literals: tuple[str, ...] = LITERAL_PREDICATES
    dates: tuple[str, ...] = DATE_FORMATS
    high: float = 0.88
    review: float = 0.65
    embeddings: bool = False
    preferred_sources: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not 0 <= self.review <= self.high <= 1:
            raise ValueError("thresholds out of order")
        if len({t.name for t in self.types}) != len(self.types):
            raise ValueError("types must have different names")

    def mappings(self) -> list[tuple[str, str, str, float]]:
        """Rows of alignment.directional(): predicate, target, kind, confidence."""
        return [(m.predicate, m.target, m.kind, m.confidence) for m in (*self.relations, *self.attributes)]


# fixed values: the rules of the general domain
GENERAL = Preset(
    domain="general_agnostic",
    types=(
        EntityType("Entity"), EntityType("Concept", "#ffaa00", "Concept"), EntityType("Person", "#3b82f6", "Person", ("email", "tax_id")),
        EntityType("Organization", "#10b981", "Organization", ("org_id", "tax_id")), EntityType("Place", "#8b5cf6", "Place"),
    ),
    relations=(Mapping("worksAt", "employedBy"), Mapping("works_for", "employedBy"), Mapping("locatedIn", "basedIn")),
    attributes=(Mapping("fullName", "name"), Mapping("yearsOld", "age"), Mapping("dateOfBirth", "birthDate")),
    schemes=(
        Scheme("urn:doi:", "publication", ("https://doi.org/", "http://dx.doi.org/", "doi:")), Scheme("urn:patent:", "patent"), Scheme("https://", "web"),
        Scheme("urn:internal:", "internal", hashed=True), Scheme("urn:manual:", "ground_truth"),
    ),
)
