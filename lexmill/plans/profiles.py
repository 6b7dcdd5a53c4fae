"""Profiles: what a jurisdiction's documents look like, resolved on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError, UnknownProfileError
from . import vocabulary as v

CHUNK_POLICIES = ("default", "statute", "guidance", "case_law")


@dataclass(frozen=True)
class Limits:
    """Longest chunk and overlap of the windows into which longer paragraphs are cut, in characters."""

    max_chars: int = v.MAX_CHARS
    overlap: int = v.OVERLAP_CHARS

    def __post_init__(self) -> None:
        if self.max_chars <= 0 or not 0 <= self.overlap < self.max_chars:
            raise ConfigError(f"limits don't hold together: {self.max_chars} and {self.overlap}")


@dataclass(frozen=True)
class Profile:
    code: str
    language: str | None
    policies: dict[str, str] = field(hash=False)
    families: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    numbering: dict[str, list[str]] = field(default_factory=dict, hash=False)
    switches: dict[str, object] = field(default_factory=dict, hash=False)
    limits: Limits = Limits()

    @property
    def requires_family(self) -> bool:
        return bool(self.families)

    def switch(self, name: str):
        return self.switches.get(name)


@lru_cache(maxsize=None)
def _built(code: str) -> Profile:
    changed = v.POLICIES | v.POLICY_CHANGES.get(code, {})
    families = tuple((i, kind, tuple(dict.fromkeys(" ".join(a.split()).lower() for a in names))) for i, kind, names in v.DOC_FAMILIES[code])
    return Profile(code, v.PROFILES[code][0], {k: p for k, p in changed.items() if p}, families, v.NUMBERING[code], v.SWITCHES.get(code, {}))


def enabled_profiles() -> set[str]:
    return set(v.PROFILES)


def resolve(name: str | Profile | None) -> Profile:
    """The profile with the given code or other name; empty: generic."""
    if isinstance(name, Profile):
        return name
    wanted = (name or "").strip().lower() or "generic"
    if wanted in v.PROFILES:
        return _built(wanted)
    for code, (_, names) in v.PROFILES.items():
        if wanted in names:
            return _built(code)
    raise UnknownProfileError(f"unknown profile {name!r}; known: {', '.join(v.PROFILES)}")


def profile_code(name: Column) -> Column:
    """resolve() for a column: its code. Unknown names raise when the row is read."""
    wanted = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    pairs = {a: c for c, (_, names) in reversed(v.PROFILES.items()) for a in names} | {c: c for c in v.PROFILES} | {"": "generic"}
    table = F.create_map(*(F.lit(x) for pair in sorted(pairs.items()) for x in pair))
    return F.coalesce(F.element_at(table, wanted), F.raise_error(F.concat(F.lit("unknown profile "), wanted)).cast("string"))


def chunk_policy(profile: Profile | str, doc_kind: str | None = None) -> str:
    """The chunk policy for a kind of document; no kind: that of a code."""
    own = resolve(profile).policies
    kind = (doc_kind or "").strip().lower()
    found = own.get(kind) or own.get("other") or own.get("code") if kind else own.get("code") or own.get("other")
    if found not in CHUNK_POLICIES:
        raise ConfigError(f"unknown chunk policy {found!r}")
    return found


def chunk_policy_column(profile: Profile | str, doc_kind: Column) -> Column:
    """chunk_policy() for a column of kinds."""
    own = resolve(profile).policies
    kind = F.lower(F.trim(F.coalesce(doc_kind, F.lit(""))))
    table = F.create_map(*(F.lit(x) for pair in own.items() for x in pair))
    return F.when(kind == "", F.lit(own["code"])).otherwise(F.coalesce(F.element_at(table, kind), F.lit(own["other"])))


def numbering_words(profile: Profile | str, *families: str) -> list[str]:
    """Numbering words of the families, each once, in order."""
    found: dict[str, str] = {}
    for f in families:
        for w in resolve(profile).numbering.get(f, []):
            found.setdefault(w.strip().casefold(), w.strip())
    return list(found.values())
