"""INI projects as frozen records."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field

TRUE = ("yes", "true", "1")


@dataclass(frozen=True)
class Project:
    name: str
    rasters: dict[str, str] = field(default_factory=dict)
    vectors: dict[str, str] = field(default_factory=dict)
    lookups: dict[str, str] = field(default_factory=dict)
    options: dict[str, str] = field(default_factory=dict)

    def flag(self, option: str) -> bool:
        return self.options.get(option, "").strip().lower() in TRUE

    def numbers(self, option: str) -> list[int]:
        """A comma list; empty means none."""
        return [int(x) for x in self.options.get(option, "").split(",") if x.strip()]


SECTIONS = ("rasters", "vectors", "lookups", "options")


def load(text: str, name: str) -> Project:
    """Empty values mean that the input doesn't apply; unknown sections are an error."""
    parser = configparser.ConfigParser()
    parser.read_string(text)
    unknown = set(parser.sections()) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    return Project(name, **{s: {k: v for k, v in parser[s].items() if v.strip()} for s in SECTIONS if parser.has_section(s)})


def template() -> str:
    return "\n\n".join(f"[{s}]" for s in SECTIONS) + "\n"


def missing(project: Project, rasters: tuple[str, ...] = ("dem", "soil", "landuse")) -> list[str]:
    return [r for r in rasters if r not in project.rasters]
