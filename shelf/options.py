"""Options of a run, their presets, and the fixed literals that records carry."""

from __future__ import annotations

from dataclasses import dataclass, replace

GROUPS = {
    "year": "{year}",
    "month": "{year}/{month:02}-{month_name}",
    "week": "{iso_year}/{iso_year}-W{iso_week:02}",
    "day": "{year}/{month:02}/{day:02}",
}
LOCATION_SUFFIX = {"country": "{country}", "region": "{country}/{region}", "city": "{country}/{region}/{city}"}
#: Adaptive grouping has no template of its own; its years, months and weeks use the presets.
GRANULARITIES = (*GROUPS, "adaptive")
MODES, CONFLICTS, DEDUP = ("copy", "move"), ("skip", "rename", "overwrite"), ("off", "size-hash")

#: In order of precedence.
DATE_SOURCES = (
    "exif-datetime-original",
    "exif-create-date",
    "filename",
    "mtime",
    "creation-time",
    "exif-modify-date",
    "unknown",
)
KINDS = ("image", "raw", "video", "sidecar")
ACTIONS = ("copy", "move", "skip", "overwrite")
REASONS = ("planned", "duplicate-of-destination", "duplicate-of-source", "renamed", "existing-file", "already-done")
UNKNOWN_DATE, UNKNOWN_LOCATION, UNKNOWN_CAMERA, UNNAMED = "unknown-date", "unknown-location", "unknown-camera", "unnamed"


@dataclass(frozen=True)
class Options:
    source: str = ""
    dest: str = ""
    group: str = "month"
    location: str | None = None
    template: str | None = None
    mode: str = "copy"
    dry_run: bool = False
    on_conflict: str = "rename"
    force: bool = False
    dedup: str = "size-hash"
    copy_workers: int = 4
    adaptive_threshold: int = 400
    include_sidecars: bool = True
    include_video: bool = False
    filename_dates: bool = True
    follow_symlinks: bool = False
    resume: str | None = None
    journal: str | None = None
    #: Year that bounds believable dates from above; None reads the clock.
    now_year: int | None = None

    def normal(self) -> Options:
        """Bounds applied, and a resumed run journals to the file it resumes from."""
        for value, known in ((self.group, GRANULARITIES), (self.mode, MODES), (self.on_conflict, CONFLICTS), (self.dedup, DEDUP)):
            if value not in known:
                raise ValueError(f"{value!r} is none of {', '.join(known)}")
        if self.location is not None and self.location not in LOCATION_SUFFIX:
            raise ValueError(f"unknown location depth {self.location!r}")
        return replace(
            self,
            copy_workers=max(1, self.copy_workers),
            adaptive_threshold=max(1, self.adaptive_threshold),
            journal=self.journal or self.resume,
        )

    def template_for(self, level: str | None = None) -> str:
        """Template text of a grouping level; an explicit template overrides everything."""
        if self.template is not None:
            return self.template
        level = level or ("month" if self.group == "adaptive" else self.group)
        base = GROUPS[level]
        return f"{base}/{LOCATION_SUFFIX[self.location]}" if self.location else base

    @property
    def adaptive(self) -> bool:
        return self.group == "adaptive" and self.template is None
