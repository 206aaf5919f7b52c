"""Typed settings, kept as JSON on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from dittograph.functions.formatting import SizeUnit


@dataclass(frozen=True)
class Settings:
    SizeUnit: str = SizeUnit.AUTO.value
    Theme: str = "Light"
    MinFileSizeMB: int = 0
    MaxFileSizeMB: int = 0
    MaxDuplicatesToShow: int = 0
    GridPictureSize: int = 150
    ShowGridFilePath: bool = True
    ConfirmDelete: bool = True
    SimilarImageThreshold: float = 92.0
    AutoSelectSimilarImages: bool = False
    AutoSelectKeepUncompressed: bool = False
    AutoSelectKeepHigherResolution: bool = True
    AutoSelectKeepLargerFilesize: bool = False
    AutoSelectPreferredDirectories: str = ""


def _fits(value: object, kind: str) -> bool:
    if kind == "bool" or isinstance(value, bool):
        return kind == "bool" and isinstance(value, bool)
    return isinstance(value, {"int": int, "float": (int, float), "str": str}[kind])


def read_settings(path: str) -> Settings:
    """Settings of a file; a missing or unfit key, and an unreadable file, leave the defaults."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return Settings()
    if not isinstance(found, dict):
        return Settings()
    good = {f.name: found[f.name] for f in fields(Settings) if f.name in found and _fits(found[f.name], str(f.type))}
    if good.get("SizeUnit") not in {None, *(u.value for u in SizeUnit)}:
        del good["SizeUnit"]
    return Settings(**good)


def write_settings(settings: Settings, path: str) -> bool:
    """Write as indented JSON; says whether it could."""
    try:
        Path(path).write_text(json.dumps(asdict(settings), indent=2), encoding="utf-8")
    except OSError:
        return False
    return True
