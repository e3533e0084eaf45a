"""Rule packs: YAML files that say which checks run, with which limits."""

from __future__ import annotations

from pathlib import Path

import yaml

HERE = Path(__file__).parent.parent / "packs"


def resolve(name: str, kind: str = "rules", folder: Path = HERE) -> Path:
    """A path as given, else ``name.kind.yaml`` in ./configs or among the files that come with the package."""
    for path in (Path(name), Path("configs") / f"{name}.{kind}.yaml", folder / f"{name}.{kind}.yaml"):
        if path.is_file():
            return path
    raise FileNotFoundError(f"no {kind} file named {name!r}")


def load_pack(name: str) -> dict:
    """Read a rule pack."""
    try:
        pack = yaml.safe_load(resolve(name).read_text(encoding="utf-8"))
    except yaml.YAMLError as error:
        raise ValueError(f"rule pack {name!r} isn't valid YAML: {error}") from error
    if not isinstance(pack, dict) or not isinstance(pack.get("checks"), dict):
        raise ValueError(f"rule pack {name!r} has no checks")
    return pack
