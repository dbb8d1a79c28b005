"""Mappings and the conventional places of inputs."""

from __future__ import annotations

import json
import re

from .. import messages as say
from ..operators.records import check_mapping
from ..schemas import MAPPINGS
from .places import Place

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")


def existing_file(path, what: str) -> Place:
    found = Place(path)
    if not found.is_file():
        raise FileNotFoundError(say.NOT_FOUND.format(what=what, path=found))
    return found


def load_json(path, what: str = "Input"):
    path = existing_file(path, f"{what} file")
    try:
        return json.loads(path.read_text())
    except json.JSONDecodeError as e:
        raise ValueError(say.INVALID_JSON.format(what=what.lower(), path=path, reason=e)) from e


def load_mapping(source) -> dict[str, str]:
    """A mapping from a JSON file or a dict, checked."""
    return check_mapping(source if isinstance(source, dict) else load_json(source, "Mapping"))


def dataset_name(value: str) -> str:
    name = value.strip().lower()
    if not NAME.fullmatch(name):
        raise ValueError(say.DATASET_NAME)
    return name


def discover_datasets(folder=None) -> tuple[str, ...]:
    """Known datasets, and those with a mapping file in `folder`."""
    own = [p.stem for p in Place(folder).files() if p.suffix == ".json" and NAME.fullmatch(p.stem)] if folder else []
    return tuple(sorted({*MAPPINGS, *own}))


def resolve_mapping(dataset: str | None, mapping=None, folder=None) -> dict[str, str]:
    """An explicit mapping wins; else the dataset's file in `folder`, else the known one."""
    if mapping is not None:
        return load_mapping(mapping)
    if dataset is None:
        raise ValueError(say.MAPPING_NEEDED)
    name = dataset_name(dataset)
    if folder and (path := Place(folder) / f"{name}.json").is_file():
        return load_mapping(path)
    if name not in MAPPINGS:
        raise FileNotFoundError(say.MAPPING_UNKNOWN.format(name=name))
    return load_mapping(MAPPINGS[name])


def only_existing(candidates: list[Place], what: str) -> Place:
    """The one candidate that exists; none and several are errors."""
    found = [p for p in candidates if p.is_file()]
    if len(found) > 1:
        raise ValueError(say.SEVERAL_INPUTS.format(what=what, paths=", ".join(map(str, found))))
    if not found:
        raise FileNotFoundError(say.NO_INPUT.format(what=what, names=", ".join(p.name for p in candidates)))
    return found[0]


def default_input(dataset: str, root) -> Place:
    name = dataset_name(dataset)
    return only_existing([Place(root) / "data" / "raw" / f"{stem}{suffix}" for stem in (name, f"{name}s") for suffix in (".xlsx", ".csv")], f"raw '{name}'")


def default_guide(dataset: str, root) -> Place:
    return only_existing([Place(root) / "data" / "raw" / f"{dataset}-content{suffix}" for suffix in (".xlsx", ".csv")], "corpus source")
